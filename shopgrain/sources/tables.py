"""Transaction schema and the adapter from order-line tables to transactions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("order_id", T.StringType(), False),
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("product_id", T.StringType(), False),
        T.StructField("order_date", T.DateType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("region", T.StringType(), False),
        T.StructField("customer_gender", T.StringType(), False),
        T.StructField("payment_method", T.StringType(), False),
        T.StructField("price", T.DoubleType(), False),
        T.StructField("discount", T.DoubleType(), False),
        T.StructField("quantity", T.IntegerType(), False),
        T.StructField("total_amount", T.DoubleType(), False),
        T.StructField("shipping_cost", T.DoubleType(), False),
        T.StructField("profit_margin", T.DoubleType(), False),
        T.StructField("customer_age", T.IntegerType(), False),
        T.StructField("delivery_time_days", T.IntegerType(), True),
        T.StructField("returned", T.IntegerType(), True),
    ]
)

TRANSACTION_COLUMNS = tuple(TRANSACTION_SCHEMA.fieldNames())

CUSTOMER_COLUMNS = (
    "customer_id", "recency_days", "frequency", "monetary", "net_monetary", "avg_order_value",
    "tenure_days", "discount_usage_rate", "category_diversity", "return_rate",
    "last_order_was_return", "preferred_region", "preferred_payment", "preferred_gender",
    "preferred_age", "loyalty_score", "churn",
)

_FROM_PART = {"category", "profit_margin"}
_FROM_CUSTOMER = {"region", "customer_gender"}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def transactions(spark: SparkSession, folder: str, columns: Iterable[str] | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """One row per order line, in the transaction layout, and after it the columns of the line table in ``keep`` as they are.

    Only the dimensions that the asked-for columns need are joined. The dimension joins are left
    joins on unique keys, so the set of rows does not depend on ``columns``. No join carries a
    broadcast hint: Spark decides by the measured size of each side, and AQE splits skewed keys.
    """
    want = set(columns) if columns is not None else set(TRANSACTION_COLUMNS)
    unknown = want - set(TRANSACTION_COLUMNS)
    if unknown:
        raise ValueError(f"unknown transaction columns: {sorted(unknown)}")

    heads = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_orderpriority"
    )
    if want & _FROM_CUSTOMER:
        people = read_table(spark, folder, "customer").select(
            F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey")
        )
        if "region" in want:
            nation = read_table(spark, folder, "nation").select(
                "n_nationkey", F.col("n_regionkey").alias("r_regionkey")
            )
            region = read_table(spark, folder, "region").select("r_regionkey", "r_name")
            people = people.join(nation, "n_nationkey", "left").join(region, "r_regionkey", "left")
        heads = heads.join(people, "o_custkey", "left")
    lines = read_table(spark, folder, "lineitem")
    if want & _FROM_PART:  # before the orders, so that this shuffle of all lines does not carry what an order has
        part = read_table(spark, folder, "part").select(
            F.col("p_partkey").alias("l_partkey"), "p_type", "p_retailprice"
        )
        lines = lines.join(part, "l_partkey", "left")
    lines = lines.join(heads, "l_orderkey")

    amount = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    exprs = {
        "order_id": lambda: F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "customer_id": lambda: F.col("o_custkey").cast("string"),
        "product_id": lambda: F.col("l_partkey").cast("string"),
        "order_date": lambda: F.col("o_orderdate").cast("date"),
        "category": lambda: F.col("p_type"),
        "region": lambda: F.col("r_name"),
        "customer_gender": lambda: F.col("c_mktsegment"),
        "payment_method": lambda: F.col("o_orderpriority"),
        "price": lambda: F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")),
        "discount": lambda: F.col("l_discount"),
        "quantity": lambda: F.col("l_quantity").cast("int"),
        "total_amount": lambda: amount,
        "shipping_cost": lambda: F.col("l_extendedprice") * F.col("l_tax"),
        "profit_margin": lambda: amount - F.col("p_retailprice") * F.col("l_quantity"),
        "customer_age": lambda: (F.lit(18) + F.col("o_custkey") % 60).cast("int"),
        "delivery_time_days": lambda: F.lit(None).cast("int"),
        "returned": lambda: (F.col("l_returnflag") == "R").cast("int"),
    }
    return lines.select(*[exprs[c]().alias(c) for c in TRANSACTION_COLUMNS if c in want], *keep)
