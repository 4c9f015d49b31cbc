"""One-row-per-customer features and the reports built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT, Config
from ..functions.expr import (
    count_if, money_avg, money_sum, money_units, MONEY_SCALE, month_start, one_row, safe_divide, share,
)
from ..functions.ranks import quantiles, top_share
from ..session import materialized

def kept():
    return F.col("returned") == 0


def customer_measures(tx: DataFrame) -> DataFrame:
    """Every per-customer aggregate in a single shuffle on customer_id.

    Modes, the distinct category count and the last-order flag are aggregates with partial
    (map-side) states whose size is bounded by the number of labels, so a customer with a huge
    share of all rows is reduced before the shuffle and no distinct-expansion is planned.
    """
    kept_amount = F.when(kept(), F.col("total_amount"))
    back_amount = F.when(F.col("returned") == 1, F.col("total_amount"))
    return tx.groupBy("customer_id").agg(
        F.max(F.when(kept(), F.col("order_date"))).alias("last_kept"),
        F.min("order_date").alias("first_order"),
        F.max("order_date").alias("last_order"),
        F.count("*").alias("orders"),
        count_if(kept()).alias("kept_orders"),
        money_sum(kept_amount).alias("kept_amount"),
        money_sum(back_amount).alias("returned_amount"),
        share(F.col("discount") > 0).alias("discount_usage_rate"),
        F.size(F.collect_set(F.when(kept(), F.col("category")))).cast("bigint").alias("categories"),
        F.avg("returned").alias("return_rate"),
        F.max_by("returned", F.struct("order_date", "order_id")).alias("last_order_was_return"),
        F.mode("region", True).alias("preferred_region"),
        F.mode("payment_method", True).alias("preferred_payment"),
        F.mode("customer_gender", True).alias("preferred_gender"),
        F.mode("customer_age", True).alias("preferred_age"),
    )


def customer_features(tx: DataFrame, cfg: Config = DEFAULT, as_of: str | None = None) -> DataFrame:
    """The 17-column customer table. ``as_of`` defaults to the latest order date of ``tx``.

    The measures are written once to the shared folder. The reference date and the population maxima
    of the loyalty score then come from that small table, and so does every later use of the result:
    the transactions are read and shuffled a single time.
    """
    m = materialized(customer_measures(tx))
    ref = F.lit(as_of).cast("date") if as_of else m.agg(F.max("last_order").alias("d")).scalar()
    has_kept = F.col("kept_orders") > 0
    base = m.select(
        "customer_id",
        F.datediff(ref, F.col("last_kept")).alias("recency_days"),
        F.when(has_kept, F.col("kept_orders")).alias("frequency"),
        F.col("kept_amount").alias("monetary"),
        (F.coalesce("kept_amount", F.lit(0.0)) - F.coalesce("returned_amount", F.lit(0.0))).alias("net_monetary"),
        F.try_divide("kept_amount", F.when(has_kept, F.col("kept_orders")).cast("double")).alias("avg_order_value"),
        F.datediff("last_order", "first_order").alias("tenure_days"),
        "discount_usage_rate",
        F.when(has_kept, F.col("categories")).alias("category_diversity"),
        "return_rate",
        "last_order_was_return",
        F.coalesce("preferred_region", F.lit("Unknown")).alias("preferred_region"),
        F.coalesce("preferred_payment", F.lit("Unknown")).alias("preferred_payment"),
        F.coalesce("preferred_gender", F.lit("Unknown")).alias("preferred_gender"),
        F.coalesce("preferred_age", F.lit(-1)).alias("preferred_age"),
    )
    top = one_row(m.agg(
        F.datediff(ref, F.min("last_kept")).alias("r"), F.max("kept_orders").alias("f"), F.max("kept_amount").alias("m")
    ))
    return loyalty_and_churn(base.withColumn("_top", top), cfg).drop("_top")


def loyalty_and_churn(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Loyalty relative to the maxima in ``_top`` (r, f, m) and the churn flag."""
    c = cfg.customer
    part = lambda x, t: safe_divide(F.col(x), F.col(f"_top.{t}"), 0.0)
    loyalty = (
        c.weight_recency * (1 - part("recency_days", "r"))
        + c.weight_frequency * part("frequency", "f")
        + c.weight_monetary * part("monetary", "m")
    )
    late = F.col("recency_days").isNull() | (F.col("recency_days") > c.churn_days)
    return df.withColumn("loyalty_score", F.when(F.col("frequency").isNotNull(), loyalty)).withColumn(
        "churn", F.when(late, 1).otherwise(0))


def customer_modes(tx: DataFrame, column: str, name: str) -> DataFrame:
    """Most frequent value per customer, smallest on ties, by counting pairs first."""
    pairs = tx.where(F.col(column).isNotNull()).groupBy("customer_id", column).agg(F.count("*").alias("n"))
    order = Window.partitionBy("customer_id").orderBy(F.desc("n"), F.col(column))
    return pairs.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(
        "customer_id", F.col(column).alias(name), F.col("n").alias("mode_count")
    )


def last_order_flag(tx: DataFrame) -> DataFrame:
    """Returned flag of each customer's latest order; ties on the day go to the larger order id."""
    return tx.groupBy("customer_id").agg(
        F.max("order_date").alias("last_order"),
        F.max_by("returned", F.struct("order_date", "order_id")).alias("last_order_was_return"),
    )


def returner_split(tx: DataFrame) -> DataFrame:
    """How many customers return nothing, some or all of their orders."""
    per = tx.groupBy("customer_id").agg(F.avg("returned").alias("rate"), F.count("*").alias("orders"))
    kind = F.when(F.col("rate") == 0, "never").when(F.col("rate") == 1, "pure").otherwise("mixed")
    return per.groupBy(kind.alias("returner")).agg(
        F.count("*").alias("customers"), F.sum("orders").alias("orders")
    )


def temporal_profile(tx: DataFrame) -> DataFrame:
    """One row: active months, peak and trough month, volatility, span, growth, days without orders."""
    daily = tx.where(F.col("order_date").isNotNull()).groupBy("order_date").agg(
        F.sum(money_units(F.col("total_amount"))).alias("u")
    )
    # From here on the data is one row per calendar day, so later aggregates are small.
    monthly = daily.groupBy(month_start(F.col("order_date")).alias("month")).agg(
        (F.sum("u").cast("double") / MONEY_SCALE).alias("revenue"), F.count("*").alias("days"),
        F.min("order_date").alias("lo"), F.max("order_date").alias("hi"),
    )
    first = Window.orderBy("month")
    last = Window.orderBy(F.desc("month"))
    m = monthly.withColumn("_f", F.row_number().over(first)).withColumn("_l", F.row_number().over(last))
    label = F.date_format("month", "yyyy-MM")
    head = F.avg(F.when(F.col("_f") <= 3, F.col("revenue")))
    tail = F.avg(F.when(F.col("_l") <= 3, F.col("revenue")))
    span = F.datediff(F.max("hi"), F.min("lo"))
    return m.agg(
        F.count("*").alias("active_months"),
        F.max_by(label, F.struct("revenue", (-F.col("_f")).alias("k"))).alias("peak_month"),
        F.max("revenue").alias("peak_revenue"),
        F.min_by(label, F.struct("revenue", F.col("_f").alias("k"))).alias("trough_month"),
        F.min("revenue").alias("trough_revenue"),
        F.avg("revenue").alias("avg_monthly_revenue"),
        (safe_divide(F.stddev_samp("revenue"), F.avg("revenue"), 0.0) * 100).alias("revenue_volatility"),
        span.alias("dataset_span_days"),
        (span + 1 - F.sum("days")).cast("bigint").alias("missing_dates"),
        F.when(F.count("*") >= 3, safe_divide(tail - head, head, 0.0) * 100).alias("growth_rate"),
    )


def missing_days(tx: DataFrame) -> DataFrame:
    """Calendar days between the first and last order without any order."""
    days = tx.where(F.col("order_date").isNotNull()).select("order_date").distinct()
    grid = days.agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("order_date")
    )
    return grid.join(days, "order_date", "left_anti")


def churn_retention_profile(cust: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row of loyalty bands, churn counts and revenue at risk."""
    c = cfg.customer
    f, money = F.col("frequency"), F.col("monetary")
    at_risk = (F.col("churn") == 0) & (F.col("recency_days") > c.churn_days * c.at_risk_multiplier)
    pct = lambda cond: F.try_divide(count_if(cond) * 100.0, F.count(F.lit(1)))
    rev = lambda cond: F.coalesce(money_sum(F.when(cond, money)), F.lit(0.0))
    return cust.agg(
        F.count(F.lit(1)).alias("total_customers"),
        count_if(f == 1).alias("one_time_buyers"),
        pct(f == 1).alias("one_time_buyer_pct"),
        count_if(f >= 2).alias("repeat_customers"),
        pct(f >= 2).alias("repeat_customer_pct"),
        count_if(f >= c.loyal_orders).alias("loyal_customers"),
        count_if(f >= c.super_loyal_orders).alias("super_loyal"),
        F.coalesce(money_sum(money), F.lit(0.0)).alias("total_revenue"),
        rev(f == 1).alias("one_timer_revenue"),
        rev(f >= 2).alias("repeat_revenue"),
        rev(f >= c.super_loyal_orders).alias("super_loyal_revenue"),
        count_if(F.col("churn") == 1).alias("churned_count"),
        pct(F.col("churn") == 1).alias("churned_pct"),
        count_if(F.col("churn") == 0).alias("active_count"),
        count_if(at_risk).alias("at_risk_count"),
        rev(at_risk).alias("revenue_at_risk"),
    )


def top_fraction_contribution(cust: DataFrame, fraction: float = 0.2) -> DataFrame:
    """Revenue share of the top ``fraction`` of customers, ties resolved by value, not by row."""
    t = top_share(cust, "monetary", fraction)
    return t.withColumn("contribution_pct", safe_divide(F.col("top_value"), F.col("total_value"), 0.0) * 100)


def portfolio_kpis(tx: DataFrame, cust: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """One row of headline numbers. ``quality`` is an optional one-row frame with quality_score."""
    t = tx.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.min("order_date").alias("date_range_start"),
        F.max("order_date").alias("date_range_end"),
        money_sum(F.col("total_amount")).alias("total_revenue"),
        (F.avg("returned") * 100).alias("return_rate"),
    )
    c = cust.agg(
        F.count(F.lit(1)).alias("total_customers"),
        (F.avg("churn") * 100).alias("churn_rate"),
        money_avg(F.col("monetary")).alias("avg_customer_value"),
        F.avg("loyalty_score").alias("avg_loyalty_score"),
    )
    top = top_fraction_contribution(cust).select(F.col("contribution_pct").alias("top20_contribution"))
    prof = churn_retention_profile(cust).select("one_time_buyer_pct", "revenue_at_risk")
    out = t.withColumn("_c", one_row(c)).withColumn("_t", one_row(top)).withColumn("_p", one_row(prof))
    out = out.select(*t.columns, "_c.*", "_t.*", "_p.*")
    out = out.withColumn(
        "avg_orders_per_customer", F.try_divide(F.col("total_transactions"), F.col("total_customers"))
    ).withColumn("avg_transaction_value", F.try_divide(F.col("total_revenue"), F.col("total_transactions")))
    if quality is not None:
        out = out.withColumn("data_quality_score", quality.select("quality_score").scalar())
    return out


def high_value_customers(cust: DataFrame, percentile: float = 0.9) -> DataFrame:
    """Customers whose monetary value reaches the percentile, with the threshold on each row."""
    cut = quantiles(cust, "monetary", {"t": percentile}).scalar()
    return cust.withColumn("threshold", cut).where(F.col("monetary") >= F.col("threshold"))


def high_value_summary(cust: DataFrame, percentile: float = 0.9) -> DataFrame:
    top = high_value_customers(cust, percentile).agg(
        F.max("threshold").alias("threshold"),
        F.count(F.lit(1)).alias("customers"),
        money_sum(F.col("monetary")).alias("revenue"),
        F.avg("frequency").alias("avg_frequency"),
        F.avg("recency_days").alias("avg_recency"),
    )
    total = cust.agg(money_sum(F.col("monetary")).alias("m")).scalar()
    return top.withColumn("revenue_share_pct", safe_divide(F.col("revenue"), total, 0.0) * 100)
