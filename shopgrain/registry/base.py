"""Shared pieces of the registered queries and of their SQL."""

from __future__ import annotations

from dataclasses import replace
from statistics import NormalDist

from pyspark.sql import DataFrame, functions as F, types as T

from ..config import DEFAULT

# The driver's tables end in a partial month and carry discounts of 0..10 percent.
CUTOFF = "2001-08-01"
CFG = replace(
    DEFAULT,
    sales=replace(DEFAULT.sales, incomplete_month_cutoff=CUTOFF, discount_levels=tuple(range(11))),
    cohort=replace(DEFAULT.cohort, incomplete_cutoff=CUTOFF),
    fraud=replace(DEFAULT.fraud, high_discount=0.08, max_discount=0.10),
)


def rounded(df: DataFrame, digits: int = 6, exact: tuple[str, ...] = ()) -> DataFrame:
    """Round every DOUBLE but those in ``exact`` so that both engines print the same digits.

    ``exact`` names single quotients of exact sums: equal in both engines, and prone to rounding ties.
    """
    return df.select(
        *[
            (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) and f.name not in exact else F.col(f.name)
            for f in df.schema.fields
        ]
    )


#: Two-sided critical values of z at 5 %, adjusted for the number of pairs.
CRITICAL = "SELECT * FROM (VALUES " + ", ".join(f"({n}, {NormalDist().inv_cdf(1 - 0.025 / n)!r}::DOUBLE)" for n in range(1, 2001)) + ") AS c(pairs, critical)"

TX = """
tx AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS order_id,
         CAST(o_custkey AS VARCHAR) AS customer_id, CAST(l_partkey AS VARCHAR) AS product_id,
         CAST(o_orderdate AS DATE) AS order_date, p_type AS category, r_name AS region,
         c_mktsegment AS customer_gender, o_orderpriority AS payment_method,
         l_extendedprice / l_quantity AS price, l_discount AS discount,
         CAST(l_quantity AS INTEGER) AS quantity,
         l_extendedprice * (1 - l_discount) AS total_amount,
         l_extendedprice * l_tax AS shipping_cost,
         l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity AS profit_margin,
         CAST(18 + o_custkey % 60 AS INTEGER) AS customer_age,
         CAST(NULL AS INTEGER) AS delivery_time_days,
         CAST(l_returnflag = 'R' AS INTEGER) AS returned,
         CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT) AS amt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey)"""


def _mode(col: str, name: str) -> str:
    return f"""
{name}_m AS (
  SELECT customer_id, {col} AS {name} FROM (
    SELECT customer_id, {col}, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, {col}) AS rn
    FROM tx GROUP BY customer_id, {col}) WHERE rn = 1)"""


CUST = (
    TX
    + ","
    + ",".join(
        [
            _mode("region", "preferred_region"),
            _mode("payment_method", "preferred_payment"),
            _mode("customer_gender", "preferred_gender"),
            _mode("customer_age", "preferred_age"),
        ]
    )
    + """,
cust_agg AS (
  SELECT customer_id,
         max(order_date) FILTER (WHERE returned = 0) AS last_kept, min(order_date) AS first_order,
         max(order_date) AS last_order, count(*) FILTER (WHERE returned = 0) AS kept_orders,
         CAST(sum(amt) FILTER (WHERE returned = 0) AS DOUBLE) / 10000 AS kept_amount,
         CAST(sum(amt) FILTER (WHERE returned = 1) AS DOUBLE) / 10000 AS back_amount,
         avg(CASE WHEN discount > 0 THEN 1 ELSE 0 END) AS discount_usage_rate,
         count(DISTINCT category) FILTER (WHERE returned = 0) AS categories,
         avg(returned) AS return_rate, arg_max(returned, (order_date, order_id)) AS last_order_was_return
  FROM tx GROUP BY customer_id),
cust_base AS (
  SELECT customer_id,
         CAST((SELECT max(order_date) FROM tx) - last_kept AS INTEGER) AS recency_days,
         CASE WHEN kept_orders > 0 THEN kept_orders END AS frequency, kept_amount AS monetary,
         coalesce(kept_amount, 0) - coalesce(back_amount, 0) AS net_monetary,
         kept_amount / CASE WHEN kept_orders > 0 THEN kept_orders END AS avg_order_value,
         CAST(last_order - first_order AS INTEGER) AS tenure_days, discount_usage_rate,
         CASE WHEN kept_orders > 0 THEN categories END AS category_diversity, return_rate,
         last_order_was_return, preferred_region, preferred_payment, preferred_gender, preferred_age
  FROM cust_agg JOIN preferred_region_m USING (customer_id) JOIN preferred_payment_m USING (customer_id)
  JOIN preferred_gender_m USING (customer_id) JOIN preferred_age_m USING (customer_id)),
cust AS (
  SELECT *,
         CASE WHEN frequency IS NOT NULL THEN
           0.3 * (1 - CAST(recency_days AS DOUBLE) / (SELECT max(recency_days) FROM cust_base))
         + 0.4 * (CAST(frequency AS DOUBLE) / (SELECT max(frequency) FROM cust_base))
         + 0.3 * (monetary / (SELECT max(monetary) FROM cust_base)) END AS loyalty_score,
         CASE WHEN recency_days IS NULL OR recency_days > 120 THEN 1 ELSE 0 END AS churn
  FROM cust_base)"""
)

# Doubles of the customer table that need rounding in the SQL output.
CUST_SELECT = """customer_id, recency_days, frequency, round(monetary, 6) AS monetary,
  round(net_monetary, 6) AS net_monetary, avg_order_value, tenure_days,
  round(discount_usage_rate, 6) AS discount_usage_rate, category_diversity,
  round(return_rate, 6) AS return_rate, last_order_was_return, preferred_region, preferred_payment,
  preferred_gender, preferred_age, round(loyalty_score, 6) AS loyalty_score, churn"""
