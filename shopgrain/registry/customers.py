"""Customer feature queries."""

from __future__ import annotations

from ..operators import customers as op
from ..sources.tables import transactions
from .base import CFG, CUST, CUST_SELECT, TX, rounded


def _cust(spark, d):
    return op.customer_features(transactions(spark, d), CFG)


QUERIES = {
    "customer_features": lambda s, d: rounded(_cust(s, d), exact=("avg_order_value",)),
    "customer_modes": lambda s, d: op.customer_modes(
        transactions(s, d, ["customer_id", "payment_method"]), "payment_method", "preferred_payment"
    ),
    "last_order_flag": lambda s, d: op.last_order_flag(
        transactions(s, d, ["customer_id", "order_id", "order_date", "returned"])
    ),
    "returner_split": lambda s, d: op.returner_split(transactions(s, d, ["customer_id", "returned"])),
    "temporal_profile": lambda s, d: rounded(op.temporal_profile(transactions(s, d, ["order_date", "total_amount"])), 4),
    "missing_days": lambda s, d: op.missing_days(transactions(s, d, ["order_date"])),
    "churn_retention_profile": lambda s, d: rounded(op.churn_retention_profile(_cust(s, d), CFG)),
    "top20_contribution": lambda s, d: rounded(op.top_fraction_contribution(_cust(s, d))),
    "portfolio_kpis": lambda s, d: rounded(op.portfolio_kpis(transactions(s, d), _cust(s, d))),
    "high_value_customers": lambda s, d: rounded(op.high_value_customers(_cust(s, d)), exact=("avg_order_value",)),
    "high_value_summary": lambda s, d: rounded(op.high_value_summary(_cust(s, d))),
}

_PROFILE = """
  count(*) AS total_customers,
  count(*) FILTER (WHERE frequency = 1) AS one_time_buyers,
  round(count(*) FILTER (WHERE frequency = 1) * 100.0 / count(*), 6) AS one_time_buyer_pct,
  count(*) FILTER (WHERE frequency >= 2) AS repeat_customers,
  round(count(*) FILTER (WHERE frequency >= 2) * 100.0 / count(*), 6) AS repeat_customer_pct,
  count(*) FILTER (WHERE frequency >= 5) AS loyal_customers,
  count(*) FILTER (WHERE frequency >= 10) AS super_loyal,
  round(sum(u) / 10000.0, 6) AS total_revenue,
  round(coalesce(sum(u) FILTER (WHERE frequency = 1), 0) / 10000.0, 6) AS one_timer_revenue,
  round(coalesce(sum(u) FILTER (WHERE frequency >= 2), 0) / 10000.0, 6) AS repeat_revenue,
  round(coalesce(sum(u) FILTER (WHERE frequency >= 10), 0) / 10000.0, 6) AS super_loyal_revenue,
  count(*) FILTER (WHERE churn = 1) AS churned_count,
  round(count(*) FILTER (WHERE churn = 1) * 100.0 / count(*), 6) AS churned_pct,
  count(*) FILTER (WHERE churn = 0) AS active_count,
  count(*) FILTER (WHERE churn = 0 AND recency_days > 90) AS at_risk_count,
  round(coalesce(sum(u) FILTER (WHERE churn = 0 AND recency_days > 90), 0) / 10000.0, 6) AS revenue_at_risk"""

_CU = f"WITH {CUST}, cu AS (SELECT *, CAST(round(monetary * 10000) AS BIGINT) AS u FROM cust)"

_TOP = """top AS (
  SELECT count(*) AS top_n, sum(u) / 10000.0 AS top_value, (SELECT sum(u) FROM cu) / 10000.0 AS total_value
  FROM (SELECT u, row_number() OVER (ORDER BY monetary DESC NULLS LAST, customer_id) AS rn FROM cu)
  WHERE rn <= greatest(CAST(floor((SELECT count(*) FROM cu) * 0.2) AS BIGINT), 1))"""

_HV = """hv AS (SELECT *, (SELECT quantile_cont(monetary, 0.9) FROM cu) AS threshold FROM cu)"""

ORACLES = {
    "customer_features": f"WITH {CUST} SELECT {CUST_SELECT} FROM cust",
    "customer_modes": f"""WITH {TX}, g AS (
  SELECT customer_id, payment_method, count(*) AS n,
         row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, payment_method) AS rn
  FROM tx GROUP BY 1, 2)
SELECT customer_id, payment_method AS preferred_payment, n AS mode_count FROM g WHERE rn = 1""",
    "last_order_flag": f"""WITH {TX} SELECT customer_id, max(order_date) AS last_order,
  arg_max(returned, (order_date, order_id)) AS last_order_was_return FROM tx GROUP BY 1""",
    "returner_split": f"""WITH {TX}, p AS (SELECT customer_id, avg(returned) AS rate, count(*) AS n FROM tx GROUP BY 1)
SELECT CASE WHEN rate = 0 THEN 'never' WHEN rate = 1 THEN 'pure' ELSE 'mixed' END AS returner,
  count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders FROM p GROUP BY 1""",
    "temporal_profile": f"""WITH {TX}, m AS (
  SELECT date_trunc('month', order_date) AS month, sum(amt) / 10000.0 AS revenue FROM tx GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY month) AS f, row_number() OVER (ORDER BY month DESC) AS l FROM m),
h AS (SELECT avg(revenue) FILTER (WHERE f <= 3) AS head, avg(revenue) FILTER (WHERE l <= 3) AS tail FROM r),
d AS (SELECT min(order_date) AS lo, max(order_date) AS hi, count(DISTINCT order_date) AS n FROM tx)
SELECT (SELECT count(*) FROM r) AS active_months,
  (SELECT strftime(month, '%Y-%m') FROM r ORDER BY revenue DESC, month LIMIT 1) AS peak_month,
  (SELECT round(max(revenue), 4) FROM r) AS peak_revenue,
  (SELECT strftime(month, '%Y-%m') FROM r ORDER BY revenue, month LIMIT 1) AS trough_month,
  (SELECT round(min(revenue), 4) FROM r) AS trough_revenue,
  (SELECT round(avg(revenue), 4) FROM r) AS avg_monthly_revenue,
  (SELECT round(stddev_samp(revenue) / avg(revenue) * 100, 4) FROM r) AS revenue_volatility,
  CAST(hi - lo AS INTEGER) AS dataset_span_days, CAST(hi - lo AS BIGINT) + 1 - n AS missing_dates,
  (SELECT round((tail - head) / head * 100, 4) FROM h) AS growth_rate FROM d""",
    "missing_days": f"""WITH {TX}, g AS (
  SELECT CAST(unnest(generate_series((SELECT min(order_date) FROM tx), (SELECT max(order_date) FROM tx), INTERVAL 1 DAY)) AS DATE) AS order_date)
SELECT order_date FROM g EXCEPT SELECT order_date FROM tx""",
    "churn_retention_profile": f"{_CU} SELECT {_PROFILE} FROM cu",
    "top20_contribution": f"""{_CU}, {_TOP} SELECT top_n, round(top_value, 6) AS top_value,
  round(total_value, 6) AS total_value, round(top_value / total_value * 100, 6) AS contribution_pct FROM top""",
    "portfolio_kpis": f"""{_CU}, {_TOP}, prof AS (SELECT {_PROFILE} FROM cu)
SELECT count(*) AS total_transactions, min(order_date) AS date_range_start, max(order_date) AS date_range_end,
  round(sum(amt) / 10000.0, 6) AS total_revenue, round(avg(returned) * 100, 6) AS return_rate,
  (SELECT count(*) FROM cu) AS total_customers, (SELECT round(avg(churn) * 100, 6) FROM cu) AS churn_rate,
  (SELECT round(sum(u) / 10000.0 / count(u), 6) FROM cu) AS avg_customer_value,
  (SELECT round(avg(loyalty_score), 6) FROM cu) AS avg_loyalty_score,
  (SELECT round(top_value / total_value * 100, 6) FROM top) AS top20_contribution,
  (SELECT one_time_buyer_pct FROM prof) AS one_time_buyer_pct, (SELECT revenue_at_risk FROM prof) AS revenue_at_risk,
  round(count(*) / (SELECT count(*) FROM cu), 6) AS avg_orders_per_customer,
  round(sum(amt) / 10000.0 / count(*), 6) AS avg_transaction_value FROM tx""",
    "high_value_customers": f"""{_CU}, {_HV} SELECT {CUST_SELECT}, round(threshold, 6) AS threshold
FROM hv WHERE monetary >= threshold""",
    "high_value_summary": f"""{_CU}, {_HV} SELECT round(max(threshold), 6) AS threshold, count(*) AS customers,
  round(sum(u) / 10000.0, 6) AS revenue, round(avg(frequency), 6) AS avg_frequency,
  round(avg(recency_days), 6) AS avg_recency,
  round(sum(u) / (SELECT sum(u) FROM cu) * 100, 6) AS revenue_share_pct FROM hv WHERE monetary >= threshold""",
}
