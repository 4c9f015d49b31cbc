"""Sales queries."""

from __future__ import annotations

from ..operators import sales as op
from ..sources.tables import transactions
from .base import CFG, CUTOFF, TX, rounded

_TIME = ["order_date", "customer_id", "total_amount", "returned"]


def _tx(s, d, *cols):
    return transactions(s, d, cols)


def _monthly(s, d):
    return op.monthly_sales(op.complete_months(_tx(s, d, *_TIME), CFG))


def _yoy(s, d):
    return op.yoy_growth(_monthly(s, d), CFG)


def _weekly(s, d):
    return op.weekly_sales(op.complete_months(_tx(s, d, *_TIME), CFG))


def _rollup(s, d):
    tx = transactions(s, d)
    weekly = op.weekly_sales(op.complete_months(tx, CFG))
    return op.kpi_rollup({
        "time_trends": op.trend_metrics(_yoy(s, d)).select("total_months", "peak_month"),
        "discount": op.discount_summary(tx, CFG).select("total_levels"),
        "trend": op.rolling_trend(weekly, 13).select("n_weeks", "basis"),
    })


QUERIES = {
    "monthly_revenue_yoy": lambda s, d: _yoy(s, d).select("year_month", "total_amount", "num_orders", "customers", "yoy_growth"),
    "trend_metrics": lambda s, d: rounded(op.trend_metrics(_yoy(s, d)), 4),
    "calendar_columns": lambda s, d: op.calendar_columns(_tx(s, d, "order_id", "order_date")),
    "seasonality": lambda s, d: rounded(op.seasonality(op.complete_months(_tx(s, d, "order_date", "total_amount"), CFG))),
    "weekly_revenue": lambda s, d: rounded(_weekly(s, d)),
    "rolling_trend": lambda s, d: rounded(op.rolling_trend(_weekly(s, d), 13)),
    "chronological_split": lambda s, d: rounded(op.chronological_split(_weekly(s, d), CFG)),
    "category_perf": lambda s, d: op.category_performance(_tx(s, d, "order_id", "category", "total_amount", "quantity", "returned", "profit_margin")),
    "category_mix": lambda s, d: rounded(op.category_mix(_tx(s, d, "category", "total_amount", "returned"))),
    "category_pareto": lambda s, d: rounded(op.category_pareto(_tx(s, d, "category", "total_amount"))),
    "region_perf": lambda s, d: op.region_performance(_tx(s, d, "region", "customer_id", "total_amount", "returned")),
    "payment_perf": lambda s, d: op.payment_performance(_tx(s, d, "payment_method", "order_id", "total_amount", "returned")),
    "discount_tiers": lambda s, d: op.discount_tiers(_tx(s, d, "discount", "order_id", "total_amount", "quantity", "profit_margin"), CFG),
    "discount_customers": lambda s, d: rounded(op.discount_customers(_tx(s, d, "customer_id", "discount", "total_amount"), p_value=False), 4),
    "discount_summary": lambda s, d: rounded(op.discount_summary(_tx(s, d, "discount", "order_id", "total_amount", "quantity", "profit_margin"), CFG), 4),
    "value_counts": lambda s, d: op.value_counts(_tx(s, d, "category", "region", "payment_method", "customer_gender"), ["category", "region", "payment_method", "customer_gender"]),
    "histogram_amount": lambda s, d: rounded(op.histogram(_tx(s, d, "total_amount"), "total_amount", 20)),
    "box_stats": lambda s, d: rounded(op.box_stats(_tx(s, d, "total_amount", "quantity", "discount", "shipping_cost"), ["total_amount", "quantity", "discount", "shipping_cost"])),
    "describe_transactions": lambda s, d: rounded(op.describe(_tx(s, d, "total_amount", "quantity", "discount", "delivery_time_days", "returned"), ["total_amount", "quantity", "discount", "delivery_time_days"], "returned"), 4),
    "performance_matrix": lambda s, d: op.performance_matrix(_tx(s, d, "category", "region", "total_amount")),
    "analysis_kpis": _rollup,
}

_M = f"""WITH {TX}, m AS (
  SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, sum(amt) / 10000.0 AS total_amount, count(*) AS num_orders,
         count(DISTINCT customer_id) AS customers
  FROM tx WHERE order_date < DATE '{CUTOFF}' GROUP BY 1),
g AS (SELECT CAST(unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH)) AS DATE) AS month),
y AS (SELECT g.month, total_amount, num_orders, customers,
  CASE WHEN (SELECT count(*) FROM m) >= 13 THEN
    round((total_amount - lag(total_amount, 12) OVER (ORDER BY g.month)) / lag(total_amount, 12) OVER (ORDER BY g.month) * 100, 2) END AS yoy_growth
  FROM g LEFT JOIN m USING (month)),
yoy AS (SELECT strftime(month, '%Y-%m') AS year_month, month, total_amount, num_orders, customers, yoy_growth FROM y WHERE num_orders IS NOT NULL)"""

_W = f"""WITH {TX}, w AS (
  SELECT CAST(date_trunc('week', order_date) AS DATE) + 6 AS date, sum(amt) / 10000.0 AS revenue,
         count(*) AS transactions, count(DISTINCT customer_id) AS customers
  FROM tx WHERE returned = 0 AND order_date < DATE '{CUTOFF}' GROUP BY 1 HAVING sum(amt) > 0)"""

_TIERS = f"""WITH {TX}, t AS (
  SELECT CAST(round(discount * 100) AS INTEGER) AS tier_order, ((sum(amt) + 50) // 100) / 100.0 AS revenue, count(*) AS orders,
         CAST(sum(quantity) AS BIGINT) AS quantity,
         round(CAST(sum(CAST(round(profit_margin * 10000) AS BIGINT)) AS DOUBLE) / 10000 / count(*), 2) AS avg_profit_margin
  FROM tx GROUP BY 1 HAVING tier_order BETWEEN 0 AND 10)"""

_BOX = "SELECT '{c}' AS column_name, round(min({c}), 6) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q1, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q3, round(max({c}), 6) AS max FROM tx"
_DESC = "SELECT '{c}' AS column_name, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, count(*) FILTER (WHERE {c} IS NULL) AS missing, round(corr({c}, returned), 4) AS target_correlation FROM tx"

ORACLES = {
    "monthly_revenue_yoy": f"{_M} SELECT year_month, total_amount, num_orders, customers, yoy_growth FROM yoy",
    "trend_metrics": f"""{_M} SELECT count(*) AS total_months, round(avg(total_amount), 4) AS avg_monthly_revenue,
  arg_max(year_month, total_amount) AS peak_month, round(max(total_amount), 4) AS peak_revenue,
  round(avg(yoy_growth), 4) AS avg_yoy_growth,
  (SELECT yoy_growth FROM yoy WHERE yoy_growth IS NOT NULL ORDER BY month DESC LIMIT 1) AS latest_yoy_growth FROM yoy""",
    "calendar_columns": f"""WITH {TX} SELECT order_id, order_date, strftime(order_date, '%Y-%m') AS year_month,
  CAST(year(order_date) AS INTEGER) AS year, monthname(order_date) AS month_name, dayname(order_date) AS weekday_name FROM tx""",
    "seasonality": f"""WITH {TX} SELECT monthname(order_date) AS month_name, round(sum(amt) / 10000.0 / count(*), 6) AS avg_order_value
  FROM tx WHERE order_date < DATE '{CUTOFF}' GROUP BY 1""",
    "weekly_revenue": f"{_W} SELECT date, round(revenue, 6) AS revenue, transactions, customers FROM w",
    "rolling_trend": f"""{_W}, r AS (SELECT revenue, row_number() OVER (ORDER BY date DESC) AS b FROM w),
a AS (SELECT count(*) AS n_weeks, avg(revenue) FILTER (WHERE b <= 13) AS recent, avg(revenue) FILTER (WHERE b BETWEEN 14 AND 26) AS prior FROM r)
SELECT n_weeks, round(recent, 6) AS recent, round(prior, 6) AS prior, round((recent / prior - 1) * 100, 6) AS pct_change, 'rolling' AS basis FROM a""",
    "chronological_split": f"""{_W}, r AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY date) <= floor((SELECT count(*) FROM w) * 0.8) THEN 'train' ELSE 'test' END AS part FROM w),
e AS (SELECT part, min(date) AS lo, max(date) AS hi FROM r GROUP BY 1),
g AS (SELECT part, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS date FROM e)
SELECT g.part, g.date, round(revenue, 6) AS revenue, transactions, customers FROM g LEFT JOIN r ON g.part = r.part AND g.date = r.date""",
    "category_perf": f"""WITH {TX} SELECT category, ((sum(amt) + 50) // 100) / 100.0 AS revenue, count(*) AS orders,
  CAST(sum(quantity) AS BIGINT) AS quantity, round(avg(returned), 2) AS return_rate,
  round(CAST(sum(CAST(round(profit_margin * 10000) AS BIGINT)) AS DOUBLE) / 10000 / count(*), 2) AS avg_profit_margin FROM tx GROUP BY 1""",
    "category_mix": f"""WITH {TX}, g AS (SELECT category, sum(amt) / 10000.0 AS revenue, count(*) AS orders, avg(returned) * 100 AS rr FROM tx GROUP BY 1)
SELECT category, round(revenue, 6) AS revenue, round(revenue / orders, 6) AS avg_order_value, orders, round(rr, 6) AS return_rate,
  round(revenue * 100 / (SELECT sum(revenue) FROM g), 6) AS revenue_share_pct FROM g""",
    "category_pareto": f"""WITH {TX}, g AS (SELECT category, sum(amt) / 10000.0 AS revenue FROM tx GROUP BY 1),
c AS (SELECT *, row_number() OVER (ORDER BY revenue DESC, category) AS rank,
  sum(revenue) OVER (ORDER BY revenue DESC, category ROWS UNBOUNDED PRECEDING) / (SELECT sum(revenue) FROM g) * 100 AS cum FROM g)
SELECT category, round(revenue, 6) AS revenue, CAST(rank AS INTEGER) AS rank, round(cum, 6) AS cumulative_pct,
  CAST((SELECT min(rank) FROM c WHERE cum >= 80) AS INTEGER) AS categories_for_threshold FROM c""",
    "region_perf": f"""WITH {TX}, g AS (SELECT region, sum(amt) AS u, avg(returned) AS rr, count(DISTINCT customer_id) AS customers, count(*) AS orders FROM tx GROUP BY 1)
SELECT region, ((u + 50) // 100) / 100.0 AS revenue, round(rr, 2) AS return_rate, customers, orders,
  round(u / 10000.0 / orders, 2) AS aov, round(u / 10000.0 / customers, 2) AS revenue_per_customer FROM g""",
    "payment_perf": f"""WITH {TX}, g AS (SELECT payment_method, sum(amt) AS u, avg(returned) AS rr, count(*) AS orders FROM tx GROUP BY 1)
SELECT payment_method, ((u + 50) // 100) / 100.0 AS revenue, orders, round(rr, 2) AS return_rate,
  round(u / (SELECT sum(u) FROM g) * 100, 2) AS pct_of_total FROM g""",
    "discount_tiers": f"{_TIERS} SELECT tier_order, tier_order || '%' AS discount_tier, revenue, orders, quantity, avg_profit_margin FROM t",
    "discount_customers": f"""WITH {TX}, p AS (
  SELECT customer_id, CAST(max(CASE WHEN discount > 0 THEN 1 ELSE 0 END) AS INTEGER) AS d, count(*) AS o, sum(amt) / 10000.0 AS r FROM tx GROUP BY 1),
k AS (SELECT d, o, rank() OVER (ORDER BY o) + (count(*) OVER (PARTITION BY o) - 1) / 2.0 AS rk FROM p),
u AS (SELECT sum(rk) FILTER (WHERE d = 1) - count(*) FILTER (WHERE d = 1) * (count(*) FILTER (WHERE d = 1) + 1) / 2.0 AS u FROM k),
a AS (SELECT count(*) FILTER (WHERE d = 1) AS n1, count(*) FILTER (WHERE d = 0) AS n0,
  avg(o) FILTER (WHERE d = 1) AS o1, avg(o) FILTER (WHERE d = 0) AS o0,
  quantile_cont(CAST(o AS DOUBLE), 0.5) FILTER (WHERE d = 1) AS m1, quantile_cont(CAST(o AS DOUBLE), 0.5) FILTER (WHERE d = 0) AS m0,
  avg(r) FILTER (WHERE d = 1) AS r1, avg(r) FILTER (WHERE d = 0) AS r0 FROM p)
SELECT n1 AS n_discount_customers, n0 AS n_no_discount_customers, round(o1, 4) AS avg_orders_discount, round(o0, 4) AS avg_orders_no_discount,
  round(m1, 4) AS median_orders_discount, round(m0, 4) AS median_orders_no_discount, round(r1, 4) AS avg_revenue_discount_customer,
  round(r0, 4) AS avg_revenue_no_discount_customer,
  CASE WHEN m0 > 0 THEN round((m1 / m0 - 1) * 100, 4) ELSE 0.0 END AS frequency_lift_pct,
  CASE WHEN r0 > 0 THEN round((r1 / r0 - 1) * 100, 4) ELSE 0.0 END AS revenue_per_customer_lift_pct, round(u, 4) AS u_statistic FROM a, u""",
    "discount_summary": f"""{_TIERS} SELECT count(*) AS total_levels, round(coalesce(sum(revenue) FILTER (WHERE tier_order = 0), 0), 4) AS no_discount_revenue,
  round(coalesce(sum(revenue) FILTER (WHERE tier_order > 0), 0), 4) AS discounted_revenue,
  coalesce(max(avg_profit_margin) FILTER (WHERE tier_order = 0), 0) AS avg_margin_no_discount, round(sum(revenue), 4) AS total_revenue,
  round(coalesce(sum(revenue) FILTER (WHERE tier_order > 0), 0) * 100 / sum(revenue), 4) AS discount_pct_of_total FROM t""",
    "value_counts": f"WITH {TX} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS rows FROM tx GROUP BY 2" for c in ("category", "region", "payment_method", "customer_gender")),
    "histogram_amount": f"""WITH {TX}, r AS (SELECT min(total_amount) AS lo, max(total_amount) AS hi, (max(total_amount) - min(total_amount)) / 20 AS w FROM tx),
b AS (SELECT least(CAST(floor((total_amount - lo) / w) AS BIGINT), 19) AS bin, lo, w FROM tx, r)
SELECT bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, count(*) AS rows FROM b GROUP BY 1, 2, 3""",
    "box_stats": f"WITH {TX} " + " UNION ALL ".join(_BOX.format(c=c) for c in ("total_amount", "quantity", "discount", "shipping_cost")),
    "describe_transactions": f"WITH {TX} " + " UNION ALL ".join(_DESC.format(c=c) for c in ("total_amount", "quantity", "discount", "delivery_time_days")),
    "performance_matrix": f"""WITH {TX} SELECT 'category' AS dimension, category AS label, ((sum(amt) + 50) // 100) / 100.0 AS revenue FROM tx GROUP BY 2
UNION ALL SELECT 'region', region, ((sum(amt) + 50) // 100) / 100.0 FROM tx GROUP BY 2""",
    "analysis_kpis": _M + f""", w AS (
  SELECT date_trunc('week', order_date) AS wk FROM tx WHERE returned = 0 AND order_date < DATE '{CUTOFF}' GROUP BY 1)
SELECT 'time_trends' AS section, 'total_months' AS metric, CAST(count(*) AS VARCHAR) AS value FROM yoy
UNION ALL SELECT 'time_trends', 'peak_month', arg_max(year_month, total_amount) FROM yoy
UNION ALL SELECT 'discount', 'total_levels', CAST(count(DISTINCT CAST(round(discount * 100) AS INTEGER)) AS VARCHAR) FROM tx
UNION ALL SELECT 'trend', 'n_weeks', CAST(count(*) AS VARCHAR) FROM w
UNION ALL SELECT 'trend', 'basis', 'rolling'""",
}
