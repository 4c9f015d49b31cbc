"""Cohort queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts as op
from ..operators import hypothesis, quality
from ..operators.customers import customer_features
from ..operators.segments import loyalty_tiers
from ..sources.tables import transactions
from .base import CFG, CRITICAL, CUST, CUTOFF, TX, rounded

_COLS = ["customer_id", "order_date", "total_amount", "returned"]


def _tx(s, d):
    return transactions(s, d, _COLS)


def _cells(s, d):
    return op.cohort_cells(_tx(s, d), CFG)


def _first(s, d):
    return op.first_category(transactions(s, d, ["customer_id", "order_id", "order_date", "category", "returned"]))


def _tiers(s, d):
    return loyalty_tiers(customer_features(transactions(s, d), CFG), CFG)


QUERIES = {
    "assign_cohorts": lambda s, d: op.assign_cohorts(transactions(s, d, ["order_id", "customer_id", "order_date", "returned"])),
    "cohort_sizes": lambda s, d: op.cohort_sizes(_tx(s, d)),
    "low_n_cohorts": lambda s, d: op.low_n_cohorts(op.cohort_sizes(_tx(s, d)), CFG),
    "cohort_cells": lambda s, d: rounded(_cells(s, d), exact=("ltv",)),
    "activity_matrix": lambda s, d: _cells(s, d).select("cohort_month", "period_offset", "active"),
    "retention": lambda s, d: rounded(_cells(s, d).select("cohort_month", "period_offset", "retention")),
    "cumulative_ltv": lambda s, d: _cells(s, d).select("cohort_month", "period_offset", "ltv"),
    "agg_retention": lambda s, d: rounded(op.aggregate_retention(_cells(s, d))),
    "dropout": lambda s, d: rounded(op.dropout_rates(op.aggregate_retention(_cells(s, d)))),
    "revenue_retention": lambda s, d: rounded(op.revenue_retention(_cells(s, d))),
    "aov_by_period": lambda s, d: rounded(op.aov_by_period(_cells(s, d)), 4, exact=("aov",)),
    "ltv_benchmarks": lambda s, d: rounded(op.ltv_benchmarks(_cells(s, d), CFG.cohort.benchmark_windows), 4),
    "ltv_projection": lambda s, d: op.ltv_projection(_cells(s, d), 75),
    "segment_retention": lambda s, d: op.segment_retention(_tx(s, d), _tiers(s, d), "loyalty_tier", CFG),
    "segment_ltv": lambda s, d: op.segment_ltv(_tx(s, d), _tiers(s, d), "loyalty_tier", CFG.cohort.segment_windows, CFG),
    "first_category": lambda s, d: _first(s, d),
    "first_category_retention": lambda s, d: op.segment_retention(_tx(s, d), _first(s, d), "first_category", CFG),
    "first_category_ltv": lambda s, d: op.segment_ltv(_tx(s, d), _first(s, d), "first_category", CFG.cohort.segment_windows, CFG),
    "cohort_outliers": lambda s, d: rounded(op.retention_outliers(_cells(s, d), CFG)),
    "cohort_stability": lambda s, d: rounded(op.retention_stability(_cells(s, d))),
    "cohort_summary": lambda s, d: rounded(op.cohort_summary(_cells(s, d)), 4, exact=("ltv_3m", "ltv_6m", "ltv_12m")),
    "acquisition_stats": lambda s, d: op.acquisition_stats(op.cohort_sizes(_tx(s, d))),
    "retention_assessment": lambda s, d: rounded(op.retention_assessment(_cells(s, d), CFG)),
    "uplift_scenarios": lambda s, d: rounded(op.uplift_scenarios(_cells(s, d), CFG), 4),
    "cohort_chi_square": lambda s, d: rounded(op.cohort_chi_square(_cells(s, d))),
    "cohort_pairs": lambda s, d: rounded(hypothesis.two_proportion_pairs(
        op.month1_counts(_cells(s, d)), "cohort_month", "retained", "cohort_size", p_value=False)),
    "cohort_insight_flags": lambda s, d: rounded(op.cohort_insight_flags(_cells(s, d), cfg=CFG), 4),
    "cohort_output_checks": lambda s, d: quality.cohort_output_checks(_cells(s, d), CFG),
}

_G = f"""{TX},
first_m AS (SELECT customer_id, CAST(date_trunc('month', min(order_date)) AS DATE) AS cohort_month FROM tx WHERE returned = 0 GROUP BY 1),
sizes AS (SELECT cohort_month, count(*) AS cohort_size FROM first_m GROUP BY 1),
co AS (SELECT tx.*, cohort_month, CAST(date_trunc('month', order_date) AS DATE) AS order_month,
  CAST(greatest((year(order_date) - year(cohort_month)) * 12 + month(order_date) - month(cohort_month), 0) AS INTEGER) AS period_offset
  FROM tx JOIN first_m USING (customer_id)),
act AS (SELECT * FROM co WHERE returned = 0 AND order_month < DATE '{CUTOFF}'),
seen AS (SELECT cohort_month, period_offset, count(DISTINCT customer_id) AS active, sum(amt) / 10000.0 AS revenue, sum(amt) AS ru FROM act GROUP BY 1, 2),
offs AS (SELECT DISTINCT period_offset FROM seen UNION SELECT 0),
cohs AS (SELECT DISTINCT cohort_month FROM seen),
grid AS (SELECT cohort_month, period_offset, cohort_month + to_months(period_offset) >= DATE '{CUTOFF}' AS closed FROM cohs, offs),
cell0 AS (SELECT g.cohort_month, g.period_offset, cohort_size, coalesce(active, 0) AS active,
  CASE WHEN g.period_offset = 0 THEN 1.0 WHEN closed THEN NULL ELSE coalesce(active, 0) / cohort_size END AS retention,
  CASE WHEN NOT closed THEN coalesce(revenue, 0) END AS revenue, coalesce(ru, 0) AS ru
  FROM grid g LEFT JOIN seen s ON g.cohort_month = s.cohort_month AND g.period_offset = s.period_offset JOIN sizes z ON z.cohort_month = g.cohort_month),
cells AS (SELECT *, CASE WHEN revenue IS NOT NULL THEN
  CAST(sum(ru) OVER (PARTITION BY cohort_month ORDER BY period_offset ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 10000 / cohort_size END AS ltv FROM cell0)"""

_AGG = """, agg AS (SELECT period_offset, sum(retention * cohort_size) / sum(cohort_size) FILTER (WHERE retention IS NOT NULL) AS retention,
  count(retention) AS cohorts FROM cells GROUP BY 1 HAVING count(retention) > 0),
rr AS (SELECT *, revenue / nullif(max(revenue) FILTER (WHERE period_offset = 0) OVER (PARTITION BY cohort_month), 0) AS revenue_rate FROM cells),
rev AS (SELECT period_offset, sum(revenue_rate * cohort_size) / sum(cohort_size) AS revenue_retention, count(*) AS cohorts FROM rr WHERE revenue_rate IS NOT NULL GROUP BY 1),
drp AS (SELECT period_offset, CASE WHEN lag(retention) OVER (ORDER BY period_offset) IS NOT NULL THEN greatest((lag(retention) OVER (ORDER BY period_offset) - retention) / lag(retention) OVER (ORDER BY period_offset), 0) END AS dropout_rate FROM agg),
bench AS (SELECT period_offset, avg(ltv) AS ltv FROM cells GROUP BY 1 HAVING avg(ltv) IS NOT NULL)"""

_BENCH = "SELECT {w} AS window_months, (SELECT ltv FROM bench WHERE period_offset <= {w} ORDER BY period_offset DESC LIMIT 1) AS ltv"

_TIER = CUST + """, edges AS (SELECT quantile_cont(loyalty_score, [0, 0.25, 0.5, 0.75, 1]) AS e FROM cust),
lab AS (SELECT customer_id, CASE WHEN loyalty_score <= e[2] THEN 'Bronze' WHEN loyalty_score <= e[3] THEN 'Silver'
  WHEN loyalty_score <= e[4] THEN 'Gold' WHEN loyalty_score <= e[5] THEN 'Platinum' END AS loyalty_tier FROM cust, edges)"""
_FIRST = """, lab AS (SELECT customer_id, arg_min(category, (order_date, order_id)) AS first_category FROM tx WHERE returned = 0 GROUP BY 1)"""


def _seg_ret(prefix, col):
    return f"""WITH {prefix}, m AS (SELECT {col}, period_offset, count(DISTINCT customer_id) AS active FROM act JOIN lab USING (customer_id) WHERE {col} IS NOT NULL GROUP BY 1, 2),
a AS (SELECT {col}, active AS acquired FROM m WHERE period_offset = 0)
SELECT {col}, period_offset, active, acquired, round(active / acquired, 6) AS retention FROM m JOIN a USING ({col})"""


def _seg_ltv(prefix, col):
    return f"""WITH {prefix}, m AS (SELECT * FROM act JOIN lab USING (customer_id) WHERE {col} IS NOT NULL),
a AS (SELECT {col}, count(DISTINCT customer_id) FILTER (WHERE period_offset = 0) AS acquired FROM m GROUP BY 1),
w AS (SELECT CAST(unnest([3, 6, 12]) AS INTEGER) AS window_months)
SELECT {col}, acquired, window_months, round(sum(amt) / 10000.0 / acquired, 4) AS ltv FROM m JOIN a USING ({col}) JOIN w ON period_offset <= window_months GROUP BY 1, 2, 3"""


_G_TIER = _TIER + _G[len(TX):]
_G_FIRST = _G + _FIRST

ORACLES = {
    "assign_cohorts": f"WITH {_G} SELECT customer_id, order_id, order_date, returned, cohort_month, order_month, period_offset FROM co",
    "cohort_sizes": f"WITH {_G} SELECT * FROM sizes",
    "low_n_cohorts": f"WITH {_G} SELECT * FROM sizes WHERE cohort_size < 30",
    "cohort_cells": f"WITH {_G} SELECT cohort_month, period_offset, cohort_size, active, round(retention, 6) AS retention, round(revenue, 6) AS revenue, ltv FROM cells",
    "activity_matrix": f"WITH {_G} SELECT cohort_month, period_offset, active FROM cells",
    "retention": f"WITH {_G} SELECT cohort_month, period_offset, round(retention, 6) AS retention FROM cells",
    "cumulative_ltv": f"WITH {_G} SELECT cohort_month, period_offset, ltv FROM cells",
    "agg_retention": f"WITH {_G}{_AGG} SELECT period_offset, round(retention, 6) AS retention, cohorts, round(retention - lag(retention) OVER (ORDER BY period_offset), 6) AS delta FROM agg",
    "dropout": f"WITH {_G}{_AGG} SELECT period_offset, round(dropout_rate, 6) AS dropout_rate FROM drp WHERE dropout_rate IS NOT NULL",
    "revenue_retention": f"WITH {_G}{_AGG} SELECT period_offset, round(revenue_retention, 6) AS revenue_retention, cohorts FROM rev",
    "aov_by_period": f"""WITH {_G} SELECT period_offset, CAST(sum(ru) AS DOUBLE) / 10000 / sum(active) AS aov,
  round(sum(revenue), 4) AS revenue, CAST(sum(active) AS BIGINT) AS active FROM cells GROUP BY 1 HAVING sum(active) > 0""",
    "ltv_benchmarks": f"WITH {_G}{_AGG}, b AS (" + " UNION ALL ".join(_BENCH.format(w=w) for w in (1, 3, 6, 12)) + ") SELECT window_months, round(ltv, 4) AS ltv FROM b",
    "ltv_projection": f"""WITH {_G}, l AS (SELECT cohort_month, period_offset, ltv, row_number() OVER (PARTITION BY cohort_month ORDER BY period_offset DESC) AS b FROM cells WHERE ltv IS NOT NULL),
f AS (SELECT cohort_month, count(*) AS n, max(period_offset) AS last_offset, regr_slope(ltv, period_offset) AS s, regr_intercept(ltv, period_offset) AS i FROM l WHERE b <= 3 GROUP BY 1)
SELECT cohort_month, last_offset, round(greatest(i + s * 75, 0), 2) AS projected_ltv FROM f WHERE n = 3 AND last_offset < 75""",
    "segment_retention": _seg_ret(_G_TIER, "loyalty_tier"),
    "segment_ltv": _seg_ltv(_G_TIER, "loyalty_tier"),
    "first_category": f"WITH {_G_FIRST} SELECT customer_id, first_category FROM lab",
    "first_category_retention": _seg_ret(_G_FIRST, "first_category"),
    "first_category_ltv": _seg_ltv(_G_FIRST, "first_category"),
    "cohort_outliers": f"""WITH {_G}, p AS (SELECT cohort_month, avg(retention) AS r FROM cells WHERE retention IS NOT NULL GROUP BY 1),
z AS (SELECT cohort_month, r, (r - (SELECT avg(r) FROM p)) / (SELECT stddev_samp(r) FROM p) AS z FROM p)
SELECT cohort_month, round(r, 6) AS mean_retention, round(z, 6) AS z_score, CASE WHEN z > 0 THEN 'Outperformer' ELSE 'Underperformer' END AS direction FROM z WHERE abs(z) >= 1.5""",
    "cohort_stability": f"WITH {_G} SELECT period_offset, round(stddev_samp(retention), 6) AS retention_std, count(retention) AS cohorts FROM cells GROUP BY 1 HAVING count(retention) >= 2",
    "cohort_summary": f"WITH {_G} SELECT cohort_month, max(period_offset) FILTER (WHERE retention IS NOT NULL) AS max_period_observed, "
    + ", ".join(f"round(max(retention) FILTER (WHERE period_offset = {k}), 4) AS m{k}_retention" for k in (1, 3, 6)) + ", round(sum(revenue), 4) AS total_revenue, "
    + ", ".join(f"max(ltv) FILTER (WHERE period_offset = {k}) AS ltv_{k}m" for k in (3, 6, 12)) + " FROM cells GROUP BY 1",
    "acquisition_stats": f"""WITH {_G}, g AS (SELECT cohort_size, (cohort_size - lag(cohort_size) OVER (ORDER BY cohort_month)) / lag(cohort_size) OVER (ORDER BY cohort_month) AS g FROM sizes),
a AS (SELECT round(avg(g) * 100, 2) AS monthly_growth_pct, round(stddev_samp(cohort_size) / avg(cohort_size), 4) AS cv FROM g)
SELECT *, CASE WHEN monthly_growth_pct > 0 THEN 'Growth' ELSE 'Decline' END AS trend, CASE WHEN cv < 0.3 THEN 'Stable' ELSE 'Volatile' END AS volume FROM a""",
    "retention_assessment": f"""WITH {_G}{_AGG} SELECT period_offset, round(retention, 6) AS retention, round(revenue_retention, 6) AS revenue_retention,
  CASE WHEN retention >= 0.25 THEN 'Healthy' WHEN retention >= 0.25 * 0.6 THEN 'Below benchmark' ELSE 'Critical' END AS assessment, round(revenue_retention - retention, 6) AS spread,
  CASE WHEN revenue_retention - retention > 0.02 THEN 'High-value customers retained' WHEN revenue_retention - retention < -0.02 THEN 'High-value customers churning faster' ELSE 'Proportional churn' END AS churn_kind
FROM agg JOIN rev USING (period_offset)""",
    "uplift_scenarios": f"WITH {_G}{_AGG}, b AS (" + " UNION ALL ".join(_BENCH.format(w=w) for w in (1, 3)) + """), s AS (SELECT avg(cohort_size) AS a FROM cells WHERE period_offset = 0),
i AS (SELECT unnest([0.05, 0.1, 0.15])::DOUBLE AS increment)
SELECT round(increment, 4) AS increment, window_months AS period, round(a, 4) AS avg_cohort_size, round(ltv, 4) AS ltv, round(a * increment * ltv * 12, 4) AS annual_uplift FROM b, s, i""",
    "cohort_chi_square": f"""WITH {_G}, m AS (SELECT cohort_size AS n, active AS k FROM cells WHERE period_offset = 1 AND retention IS NOT NULL),
t AS (SELECT sum(k) / sum(n) AS p FROM m)
SELECT count(*) AS cohorts, CAST(sum(n) AS BIGINT) AS customers, round(max(p), 6) AS pooled_rate,
  round(sum((k - n * p) * (k - n * p) / (n * p) + (k - n * p) * (k - n * p) / (n * (1 - p))), 6) AS chi2, count(*) - 1 AS dof FROM m, t""",
    "cohort_pairs": f"""WITH {_G}, m AS (SELECT cohort_month AS c, cohort_size AS n, active AS k FROM cells WHERE period_offset = 1 AND retention IS NOT NULL),
p AS (SELECT a.c AS label_a, b.c AS label_b, a.k / a.n - b.k / b.n AS d, (a.k + b.k) / (a.n + b.n) AS q, 1 / a.n + 1 / b.n AS f FROM m a JOIN m b ON a.c < b.c)
SELECT label_a, label_b, round(d, 6) AS difference, CASE WHEN q * (1 - q) > 0 THEN round(d / sqrt(q * (1 - q) * f), 6) END AS z FROM p""",
    "cohort_pairs_p": f"""WITH {_G}, m AS (SELECT cohort_month AS c, cohort_size AS n, active AS k FROM cells WHERE period_offset = 1 AND retention IS NOT NULL),
p AS (SELECT a.c AS label_a, b.c AS label_b, a.k / a.n - b.k / b.n AS d, (a.k + b.k) / (a.n + b.n) AS q, 1 / a.n + 1 / b.n AS f FROM m a JOIN m b ON a.c < b.c),
z AS (SELECT label_a, label_b, CASE WHEN q * (1 - q) > 0 THEN d / sqrt(q * (1 - q) * f) END AS z, CAST(count(*) OVER () AS INTEGER) AS pairs FROM p)
SELECT label_a, label_b, round(z, 6) AS z, coalesce(abs(z) > critical, false) AS significant FROM z JOIN ({CRITICAL}) USING (pairs)""",
    "cohort_insight_flags": f"""WITH {_G}{_AGG}, v AS (SELECT (SELECT retention FROM agg WHERE period_offset = 1) AS m1,
  (SELECT max(dropout_rate) FROM drp WHERE period_offset > 0) AS peak,
  (SELECT period_offset FROM drp WHERE period_offset > 0 ORDER BY dropout_rate DESC NULLS LAST, period_offset LIMIT 1) AS peak_at,
  (SELECT avg(revenue_retention - retention) FROM agg JOIN rev USING (period_offset) WHERE period_offset > 0) AS sp,
  (SELECT ltv FROM bench WHERE period_offset <= 12 ORDER BY period_offset DESC LIMIT 1) / (SELECT ltv FROM bench WHERE period_offset <= 3 ORDER BY period_offset DESC LIMIT 1) AS g)
SELECT 'month1_below_benchmark' AS rule_id, m1 - 0.25 < -0.05 AS fired, round(m1, 4) AS metric, 95 AS priority FROM v
UNION ALL SELECT 'month1_meets_benchmark', m1 - 0.25 >= -0.05, round(m1, 4), 20 FROM v
UNION ALL SELECT 'late_dropout_peak', peak_at > 1, round(peak, 4), CASE WHEN peak > 0.4 THEN 85 ELSE 50 END FROM v
UNION ALL SELECT 'high_value_churning_faster', sp < -0.05, round(sp, 4), 88 FROM v
UNION ALL SELECT 'high_value_retained', sp > 0.05, round(sp, 4), 55 FROM v
UNION ALL SELECT 'revenue_churn_proportional', sp BETWEEN -0.05 AND 0.05, round(sp, 4), 22 FROM v
UNION ALL SELECT 'ltv_plateau', g < 1.5, round(g, 4), CASE WHEN g < 1.2 THEN 80 ELSE 52 END FROM v
UNION ALL SELECT 'ltv_growing', g >= 1.5, round(g, 4), 25 FROM v""",
    "cohort_output_checks": f"WITH {_G} " + " UNION ALL ".join(
        f"SELECT '{n}' AS check_name, CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS status, 'error' AS severity, CAST({v} AS DOUBLE) AS observed FROM cells"
        for n, v, ok in [
            *[(n, f"count(*) FILTER (WHERE {c})", f"count(*) FILTER (WHERE {c}) = 0") for n, c in (
                ("keys_present", "cohort_month IS NULL OR period_offset IS NULL"), ("offsets_not_negative", "period_offset < 0"),
                ("month0_retention_is_1", "period_offset = 0 AND coalesce(retention, 0) <> 1"), ("retention_in_unit_range", "retention < 0 OR retention > 1"),
                ("revenue_not_negative", "revenue < 0"), ("ltv_not_negative", "ltv < 0"), ("cohort_sizes_present", "cohort_size IS NULL OR cohort_size <= 0"))],
            ("cohorts_present", "count(DISTINCT cohort_month)", "count(*) > 0"),
        ]),
}
