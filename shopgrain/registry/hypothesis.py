"""Hypothesis tests: the statistics have SQL counterparts, p-values are covered by unit tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hypothesis as op
from ..operators import cohorts, sales
from ..operators.customers import customer_features
from ..sources.tables import transactions
from .base import CFG, CRITICAL, CUST, CUTOFF, TX, rounded
from .segments import SEG


def _tx(s, d, *cols):
    return transactions(s, d, cols)


def _seg(s, d):
    from ..operators.segments import rfm_scores, rfm_segments

    return rfm_segments(rfm_scores(customer_features(transactions(s, d), CFG)))


def _monthly(s, d):
    m = sales.monthly_sales(sales.complete_months(_tx(s, d, "order_date", "customer_id", "total_amount"), CFG))
    return m.withColumn("month_no", F.year("month") * 12 + F.month("month"))


def _disc(s, d):
    return _tx(s, d, "discount", "total_amount").withColumn("discounted", (F.col("discount") > 0).cast("int"))


def _suite(s, d):
    """The sales validation suite: four tests as rows, with p-values."""
    tx = transactions(s, d, ["category", "region", "total_amount", "discount"])
    rows = [
        op.spearman(_monthly(s, d), "month_no", "total_amount").select(F.lit("time_trend").alias("test"), F.col("rho").alias("statistic"), "p_value"),
        op.kruskal_wallis(tx, "total_amount", "category").select(F.lit("category").alias("test"), "statistic", "p_value"),
        op.kruskal_wallis(tx, "total_amount", "region").select(F.lit("regional").alias("test"), "statistic", "p_value"),
        op.mann_whitney(_disc(s, d), "total_amount", "discounted").select(F.lit("discount").alias("test"), F.col("u_statistic").alias("statistic"), "p_value"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("significant", F.col("p_value") < CFG.quality.alpha)


def _month1(s, d):
    return cohorts.month1_counts(cohorts.cohort_cells(_tx(s, d, "customer_id", "order_date", "total_amount", "returned"), CFG))


_CORR = ["total_amount", "quantity", "price", "shipping_cost", "profit_margin"]
_DIST = ["recency_days", "frequency", "monetary"]

QUERIES = {
    "spearman_trend": lambda s, d: rounded(op.spearman(_monthly(s, d), "month_no", "total_amount", p_value=False)),
    "kruskal_category": lambda s, d: rounded(op.kruskal_wallis(_tx(s, d, "category", "total_amount"), "total_amount", "category", p_value=False), 5),
    "kruskal_region": lambda s, d: rounded(op.kruskal_wallis(_tx(s, d, "region", "total_amount"), "total_amount", "region", p_value=False), 5),
    "region_pairs": lambda s, d: op.pairwise_mann_whitney(_tx(s, d, "region", "total_amount"), "total_amount", "region").select("group_a", "group_b", "n_a", "n_b", "u_statistic"),
    "rank_sums_category": lambda s, d: op.rank_sums(_tx(s, d, "category", "total_amount"), "total_amount", "category").select("category", "n", "rank_sum", "total_n"),
    "mannwhitney_discount": lambda s, d: rounded(op.mann_whitney(_disc(s, d), "total_amount", "discounted", p_value=False)),
    "discount_median_contrast": lambda s, d: rounded(op.median_contrast(_disc(s, d), "total_amount", "discounted")),
    "chi2_category_return": lambda s, d: rounded(op.chi_square(_tx(s, d, "category", "returned"), "category", "returned", p_value=False)),
    "anova_segments": lambda s, d: rounded(op.anova(_seg(s, d), "monetary", "rfm_segment", p_value=False).select("groups", "n_observations", "statistic", "eta_squared"), 5),
    "kruskal_segments": lambda s, d: rounded(op.kruskal_wallis(_seg(s, d), "monetary", "rfm_segment", p_value=False), 5),
    "cohens_d_segments": lambda s, d: rounded(op.cohens_d(_seg(s, d), "recency_days", "rfm_segment", "Champions", "Hibernating").select("cohens_d")),
    "levene": lambda s, d: rounded(op.levene(_seg(s, d), "recency_days", "rfm_segment", p_value=False), 5),
    "dunn": lambda s, d: rounded(op.dunn(_seg(s, d), "monetary", "rfm_segment", p_value=False)),
    "correlation_pairs": lambda s, d: rounded(op.correlation_pairs(_tx(s, d, *_CORR), _CORR)),
    "correlation_matrix": lambda s, d: rounded(op.correlation_matrix(_tx(s, d, *_CORR), _CORR)),
    "distribution_profile": lambda s, d: rounded(op.distribution_profile(customer_features(transactions(s, d), CFG), _DIST), 6),
    "distribution_insights": lambda s, d: rounded(op.distribution_insight_flags(
        op.distribution_profile(customer_features(transactions(s, d), CFG), _DIST + ["loyalty_score"])), 4),
    "cohort_pairs_p": lambda s, d: rounded(op.two_proportion_pairs(_month1(s, d), "cohort_month", "retained", "cohort_size").select("label_a", "label_b", "z", "significant")),
    "region_pairs_p": lambda s, d: op.pairwise_mann_whitney(_tx(s, d, "region", "total_amount"), "total_amount", "region").select("group_a", "group_b", "u_statistic", "significant"),
    "jarque_bera": lambda s, d: rounded(op.jarque_bera(_tx(s, d, "total_amount", "quantity"), ["total_amount", "quantity"], p_value=False), 4),
    "flag_agreement": lambda s, d: rounded(op.flag_agreement(
        customer_features(transactions(s, d), CFG).select("churn", "last_order_was_return"), "churn", "last_order_was_return")),
    "validation_suite": _suite,
    "missingness_mechanism": lambda s, d: op.missingness_mechanism(
        _tx(s, d, "product_id", "total_amount", "quantity", "price", "discount").withColumn(
            "total_amount", F.when(F.col("quantity") < 10, F.lit(None)).otherwise(F.col("total_amount"))),
        "total_amount", ["quantity", "price", "discount"]),
}


def _ranked(value, group, src):
    return f"""rk AS (SELECT {group} AS g, {value} AS v, rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0 AS r FROM {src}),
ti AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM rk GROUP BY v)),
gs AS (SELECT g, count(*) AS n, sum(r) AS rs FROM rk GROUP BY 1), nn AS (SELECT count(*)::DOUBLE AS nt FROM rk)"""


_KW = """, kw AS (SELECT count(*) AS k, (12.0 / (nt * (nt + 1)) * sum(rs * rs / n) - 3 * (nt + 1)) / (1 - t / (nt * nt * nt - nt)) AS h, nt FROM gs, nn, ti GROUP BY nt, t)
SELECT k AS groups, CAST(nt AS BIGINT) AS n_observations, round(h, 5) AS statistic, round((h - k + 1) / (nt - k), 5) AS effect_size,
  CASE WHEN (h - k + 1) / (nt - k) > 0.14 THEN 'large' WHEN (h - k + 1) / (nt - k) > 0.06 THEN 'medium' ELSE 'small' END AS effect_strength FROM kw"""
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1:]]
_BAND = "CASE WHEN abs(r) > 0.9 THEN 'Very strong' WHEN abs(r) > 0.7 THEN 'Strong' WHEN abs(r) > 0.5 THEN 'Moderate' WHEN abs(r) > 0.3 THEN 'Weak' ELSE 'Very weak' END"


def _dist(c):
    return f"""SELECT '{c}' AS column_name, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, avg(pow({c} - mu, 3)) / pow(avg(pow({c} - mu, 2)), 1.5) AS skewness,
  avg(pow({c} - mu, 4)) / pow(avg(pow({c} - mu, 2)), 2) - 3 AS kurtosis, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
  quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, quantile_cont(CAST({c} AS DOUBLE), 0.9) AS q90
  FROM cust, (SELECT avg({c}) AS mu FROM cust)"""


def _jb(c):
    return f"""SELECT '{c}' AS column_name, count(*) AS n, avg(pow({c} - mu, 3)) / pow(avg(pow({c} - mu, 2)), 1.5) AS s, avg(pow({c} - mu, 4)) / pow(avg(pow({c} - mu, 2)), 2) - 3 AS k
  FROM tx, (SELECT avg({c}) AS mu FROM tx)"""


_DISC = f"WITH {TX}, dd AS (SELECT total_amount, CAST(discount > 0 AS INTEGER) AS discounted FROM tx)"
_AN = """, an AS (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM src GROUP BY 1),
f AS (SELECT count(*) AS k, sum(n) AS nt, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b, sum((n - 1) * coalesce(s, 0)) AS w FROM an)"""

ORACLES = {
    "spearman_trend": f"""WITH {TX}, m AS (SELECT date_trunc('month', order_date) AS month, sum(amt) AS v FROM tx WHERE order_date < DATE '{CUTOFF}' GROUP BY 1),
r AS (SELECT rank() OVER (ORDER BY month)::DOUBLE AS a, rank() OVER (ORDER BY v)::DOUBLE AS b FROM m), c AS (SELECT count(*) AS n, corr(a, b) AS rho FROM r)
SELECT n, round(rho, 6) AS rho, CASE WHEN abs(rho) > 0.7 THEN 'strong' WHEN abs(rho) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN rho > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM c""",
    "kruskal_category": f"WITH {TX}, {_ranked('total_amount', 'category', 'tx')}{_KW}",
    "kruskal_region": f"WITH {TX}, {_ranked('total_amount', 'region', 'tx')}{_KW}",
    "region_pairs": f"""WITH {TX}, pr AS (SELECT a.r AS ga, b.r AS gb FROM (SELECT DISTINCT region AS r FROM tx) a JOIN (SELECT DISTINCT region AS r FROM tx) b ON a.r < b.r),
x AS (SELECT ga, gb, region, total_amount AS v FROM pr JOIN tx ON region = ga OR region = gb),
k AS (SELECT *, rank() OVER (PARTITION BY ga, gb ORDER BY v) + (count(*) OVER (PARTITION BY ga, gb, v) - 1) / 2.0 AS r FROM x)
SELECT ga AS group_a, gb AS group_b, count(*) FILTER (WHERE region = ga) AS n_a, count(*) FILTER (WHERE region = gb) AS n_b,
  sum(r) FILTER (WHERE region = ga) - count(*) FILTER (WHERE region = ga) * (count(*) FILTER (WHERE region = ga) + 1) / 2.0 AS u_statistic FROM k GROUP BY 1, 2""",
    "region_pairs_p": f"""WITH {TX}, pr AS (SELECT a.r AS ga, b.r AS gb FROM (SELECT DISTINCT region AS r FROM tx) a JOIN (SELECT DISTINCT region AS r FROM tx) b ON a.r < b.r),
x AS (SELECT ga, gb, region, total_amount AS v FROM pr JOIN tx ON region = ga OR region = gb),
k AS (SELECT *, rank() OVER (PARTITION BY ga, gb ORDER BY v) + (count(*) OVER (PARTITION BY ga, gb, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY ga, gb, v)::DOUBLE AS c FROM x),
u AS (SELECT ga, gb, (count(*) FILTER (WHERE region = ga))::DOUBLE AS a, (count(*) FILTER (WHERE region = gb))::DOUBLE AS b, sum(r) FILTER (WHERE region = ga) AS s, sum(c * c - 1) AS t FROM k GROUP BY 1, 2),
z AS (SELECT ga, gb, s - a * (a + 1) / 2.0 AS u, (abs(s - a * (a + 1) / 2.0 - a * b / 2) - 0.5) / sqrt(a * b / 12 * (a + b + 1 - t / ((a + b) * (a + b - 1)))) AS z, CAST(count(*) OVER () AS INTEGER) AS pairs FROM u)
SELECT ga AS group_a, gb AS group_b, u AS u_statistic, z > critical AS significant FROM z JOIN ({CRITICAL}) USING (pairs)""",
    "rank_sums_category": f"WITH {TX}, {_ranked('total_amount', 'category', 'tx')} SELECT g AS category, n, CAST(rs AS DOUBLE) AS rank_sum, CAST(nt AS BIGINT) AS total_n FROM gs, nn",
    "mannwhitney_discount": f"""{_DISC}, {_ranked('total_amount', 'discounted', 'dd')},
w AS (SELECT max(n) FILTER (WHERE g = 1) AS a, max(n) FILTER (WHERE g = 0) AS b, max(rs) FILTER (WHERE g = 1) AS r FROM gs),
u AS (SELECT a, b, r - a * (a + 1) / 2.0 AS u, t, nt FROM w, ti, nn)
SELECT a AS n_1, b AS n_0, u AS u_statistic, round(1 - 2 * u / (a * b), 6) AS rank_biserial, round((abs(u - a * b / 2) - 0.5) / sqrt(a * b / 12 * (nt + 1 - t / (nt * (nt - 1)))), 6) AS z FROM u""",
    "discount_median_contrast": f"""{_DISC}, q AS (SELECT quantile_cont(total_amount, 0.5) FILTER (WHERE discounted = 1) AS a, quantile_cont(total_amount, 0.5) FILTER (WHERE discounted = 0) AS b FROM dd)
SELECT round(a, 6) AS median_1, round(b, 6) AS median_0, round(a - b, 6) AS difference, round((a - b) / b * 100, 6) AS pct_difference FROM q""",
    "chi2_category_return": f"""WITH {TX}, o AS (SELECT category AS a, returned AS b, count(*) AS n FROM tx GROUP BY 1, 2), e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS x FROM o),
c AS (SELECT sum((n - x) * (n - x) / x) AS chi2, sum(n) AS nt, (SELECT count(DISTINCT a) FROM o) AS ka, (SELECT count(DISTINCT b) FROM o) AS kb FROM e), v AS (SELECT *, sqrt(chi2 / (nt * (least(ka, kb) - 1))) AS v FROM c)
SELECT CAST(nt AS BIGINT) AS n_observations, round(chi2, 6) AS chi2, (ka - 1) * (kb - 1) AS dof, round(v, 6) AS cramers_v,
  CASE WHEN v < 0.1 THEN 'negligible' WHEN v < 0.2 THEN 'weak' WHEN v < 0.4 THEN 'moderate' ELSE 'strong' END AS association FROM v""",
    "anova_segments": f"""WITH {SEG}, src AS (SELECT rfm_segment AS g, monetary AS v FROM seg WHERE monetary IS NOT NULL){_AN}
SELECT k AS groups, CAST(nt AS BIGINT) AS n_observations, round((b / (k - 1)) / (w / (nt - k)), 5) AS statistic, round(b / (b + w), 5) AS eta_squared FROM f""",
    "kruskal_segments": f"WITH {SEG}, s2 AS (SELECT * FROM seg WHERE monetary IS NOT NULL), {_ranked('monetary', 'rfm_segment', 's2')}{_KW}",
    "cohens_d_segments": f"""WITH {SEG}, a AS (SELECT count(*) AS n, avg(recency_days) AS m, var_samp(recency_days) AS s FROM seg WHERE rfm_segment = 'Champions'),
b AS (SELECT count(*) AS n, avg(recency_days) AS m, var_samp(recency_days) AS s FROM seg WHERE rfm_segment = 'Hibernating')
SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2)), 6) AS cohens_d FROM a, b""",
    "levene": f"""WITH {SEG}, md AS (SELECT rfm_segment, quantile_cont(CAST(recency_days AS DOUBLE), 0.5) AS md FROM seg GROUP BY 1),
src AS (SELECT rfm_segment AS g, abs(recency_days - md) AS v FROM seg JOIN md USING (rfm_segment)){_AN}
SELECT round((b / (k - 1)) / (w / (nt - k)), 5) AS w_statistic, k AS groups, CAST(nt AS BIGINT) AS n_observations FROM f""",
    "dunn": f"""WITH {SEG}, s2 AS (SELECT * FROM seg WHERE monetary IS NOT NULL), {_ranked('monetary', 'rfm_segment', 's2')}
SELECT a.g AS group_a, b.g AS group_b, round(abs(a.rs / a.n - b.rs / b.n) / sqrt((nt * (nt + 1) / 12 - t / (12 * (nt - 1))) * (1 / a.n + 1 / b.n)), 6) AS z FROM gs a JOIN gs b ON a.g < b.g, nn, ti""",
    "correlation_pairs": f"WITH {TX}, p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM tx" for a, b in _PAIRS)
    + f") SELECT column_a, column_b, round(r, 6) AS r, {_BAND} AS strength FROM p",
    "correlation_matrix": f"WITH {TX} " + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r FROM tx" for a in _CORR for b in _CORR),
    "distribution_profile": f"WITH {CUST}, p AS (" + " UNION ALL ".join(_dist(c) for c in _DIST) + """)
SELECT column_name, n, round(mean, 6) AS mean, round(std, 6) AS std, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(min, 6) AS min, round(max, 6) AS max,
  round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75, round(q90, 6) AS q90,
  CASE WHEN abs(skewness) < 0.1 THEN 'negligible' WHEN abs(skewness) < 0.5 THEN 'slight' WHEN abs(skewness) < 1 THEN 'moderate' WHEN abs(skewness) < 2 THEN 'strong' ELSE 'extreme' END AS skew_strength,
  CASE WHEN abs(skewness) < 0.1 THEN 'none' WHEN skewness > 0 THEN 'right' ELSE 'left' END AS skew_direction,
  CASE WHEN max = min THEN 'middle' WHEN median < min + (max - min) * 0.33 THEN 'lower' WHEN median > min + (max - min) * 0.67 THEN 'upper' ELSE 'middle' END AS concentration,
  CASE WHEN q75 = q25 THEN 'symmetric' WHEN abs((median - q25) - (q75 - median)) < (q75 - q25) * 0.2 THEN 'symmetric' WHEN median - q25 > q75 - median THEN 'lower_heavy' ELSE 'upper_heavy' END AS symmetry FROM p""",
    "jarque_bera": f"WITH {TX}, p AS ({_jb('total_amount')} UNION ALL {_jb('quantity')}) SELECT column_name, n, round(s, 4) AS skewness, round(k, 4) AS kurtosis, round(n / 6.0 * (s * s + k * k / 4), 4) AS jarque_bera FROM p",
    "flag_agreement": f"""WITH {CUST}, t AS (SELECT count(*) FILTER (WHERE churn = 1 AND last_order_was_return = 1) AS a, count(*) FILTER (WHERE churn = 1 AND last_order_was_return = 0) AS b,
  count(*) FILTER (WHERE churn = 0 AND last_order_was_return = 1) AS c, count(*) FILTER (WHERE churn = 0 AND last_order_was_return = 0) AS d, count(*) AS n FROM cust),
k AS (SELECT *, (a + d) / n AS o, (a + b) / n * ((a + c) / n) + (1 - (a + b) / n) * (1 - (a + c) / n) AS e FROM t)
SELECT a AS both, b AS only_a, c AS only_b, d AS neither, n, round(o, 6) AS observed, round(e, 6) AS expected, round((o - e) / (1 - e), 6) AS kappa,
  CASE WHEN (o - e) / (1 - e) < 0.2 THEN 'slight' WHEN (o - e) / (1 - e) < 0.4 THEN 'fair' WHEN (o - e) / (1 - e) < 0.6 THEN 'moderate' WHEN (o - e) / (1 - e) < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS agreement FROM k""",
}

_INSIGHTS = [
    ("recency_days", "many_inactive", "skewness >= 0.1 AND skewness >= 0.5", "skewness"), ("recency_days", "mostly_recent", "skewness <= -0.1", "skewness"),
    ("recency_days", "mean_above_median", "mean / median > 1.2", "mean / median"), ("recency_days", "mean_below_median", "mean / median < 0.8", "mean / median"),
    ("recency_days", "quarter_beyond_120_days", "q75 > 120", "q75"), ("frequency", "moderate_concentration", "abs(skewness) >= 0.5 AND abs(skewness) < 1", "skewness"),
    ("frequency", "strong_concentration", "skewness >= 1", "skewness"), ("frequency", "quarter_with_5_orders", "q75 >= 5", "q75"),
    ("frequency", "quarter_with_3_orders", "q75 >= 3 AND q75 < 5", "q75"), ("frequency", "quarter_with_2_or_fewer", "q25 <= 2", "q25"),
    ("monetary", "revenue_concentrated", "skewness >= 1", "skewness"), ("monetary", "mean_over_3_medians", "mean / median > 3", "mean / median"),
    ("monetary", "top_decile_over_5_medians", "q90 / median > 5", "q90 / median"), ("monetary", "top_quarter_over_2_medians", "q75 / median > 2", "q75 / median"),
    ("loyalty_score", "strong_core", "q75 >= 0.7", "q75"), ("loyalty_score", "weak_bottom", "q25 <= 0.3", "q25"), ("loyalty_score", "weak_baseline", "median < 0.4", "median"),
    ("loyalty_score", "moderate_baseline", "median >= 0.4 AND median < 0.6", "median"), ("loyalty_score", "strong_baseline", "median >= 0.6", "median"),
    ("loyalty_score", "balanced", "abs(skewness) < 0.5", "skewness"),
]
ORACLES["distribution_insights"] = f"WITH {CUST}, p AS (" + " UNION ALL ".join(_dist(c) for c in _DIST + ["loyalty_score"]) + ") " + " UNION ALL ".join(
    f"SELECT column_name, '{r}' AS rule_id, {f} AS fired, round({m}, 4) AS metric FROM p WHERE column_name = '{c}'" for c, r, f, m in _INSIGHTS)
