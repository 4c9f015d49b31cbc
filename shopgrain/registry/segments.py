"""Segmentation queries without model fits."""

from __future__ import annotations

from ..operators import hypothesis, quality, sales, segments as op
from ..operators.customers import customer_features
from ..sources.tables import transactions
from .base import CFG, CUST, rounded


def _cust(s, d):
    return customer_features(transactions(s, d), CFG)


def _seg(s, d):
    return op.rfm_segments(op.rfm_scores(_cust(s, d)))


def _prof(s, d):
    return op.cluster_profiles(_seg(s, d), "rfm_segment", CFG)


_KEYS = ["customer_id", "recency_score", "frequency_score", "monetary_score"]

QUERIES = {
    "rfm_scores": lambda s, d: op.rfm_scores(_cust(s, d)).select(*_KEYS),
    "rfm_segments": lambda s, d: _seg(s, d).select(*_KEYS, "rfm_string", "rfm_segment"),
    "segment_profile": lambda s, d: op.segment_profile(_seg(s, d)),
    "score_distribution": lambda s, d: rounded(op.score_distribution(op.rfm_scores(_cust(s, d)))),
    "score_describe": lambda s, d: rounded(sales.describe(op.rfm_scores(_cust(s, d)), list(op.SCORES))),
    "score_correlation": lambda s, d: rounded(hypothesis.correlation_matrix(op.rfm_scores(_cust(s, d)), list(op.SCORES))),
    "churn_risk_bands": lambda s, d: op.with_churn_risk(_cust(s, d), CFG).select("customer_id", "recency_days", "churn_risk"),
    "churn_risk_distribution": lambda s, d: rounded(op.churn_risk_distribution(_seg(s, d), "rfm_segment", CFG)),
    "loyalty_tiers": lambda s, d: op.loyalty_tiers(_cust(s, d), CFG).select("customer_id", "loyalty_tier"),
    "segment_compare": lambda s, d: rounded(op.segment_comparison(
        transactions(s, d, ["customer_id", "total_amount"]), op.loyalty_tiers(_cust(s, d), CFG), "loyalty_tier"), 4),
    "segment_rfm_means": lambda s, d: rounded(op.segment_rfm_means(_seg(s, d), "rfm_segment"), 4),
    "cluster_profiles": lambda s, d: rounded(_prof(s, d)),
    "segment_names": lambda s, d: op.segment_names(_prof(s, d), "rfm_segment").select("rfm_segment", "segment_name"),
    "segment_insight_flags": lambda s, d: rounded(op.segment_insight_flags(op.segment_names(_prof(s, d), "rfm_segment")), 4),
    "segment_actions": lambda s, d: rounded(op.segment_actions(op.segment_names(_prof(s, d), "rfm_segment")), 4),
    "segmentation_input_checks": lambda s, d: quality.segmentation_input_checks(op.rfm_scores(_cust(s, d))),
}

SEG = CUST + """,
med AS (SELECT quantile_cont(CAST(recency_days AS DOUBLE), 0.5) AS mr, quantile_cont(CAST(frequency AS DOUBLE), 0.5) AS mf, quantile_cont(monetary, 0.5) AS mm FROM cust),
filled AS (SELECT cust.*, coalesce(recency_days, mr) AS r0, coalesce(frequency, mf) AS f0, coalesce(monetary, mm) AS m0, (SELECT count(*) FROM cust) AS nn FROM cust, med),
ranked AS (SELECT *, rank() OVER (ORDER BY r0 DESC) + (count(*) OVER (PARTITION BY r0) - 1) / 2.0 AS rr,
  rank() OVER (ORDER BY f0) + (count(*) OVER (PARTITION BY f0) - 1) / 2.0 AS fr, rank() OVER (ORDER BY m0) + (count(*) OVER (PARTITION BY m0) - 1) / 2.0 AS mr2 FROM filled),
scored AS (SELECT *, CAST(least(greatest(ceil(rr / nn * 5), 1), 5) AS INTEGER) AS recency_score,
  CAST(least(greatest(ceil(fr / nn * 5), 1), 5) AS INTEGER) AS frequency_score, CAST(least(greatest(ceil(mr2 / nn * 5), 1), 5) AS INTEGER) AS monetary_score FROM ranked),
seg AS (SELECT *, recency_score || '' || frequency_score || '' || monetary_score AS rfm_string,
  CASE WHEN recency_score = 5 AND frequency_score = 5 AND monetary_score = 5 THEN 'Champions'
       WHEN frequency_score >= 4 AND monetary_score >= 4 THEN 'Loyal Customers'
       WHEN recency_score >= 4 AND frequency_score >= 3 THEN 'Potential Loyalists'
       WHEN recency_score = 5 AND frequency_score <= 2 THEN 'New Customers'
       WHEN recency_score <= 2 AND (frequency_score >= 3 OR monetary_score >= 3) THEN 'At Risk'
       WHEN recency_score <= 2 AND frequency_score <= 2 AND monetary_score <= 2 THEN 'Hibernating' ELSE 'Others' END AS rfm_segment,
  CASE WHEN recency_days <= 60 THEN 'Active' WHEN recency_days <= 120 THEN 'At Risk' WHEN recency_days <= 180 THEN 'Inactive' ELSE 'Churned' END AS churn_risk FROM scored)"""

TIER_CTE = """, edges AS (SELECT quantile_cont(loyalty_score, [0, 0.25, 0.5, 0.75, 1]) AS e FROM cust),
tier AS (SELECT customer_id, CASE WHEN loyalty_score <= e[2] THEN 'Bronze' WHEN loyalty_score <= e[3] THEN 'Silver'
  WHEN loyalty_score <= e[4] THEN 'Gold' WHEN loyalty_score <= e[5] THEN 'Platinum' END AS loyalty_tier FROM cust, edges)"""

_BAND = "avg(CASE WHEN churn_risk = '{b}' THEN 1 ELSE 0 END) * 100 AS {n}"
_PROF = """, prof0 AS (SELECT rfm_segment, count(*) AS customers, avg(recency_days) AS avg_recency, avg(frequency) AS avg_frequency, avg(monetary) AS avg_monetary,
  sum(CAST(round(monetary * 10000) AS BIGINT)) / 10000.0 AS total_revenue, avg(recency_score) AS avg_recency_score, avg(frequency_score) AS avg_frequency_score,
  avg(monetary_score) AS avg_monetary_score, avg(loyalty_score) AS avg_loyalty, avg(avg_order_value) AS avg_order_value, avg(return_rate) * 100 AS avg_return_rate,
  avg(discount_usage_rate) * 100 AS avg_discount_usage, """ + ", ".join(
    _BAND.format(b=b, n=n) for b, n in (("Active", "active_pct"), ("At Risk", "at_risk_pct"), ("Inactive", "inactive_pct"), ("Churned", "churned_pct"))) + """,
  count(*) * 100.0 / (SELECT count(*) FROM seg) AS share_pct, quantile_cont(CAST(recency_days AS DOUBLE), 0.5) AS median_recency_days,
  quantile_cont(CAST(frequency AS DOUBLE), 0.5) AS median_frequency, quantile_cont(monetary, 0.5) AS median_monetary FROM seg GROUP BY 1),
prof AS (SELECT *, CASE greatest(active_pct, at_risk_pct, inactive_pct, churned_pct) WHEN active_pct THEN 'Active' WHEN at_risk_pct THEN 'At Risk'
  WHEN churned_pct THEN 'Churned' ELSE 'Inactive' END AS dominant_risk FROM prof0)"""
_NAMED = _PROF + """, flagged AS (SELECT *, avg_recency_score AS r, avg_frequency_score AS f, avg_monetary_score AS m,
  dominant_risk IN ('Inactive', 'Churned') OR inactive_pct + churned_pct > 50 AS ina, dominant_risk = 'Churned' OR churned_pct > 50 AS gone,
  avg_monetary * 0.4 + avg_frequency * 200 + (5 - avg_recency / 100) * 100 AS priority FROM prof),
labelled AS (SELECT *, CASE WHEN m >= 4.5 AND (churned_pct > 25 OR at_risk_pct > 35 OR (ina AND m >= 4.8)) THEN 'High-Value at Risk'
  WHEN r >= 4 AND f >= 4 AND m >= 4 AND NOT ina THEN 'Champions' WHEN f >= 3.5 AND m >= 2.5 AND r >= 3 AND NOT ina THEN 'Loyal Customers'
  WHEN m >= 3 AND m < 4.5 AND r <= 2.5 AND ina THEN 'At-Risk' WHEN r >= 4 AND f >= 2.5 AND f < 4 THEN 'Potential Loyalists'
  WHEN r >= 4.5 AND f <= 2 THEN 'New Customers' WHEN r <= 2 AND f <= 2 AND m <= 2 AND gone THEN 'Lost Customers'
  WHEN r <= 2.5 AND f <= 2.5 AND ina THEN 'Hibernating' WHEN r <= 3 AND r > 2 AND ina THEN 'About to Sleep'
  WHEN r >= 3.5 AND m >= 2.5 THEN 'Promising' WHEN r >= 2.5 AND f >= 2 THEN 'Needs Engagement' ELSE 'Regular Customers' END AS nm,
  CASE WHEN m >= 4.5 THEN 'Premium' WHEN f >= 4 THEN 'Frequent' WHEN r >= 4 THEN 'Recent' WHEN r <= 2 THEN 'Dormant' ELSE 'Standard' END AS ql FROM flagged),
k1 AS (SELECT *, row_number() OVER (PARTITION BY nm ORDER BY priority DESC, rfm_segment) AS k FROM labelled),
k2 AS (SELECT *, row_number() OVER (PARTITION BY nm, k > 1, ql ORDER BY priority DESC, rfm_segment) AS j FROM k1),
named AS (SELECT *, CASE WHEN k = 1 THEN nm WHEN j = 1 THEN nm || ' (' || ql || ')' ELSE nm || ' (' || ql || ' ' || j || ')' END AS segment_name,
  total_revenue * 100 / sum(total_revenue) OVER () AS revenue_pct FROM k2)"""

_R = {
    "high_value_at_risk": ("m >= 3.5 AND (gone OR churned_pct > 30)", 10),
    "revenue_disengaging": ("NOT (m >= 3.5 AND (gone OR churned_pct > 30)) AND at_risk_pct + churned_pct > 50 AND revenue_pct > 15", 9),
    "best_customers": ("best", 8), "new_customers": ("NOT best AND fresh", 7), "reliable_base": ("NOT best AND NOT fresh AND base", 6),
    "worth_recovering": ("NOT best AND NOT fresh AND NOT base AND gone AND m >= 3", 5), "frequency_potential": ("f < 3 AND m >= 3", 4),
    "low_recovery_value": ("gone AND m < 3", 3),
}

ORACLES = {
    "rfm_scores": f"WITH {SEG} SELECT {', '.join(_KEYS)} FROM seg",
    "rfm_segments": f"WITH {SEG} SELECT {', '.join(_KEYS)}, rfm_string, rfm_segment FROM seg",
    "segment_profile": f"""WITH {SEG} SELECT rfm_segment, round(avg(recency_days), 2) AS avg_recency, round(avg(frequency), 2) AS avg_frequency,
  round(avg(monetary), 2) AS avg_monetary, round(avg(loyalty_score), 2) AS avg_loyalty, count(*) AS customers FROM seg GROUP BY 1""",
    "score_distribution": f"WITH {SEG} " + " UNION ALL ".join(
        f"SELECT '{c}' AS score_name, {c} AS score, count(*) AS customers, round(count(*) * 100.0 / (SELECT count(*) FROM seg), 6) AS pct FROM seg GROUP BY 2" for c in _KEYS[1:]),
    "score_describe": f"WITH {SEG} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, count(*) - count({c}) AS missing FROM seg" for c in _KEYS[1:]),
    "score_correlation": f"WITH {SEG} " + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r FROM seg" for a in _KEYS[1:] for b in _KEYS[1:]),
    "churn_risk_bands": f"WITH {SEG} SELECT customer_id, recency_days, churn_risk FROM seg",
    "churn_risk_distribution": f"""WITH {SEG}, g AS (SELECT rfm_segment, churn_risk, count(*) AS customers FROM seg GROUP BY 1, 2)
SELECT rfm_segment, churn_risk, customers, round(customers * 100.0 / sum(customers) OVER (PARTITION BY rfm_segment), 6) AS pct,
  first_value(churn_risk) OVER (PARTITION BY rfm_segment ORDER BY customers DESC, churn_risk) AS dominant_risk FROM g""",
    "loyalty_tiers": f"WITH {CUST}{TIER_CTE} SELECT customer_id, loyalty_tier FROM tier",
    "segment_compare": f"""WITH {CUST}{TIER_CTE} SELECT loyalty_tier, count(DISTINCT customer_id) AS customers, round(sum(amt) / 10000.0, 4) AS revenue, count(*) AS orders,
  round(sum(amt) / 10000.0 / count(*), 4) AS avg_order_value FROM tx LEFT JOIN tier USING (customer_id) GROUP BY 1""",
    "segment_rfm_means": f"""WITH {SEG} SELECT rfm_segment, count(*) AS customers, round(avg(recency_days), 4) AS avg_recency, round(avg(frequency), 4) AS avg_frequency,
  round(avg(monetary), 4) AS avg_monetary, round(avg(loyalty_score), 4) AS avg_loyalty FROM seg GROUP BY 1""",
    "cluster_profiles": f"WITH {SEG}{_PROF} SELECT rfm_segment, customers, dominant_risk, " + ", ".join(f"round({c}, 6) AS {c}" for c in (
        "avg_recency", "avg_frequency", "avg_monetary", "total_revenue", "avg_recency_score", "avg_frequency_score", "avg_monetary_score", "avg_loyalty", "avg_order_value",
        "avg_return_rate", "avg_discount_usage", "active_pct", "at_risk_pct", "inactive_pct", "churned_pct", "share_pct", "median_recency_days", "median_frequency", "median_monetary")) + " FROM prof",
    "segment_names": f"WITH {SEG}{_NAMED} SELECT rfm_segment, segment_name FROM named",
    "segment_insight_flags": f"""WITH {SEG}{_NAMED}, z AS (SELECT *, (r + f + m) / 3 >= 4 AND active_pct > 60 AS best, r >= 4.5 AND f <= 2 AS fresh,
  r >= 4 AND f >= 3 AND active_pct > 50 AS base FROM named) """ + " UNION ALL ".join(
        f"SELECT segment_name, round(revenue_pct, 4) AS revenue_pct, '{n}' AS rule_id, {c} AS fired, {p} AS priority FROM z" for n, (c, p) in _R.items()),
    "segment_actions": f"""WITH {SEG}{_NAMED}, dim(base_name, action, action_priority) AS (VALUES """ + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in op.SEGMENT_ACTIONS)
    + """) SELECT segment_name, customers, round(total_revenue, 4) AS total_revenue, action, action_priority FROM named LEFT JOIN dim ON base_name = nm""",
    "segmentation_input_checks": f"WITH {SEG} " + " UNION ALL ".join(
        f"SELECT '{c}_in_1_5' AS check_name, CASE WHEN count(*) FILTER (WHERE {c} IS NULL OR {c} < 1 OR {c} > 5) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, 'error' AS severity, CAST(count(*) FILTER (WHERE {c} IS NULL OR {c} < 1 OR {c} > 5) AS DOUBLE) AS observed FROM seg" for c in _KEYS[1:]),
}
