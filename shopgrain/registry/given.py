"""Measures of models on given scores, labels and sweeps, which come straight from the tables: what SQL can check without the fitted models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..operators import classify, clustering, features, fraud
from ..operators.customers import customer_features
from ..session import materialized
from ..sources.tables import read_table, transactions
from .base import CFG, CUST, rounded

_COLUMNS = ("return_rate", "discount_usage_rate")


def _cust(s, d):
    return customer_features(transactions(s, d), CFG)


def _scores(s, d):
    """The return rate as churn score."""
    return materialized(_cust(s, d).select("customer_id", "churn", F.col("return_rate").alias("churn_probability"), (F.col("return_rate") > 0.35).cast("int").alias("churn_prediction")))


def _labels(s, d):
    """Region labels on two rates."""
    c = _cust(s, d).select("customer_id", F.col("preferred_region").alias("cluster"), *_COLUMNS)
    return materialized(c.select("customer_id", "cluster", array_to_vector(F.array(*_COLUMNS)).alias("features")))


def _separation(s, d):
    found = clustering.separation(_labels(s, d))
    return rounded(s.createDataFrame([tuple(float(v) for v in found.values())], ", ".join(f"{k} double" for k in found)))


def _sweep(s, d):
    """One row per line number, read as k, with sums and means of its lines in place of the measures."""
    li = read_table(s, d, "lineitem")
    return li.groupBy((F.col("l_linenumber") + 1).cast("int").alias("k")).agg(
        (F.sum(F.col("l_quantity").cast("bigint")) / F.first(F.col("l_linenumber"))).alias("inertia"), F.max("l_extendedprice").alias("silhouette"),
        F.min(F.col("l_extendedprice")).alias("davies_bouldin"), F.count("*").cast("double").alias("calinski_harabasz"))


def _composite(s, d):
    """Three rates of a customer in place of the three scores."""
    c = _cust(s, d).select(
        "customer_id", F.col("return_rate").alias("rule_fraud_score_norm"), F.col("discount_usage_rate").alias("iso_anomaly_score"), F.col("last_order_was_return").cast("double").alias("lof_anomaly_score"))
    return rounded(fraud.composite_score(c, CFG).select("customer_id", "composite_fraud_score", "risk_tier"))


def _variance(s, d):
    """Shares of variance of the two components of two scaled rates, and the variance of the projections themselves."""
    z = features.z_scores(_cust(s, d), list(_COLUMNS)).select("customer_id", array_to_vector(F.array(*_COLUMNS)).alias("features"))
    out, shares = features.pca(z, 2)
    spread = out.agg(F.var_pop("pc1").alias("pc1"), F.var_pop("pc2").alias("pc2"))
    return rounded(spread.select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(v).alias("share"), F.col(f"pc{i + 1}").alias("variance")) for i, v in enumerate(shares)])).alias("r")).select("r.*"))


QUERIES = {
    "explained_variance_of_two": _variance,
    "metrics_of_given_scores": lambda s, d: rounded(classify.classification_metrics(_scores(s, d), "given")),
    "roc_of_given_scores": lambda s, d: rounded(classify.roc_points(_scores(s, d))),
    "separation_of_given_labels": _separation,
    "silhouette_of_given_labels": lambda s, d: rounded(clustering.silhouette_by_cluster(_labels(s, d))),
    "elbow_of_given_sweep": lambda s, d: rounded(clustering.elbow(_sweep(s, d))),
    "choice_of_given_sweep": lambda s, d: clustering.choose_k(_sweep(s, d), CFG),
    "vif_of_two": lambda s, d: rounded(features.vif(_cust(s, d), ["frequency", "monetary"], CFG.churn.vif_threshold), 4),
    "composite_of_given_scores": _composite,
}

_LABELS = f"WITH {CUST}, v AS (SELECT customer_id, preferred_region AS cluster, return_rate AS x, discount_usage_rate AS y FROM cust)"
_SCORES = f"WITH {CUST}, s AS (SELECT churn, return_rate AS p, CAST(return_rate > 0.35 AS INTEGER) AS e FROM cust)"
_SWEEP = """WITH sweep AS (SELECT CAST(l_linenumber + 1 AS INTEGER) AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / l_linenumber AS inertia, max(l_extendedprice) AS silhouette,
  min(l_extendedprice) AS davies_bouldin, CAST(count(*) AS DOUBLE) AS calinski_harabasz FROM lineitem GROUP BY l_linenumber),
e AS (SELECT min(k) AS k0, max(k) AS k1, min(inertia) AS i0, max(inertia) AS i1, arg_min(inertia, k) AS f, arg_max(inertia, k) AS l FROM sweep),
n AS (SELECT k, (k - k0)::DOUBLE / (k1 - k0) AS x, (inertia - i0) / (i1 - i0) AS v, (f - i0) / (i1 - i0) AS a, (l - i0) / (i1 - i0) AS b FROM sweep, e),
elbow AS (SELECT k, abs(v - a - (b - a) * x) / sqrt(1 + (b - a) * (b - a)) AS distance FROM n ORDER BY distance DESC, k LIMIT 1)"""
_S = CFG.segment

ORACLES = {
    "explained_variance_of_two": f"""WITH {CUST}, r AS (SELECT abs(corr(return_rate, discount_usage_rate)) AS r FROM cust)
SELECT 1 AS component, round((1 + r) / 2, 6) AS share, round(1 + r, 6) AS variance FROM r UNION ALL SELECT 2, round((1 - r) / 2, 6), round(1 - r, 6) FROM r""",
    "metrics_of_given_scores": _SCORES + """, m AS (SELECT count(*) FILTER (WHERE e = 1 AND churn = 1) AS tp, count(*) FILTER (WHERE e = 1 AND churn = 0) AS fp,
  count(*) FILTER (WHERE e = 0 AND churn = 1) AS fn, count(*) FILTER (WHERE e = 0 AND churn = 0) AS tn FROM s),
pairs AS (SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS auc FROM (SELECT p FROM s WHERE churn = 1) a, (SELECT p FROM s WHERE churn = 0) b),
r AS (SELECT *, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
  coalesce(tn::DOUBLE / nullif(tn + fn, 0), 0) AS precision_0, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS recall_0 FROM m)
SELECT 'given' AS model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1,
  round(auc, 6) AS roc_auc, tp, fp, fn, tn, round(precision_0, 6) AS precision_0, round(recall_0, 6) AS recall_0, round(coalesce(2 * precision_0 * recall_0 / nullif(precision_0 + recall_0, 0), 0), 6) AS f1_0 FROM r, pairs""",
    "roc_of_given_scores": _SCORES + """, t AS (SELECT p AS threshold, sum(churn)::DOUBLE AS pos, (count(*) - sum(churn))::DOUBLE AS neg FROM s GROUP BY 1),
c AS (SELECT threshold, pos / sum(pos) OVER () AS dp, neg / sum(neg) OVER () AS dn, sum(pos) OVER (ORDER BY threshold DESC) / sum(pos) OVER () AS tpr, sum(neg) OVER (ORDER BY threshold DESC) / sum(neg) OVER () AS fpr FROM t)
SELECT round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round((tpr - dp / 2) * dn, 6) + 0.0 AS area FROM c""",
    "separation_of_given_labels": _LABELS + """, c AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM v GROUP BY 1),
d AS (SELECT c.*, s, w FROM c JOIN (SELECT cluster, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS s, sum((x - cx) ** 2 + (y - cy) ** 2) AS w FROM v JOIN c USING (cluster) GROUP BY 1) USING (cluster)),
b AS (SELECT a.cluster, max((a.s + o.s) / sqrt((a.cx - o.cx) ** 2 + (a.cy - o.cy) ** 2)) AS worst FROM d a JOIN d o ON a.cluster <> o.cluster GROUP BY 1),
g AS (SELECT avg(x) AS gx, avg(y) AS gy, count(*) AS n FROM v)
SELECT round((SELECT avg(worst) FROM b), 6) AS davies_bouldin, round((sum(d.n * ((cx - gx) ** 2 + (cy - gy) ** 2)) / (count(*) - 1)) / (sum(w) / (max(g.n) - count(*))), 6) AS calinski_harabasz, round(sum(w), 6) AS inertia FROM d, g""",
    "silhouette_of_given_labels": _LABELS + """, c AS (SELECT cluster, count(*) AS n FROM v GROUP BY 1),
m AS (SELECT a.customer_id, a.cluster, b.cluster AS other, sum((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS total FROM v a, v b GROUP BY ALL),
o AS (SELECT customer_id, m.cluster, max(CASE WHEN other = m.cluster THEN total / greatest(n - 1, 1) END) AS a, min(CASE WHEN other <> m.cluster THEN total / n END) AS b, max(CASE WHEN other = m.cluster THEN n END) AS own
  FROM m JOIN c ON m.other = c.cluster GROUP BY ALL)
SELECT cluster, count(*) AS customers, round(avg(CASE WHEN own <= 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) AS silhouette FROM o GROUP BY 1""",
    "elbow_of_given_sweep": _SWEEP + " SELECT k, round(distance, 6) AS distance FROM elbow",
    "choice_of_given_sweep": _SWEEP + f""", v AS (SELECT arg_max(k, silhouette) AS silhouette, arg_min(k, davies_bouldin) AS davies_bouldin, arg_max(k, calinski_harabasz) AS calinski_harabasz, (SELECT k FROM elbow) AS elbow FROM sweep),
w AS (SELECT k AS winner FROM (SELECT unnest([silhouette, davies_bouldin, calinski_harabasz, elbow]) AS k FROM v) GROUP BY k ORDER BY count(*) DESC, k DESC LIMIT 1)
SELECT *, least(greatest(CASE WHEN winner = 2 THEN greatest({_S.fallback_k}, elbow) ELSE winner END, {_S.min_k}), {_S.max_k}) AS k FROM v, w""",
    "vif_of_two": f"""WITH {CUST}, r AS (SELECT 1 / (1 - corr(frequency, monetary) ** 2) AS vif FROM cust WHERE monetary IS NOT NULL)
SELECT feature, round(vif, 4) AS vif, vif < {CFG.churn.vif_threshold} AS passed FROM r, (SELECT unnest(['frequency', 'monetary']) AS feature)""",
    "composite_of_given_scores": f"""WITH {CUST}, b AS (SELECT customer_id, {CFG.fraud.blend_rule} * return_rate + {CFG.fraud.blend_isolation} * discount_usage_rate + {CFG.fraud.blend_lof} * last_order_was_return AS blend FROM cust),
s AS (SELECT customer_id, blend::DOUBLE / max(blend) OVER () AS score FROM b)
SELECT customer_id, round(score, 6) AS composite_fraud_score, CASE WHEN score >= {CFG.fraud.tier_critical} THEN 'Critical' WHEN score >= {CFG.fraud.tier_high} THEN 'High' WHEN score >= {CFG.fraud.tier_medium} THEN 'Medium' ELSE 'Low' END AS risk_tier FROM s""",
}
