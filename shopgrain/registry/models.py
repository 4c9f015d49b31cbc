"""Queries that fit models. LOF has a SQL counterpart; the others are covered by invariants in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly, boosting, churn, classify, clustering, features, forecast, fraud, hypothesis, neighbours, quality, sales, segments
from ..plans import flows
from ..operators.customers import customer_features
from ..session import materialized
from ..sources.tables import transactions
from .base import CFG, CUST, CUTOFF, TX, rounded
from .fraud import _FEAT, _features


def _vectors(s, d):
    return materialized(clustering.cluster_vectors(customer_features(transactions(s, d), CFG), CFG))


def _clusters(s, d, k=4):
    v = _vectors(s, d)
    return clustering.assign_clusters(v, clustering.best_kmeans(v, k, CFG))


def _churn(s, d, strategy="composite"):
    return materialized(churn.churn_dataset(transactions(s, d), CFG, strategy))


def _models(data, strategy, names=None):
    cols = churn.feature_columns(strategy)
    return cols, classify.train_models(data, cols, CFG, names=names)


def _metrics(s, d):
    data = _churn(s, d)
    cols, models = _models(data, "composite")
    return classify.compare_models(classify.evaluate_all(models, data.where("not is_train"), cols), CFG)


def _scored(s, d):
    data = _churn(s, d)
    cols, models = _models(data, "composite", ["Logistic Regression"])
    return classify.score(models["Logistic Regression"], data, cols, keep=["customer_id", "churn", "monetary"])


def _importance(s, d):
    data = _churn(s, d)
    cols, models = _models(data, "composite", ["Random Forest"])
    return classify.feature_importance(models["Random Forest"], cols, "Random Forest", s)


def _strategies(s, d):
    data = _churn(s, d, "all")
    sets = {n: churn.feature_columns(n) for n in ("base", "composite")}
    v = features.vif_by_strategy(data.where("is_train"), sets, CFG.churn.vif_threshold)
    rows = None
    for n in sets:
        cols, models = _models(data, n, ["Gradient Boosting"])
        m = classify.evaluate_all(models, data.where("not is_train"), cols).select(F.lit(n).alias("strategy"), "f1")
        rows = m if rows is None else rows.unionByName(m)
    return churn.pick_strategy(v.join(rows, "strategy"))


#: Given cuts of the first boosted tree's features, in the order in which ties are settled.
BOOST_CUTS = {
    "frequency": [3.0, 5.0, 10.0, 15.0, 20.0, 30.0], "tenure_days": [500.0, 1000.0, 1500.0, 2000.0], "category_diversity": [2.0, 3.0, 4.0, 5.0],
    "return_rate": [0.2, 0.3, 0.4, 0.5], "last_order_was_return": [0.0],
}


def _first_tree(s, d):
    cust = customer_features(transactions(s, d), CFG)
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in BOOST_CUTS])
    rows = cust.select(F.xxhash64("customer_id").alias("key"), F.col("churn").alias("y"), F.lit(1.0).alias("w"), x.alias("x"))
    trees = boosting.fit_boosted(rows, list(BOOST_CUTS.values()), boosting.BoostingParams(trees=1, depth=2, row_share=1.0, feature_share=1.0))
    return rounded(boosting.tree_table(trees, list(BOOST_CUTS.values()), list(BOOST_CUTS), s))


def _scaled(s, d):
    cols = list(CFG.fraud.model_features)
    return features.z_scores(_features(s, d), cols).select("customer_id", *cols), cols


def _lof(s, d):
    z, cols = _scaled(s, d)
    return anomaly.local_outlier_factor(z, cols, CFG)


def _lof_bucketed(s, d):
    z, cols = _scaled(s, d)
    return anomaly.local_outlier_factor(z, cols, CFG, search=neighbours.BucketedSearch())


def _iso(s, d):
    z, cols = _scaled(s, d)
    return anomaly.isolation_forest(z, cols, CFG)


def _profile(s, d):
    feats = _features(s, d)
    cols = list(CFG.fraud.model_features)
    z = features.z_scores(feats, cols).select("customer_id", *cols)
    both = anomaly.ensemble(fraud.rule_scores(feats, CFG), anomaly.isolation_forest(z, cols, CFG), anomaly.local_outlier_factor(z, cols, CFG))
    return fraud.typology(fraud.composite_score(both, CFG), CFG)


def _weekly(s, d):
    return materialized(forecast.weekly_series(sales.complete_months(transactions(s, d, ["order_date", "total_amount", "returned", "category", "region"]), CFG)))


def _forecast(s, d):
    return forecast.forecast_metrics(forecast.forecast_grid(_weekly(s, d), CFG), CFG)


def _history(s, d):
    w = _weekly(s, d)
    g = materialized(forecast.forecast_grid(w, CFG))
    return forecast.history_and_forecast(w, g, forecast.forecast_metrics(g, CFG))


def _pca(s, d):
    return features.pca(_vectors(s, d), 2)[0].select("customer_id", "pc1", "pc2")


def _validation(s, d):
    seg = segments.rfm_segments(segments.rfm_scores(customer_features(transactions(s, d), CFG)))
    return flows.validate_segments(seg, ["recency_days", "frequency", "monetary", "loyalty_score"], "rfm_segment")


QUERIES = {
    "vif": lambda s, d: features.vif(_churn(s, d, "all").where("is_train"), churn.feature_columns("composite"), CFG.churn.vif_threshold),
    "kmeans_segments": lambda s, d: clustering.cluster_sizes(_clusters(s, d)),
    "cluster_silhouette": lambda s, d: clustering.silhouette_by_cluster(_clusters(s, d)),
    "k_sweep": lambda s, d: clustering.k_sweep(_vectors(s, d), CFG),
    "choose_k": lambda s, d: clustering.choose_k(clustering.k_sweep(_vectors(s, d), CFG), CFG),
    "stability": lambda s, d: clustering.stability(_vectors(s, d), 4, CFG),
    "pca": _pca,
    "scaled_feature_shape": lambda s, d: rounded(features.distribution_after_scaling(customer_features(transactions(s, d), CFG), list(CFG.segment.features))),
    "churn_models": _metrics,
    "churn_scores": _scored,
    "boosted_first_tree": _first_tree,
    "churn_importance": _importance,
    "churn_strategy": _strategies,
    "temporal_split_checks": lambda s, d: quality.temporal_split_checks(_churn(s, d), len(churn.feature_columns("composite")), 180, CFG),
    "lof": lambda s, d: rounded(_lof(s, d), 4),
    "lof_bucketed": lambda s, d: rounded(_lof_bucketed(s, d), 4),
    "isolation_forest": _iso,
    "composite_risk": lambda s, d: _profile(s, d).select(*fraud.PROFILE_COLUMNS),
    "model_agreement": lambda s, d: hypothesis.flag_agreement(_profile(s, d), "iso_anomaly_flag", "lof_anomaly_flag"),
    "fraud_output_checks": lambda s, d: quality.fraud_output_checks(_profile(s, d), CFG),
    "weekly_series": lambda s, d: rounded(_weekly(s, d)),
    "forecast_grid": _forecast,
    "history_and_forecast": _history,
    "forecast_verdicts": lambda s, d: forecast.forecast_verdicts(
        _forecast(s, d), sales.rolling_trend(sales.weekly_sales(sales.complete_months(transactions(s, d, ["order_date", "customer_id", "total_amount", "returned"]), CFG)), 13), CFG),
    "segment_validation": _validation,
}

# First tree from even odds: gradient 0.5 - y, hessian 0.25, shrinkage 1, rate 0.1; every node tries every given cut.
_CUTS = ", ".join(f"('{c}', {i}, {v}::DOUBLE)" for i, (c, cuts) in enumerate(BOOST_CUTS.items()) for v in cuts)
_SIDES = " UNION ALL ".join(f"SELECT customer_id, churn, '{c}' AS feature, coalesce(CAST({c} AS DOUBLE), 0) AS v FROM cust" for c in BOOST_CUTS)


def _tree_level(rows, name):
    """Best cut of each path of ``rows`` (customer_id, path)."""
    return f"""
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY gain DESC, i, cut) AS rn FROM (
  SELECT path, feature, i, cut, (gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)) / 2 AS gain FROM (
    SELECT path, c.feature, c.i, c.cut, sum(CASE WHEN v <= cut THEN 0.5 - churn ELSE 0 END)::DOUBLE AS gl, sum(CASE WHEN v <= cut THEN 0.25 ELSE 0 END)::DOUBLE AS hl,
      sum(0.5 - churn)::DOUBLE AS g, sum(0.25)::DOUBLE AS h FROM {rows} JOIN side USING (customer_id) JOIN cuts c USING (feature) GROUP BY ALL)
  WHERE hl >= 1 AND h - hl >= 1) WHERE gain > 1e-12) WHERE rn = 1)"""


def _tree_step(rows, best, name):
    return f"""
{name} AS (SELECT customer_id, path || CASE WHEN v <= cut THEN 'L' ELSE 'R' END AS path FROM {rows} JOIN {best} b USING (path) JOIN side s USING (customer_id, feature))"""


_FIRST_TREE = f"""WITH {CUST}, cuts AS (SELECT * FROM (VALUES {_CUTS}) AS c(feature, i, cut)), side AS ({_SIDES}),
r0 AS (SELECT customer_id, '' AS path FROM cust),{_tree_level("r0", "b0")},{_tree_step("r0", "b0", "r1")},{_tree_level("r1", "b1")},{_tree_step("r1", "b1", "r2")}
SELECT 0 AS tree, path, feature, cut AS threshold, round(coalesce(gain, 0), 6) AS gain, count(*) * 0.25::DOUBLE AS weight, round(-sum(0.5 - churn)::DOUBLE / (count(*) * 0.25::DOUBLE + 1) * 0.1, 6) AS value
FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2) JOIN cust USING (customer_id) LEFT JOIN (SELECT * FROM b0 UNION ALL SELECT * FROM b1) USING (path) GROUP BY ALL"""

_F = CFG.fraud.model_features
_Z = ", ".join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) AS z{i}" for i, c in enumerate(_F))
_D = " + ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i})" for i in range(len(_F)))

ORACLES = {
    "lof": f"""WITH {_FEAT}, zz AS MATERIALIZED (SELECT customer_id AS id, {_Z} FROM feat),
ds AS MATERIALIZED (SELECT a.id AS p, b.id AS o, sqrt({_D}) AS d FROM zz a JOIN zz b ON a.id <> b.id),
kd AS (SELECT p, d AS kdist FROM (SELECT p, d, row_number() OVER (PARTITION BY p ORDER BY d) AS rn FROM ds) WHERE rn = 20),
nb AS (SELECT ds.p, ds.o, ds.d FROM ds JOIN kd USING (p) WHERE d <= kdist),
lr AS (SELECT nb.p, 1 / (avg(greatest(d, kdist)) + 1e-10) AS lrd FROM nb JOIN kd ON nb.o = kd.p GROUP BY 1),
lo AS (SELECT nb.p, avg(b.lrd) / max(a.lrd) AS lof FROM nb JOIN lr a ON nb.p = a.p JOIN lr b ON nb.o = b.p GROUP BY 1)
SELECT p AS customer_id, round(lof, 4) AS lof_raw, round((lof - min(lof) OVER ()) / (max(lof) OVER () - min(lof) OVER ()), 4) AS lof_anomaly_score,
  CAST(lof > (SELECT quantile_cont(lof, 0.95) FROM lo) AS INTEGER) AS lof_anomaly_flag FROM lo""",
}
ORACLES["boosted_first_tree"] = _FIRST_TREE
_WS = "CAST(date_trunc('week', order_date) AS DATE) + 6 AS date, round(sum(amt) / 10000.0, 6) AS revenue FROM tx WHERE returned = 0 AND order_date < DATE '" + CUTOFF + "'"
ORACLES["weekly_series"] = f"""WITH {TX} SELECT 'total' AS series, {_WS} GROUP BY ALL
UNION ALL SELECT 'category:' || category, {_WS} GROUP BY ALL UNION ALL SELECT 'region:' || region, {_WS} GROUP BY ALL"""


def _shape(c):
    return f"""SELECT '{c}' AS feature, round(avg(z), 6) + 0.0 AS mean, round(stddev_pop(z), 6) AS std, round(avg(pow(z, 3)), 6) AS skewness, round(avg(pow(z, 4)) - 3, 6) AS kurtosis
  FROM (SELECT ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z FROM cust)"""


ORACLES["scaled_feature_shape"] = f"WITH {CUST} " + " UNION ALL ".join(_shape(c) for c in CFG.segment.features)
