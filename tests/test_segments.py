import random

import pytest
from pyspark.sql import functions as F

from shopgrain.operators import clustering, segments


def brute_score(values, ascending):
    med = sorted(v for v in values if v is not None)
    med = (med[(len(med) - 1) // 2] + med[len(med) // 2]) / 2
    x = [med if v is None else v for v in values]
    n = len(x)
    out = []
    for v in x:
        less, same = sum(o < v for o in x), x.count(v)
        r = less + (same + 1) / 2
        r = r if ascending else n + 1 - r
        out.append(min(max(-(-r * 5 // n), 1), 5))
    return out


@pytest.mark.parametrize("nulls", [0, 1, 9])
def test_scores_match_percentile_ranks(spark, nulls):
    rng = random.Random(nulls)
    rows = [(f"C{i}", *((None,) * 3 if i < nulls else (rng.randrange(300), rng.randrange(1, 6), float(rng.randrange(40)) * 12.5))) for i in range(97)]
    df = spark.createDataFrame(rows, "customer_id string, recency_days int, frequency bigint, monetary double")
    got = {r["customer_id"]: r for r in segments.rfm_scores(df).collect()}
    for j, (name, up) in enumerate((("recency_score", False), ("frequency_score", True), ("monetary_score", True)), start=1):
        want = brute_score([r[j] for r in rows], up)
        assert [got[r[0]][name] for r in rows] == want


def test_tiers_keep_ties_together_and_drop_equal_edges(spark):
    df = spark.createDataFrame([(f"C{i}", v) for i, v in enumerate([0.1] * 6 + [0.5, 0.9])], "customer_id string, loyalty_score double")
    got = {}
    for r in segments.loyalty_tiers(df).collect():
        got.setdefault(r["loyalty_score"], set()).add(r["loyalty_tier"])
    assert all(len(v) == 1 for v in got.values()) and got[0.1] == {"Bronze"} and got[0.9] == {"Silver"}


def test_risk_bands(spark):
    df = spark.createDataFrame([(v,) for v in (60, 61, 120, 121, 180, 181, None)], "recency_days int")
    assert [r["churn_risk"] for r in segments.with_churn_risk(df).collect()] == ["Active", "At Risk", "At Risk", "Inactive", "Inactive", "Churned", "Churned"]


def test_names_are_unique(spark):
    cols = "cluster int, avg_monetary double, avg_frequency double, avg_recency double, avg_recency_score double, avg_frequency_score double, avg_monetary_score double, dominant_risk string, active_pct double, at_risk_pct double, inactive_pct double, churned_pct double, customers bigint, total_revenue double"
    rows = [(i, 100.0 * i, 2.0, 30.0, 4.2, 4.2, 4.2, "Active", 90.0, 5.0, 3.0, 2.0, 10, 5.0) for i in range(4)]
    names = [r["segment_name"] for r in segments.segment_names(spark.createDataFrame(rows, cols)).orderBy("priority", ascending=False).collect()]
    assert names == ["Champions", "Champions (Frequent)", "Champions (Frequent 2)", "Champions (Frequent 3)"]


def test_ari(spark):
    same = spark.createDataFrame([(0, 1)] * 5 + [(1, 0)] * 5, "a int, b int")
    assert clustering.adjusted_rand(same, "a", "b").first()["ari"] == 1.0
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 2)]
    assert clustering.adjusted_rand(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()["ari"] == pytest.approx(0.4 / 3.4)  # (2 - 1.6) / (5 - 1.6)


def test_k_vote(spark):
    rows = [(2, 100.0, 0.3, 1.2, 50.0), (3, 60.0, 0.5, 0.9, 80.0), (4, 50.0, 0.4, 1.0, 90.0), (5, 45.0, 0.3, 1.1, 70.0)]
    c = clustering.choose_k(spark.createDataFrame(rows, "k int, inertia double, silhouette double, davies_bouldin double, calinski_harabasz double")).first()
    assert (c["silhouette"], c["davies_bouldin"], c["calinski_harabasz"], c["elbow"], c["k"]) == (3, 3, 4, 3, 3)


def test_kmeans_finds_blobs_and_measures(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.linalg import Vectors

    rng = random.Random(4)
    rows = [(f"C{i}", Vectors.dense([rng.gauss(m, 0.2), rng.gauss(-m, 0.2)])) for i, m in enumerate([0, 5, 10] * 40)]
    v = spark.createDataFrame(rows, ["customer_id", "features"])
    lab = clustering.assign_clusters(v, clustering.best_kmeans(v, 3, restarts=3))
    assert sorted(r["customers"] for r in clustering.cluster_sizes(lab).collect()) == [40, 40, 40]
    sil = clustering.silhouette_by_cluster(lab).collect()
    mean = sum(r["silhouette"] * r["customers"] for r in sil) / 120
    assert mean == pytest.approx(ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(lab), abs=1e-9)
    s = clustering.separation(lab)
    assert s["davies_bouldin"] < 0.2 and s["calinski_harabasz"] > 1000


def _vectors(spark, x):
    from pyspark.ml.functions import array_to_vector

    return spark.createDataFrame([(f"C{i}", r.tolist()) for i, r in enumerate(x)], "customer_id string, x array<double>").select("customer_id", array_to_vector("x").alias("features"))


def test_kmeans_starts_come_from_all_points_whatever_the_layout(spark):
    """One far group of eight among 4,000 points is always drawn; candidates' weights add up to the points; files and partitions play no part."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (3992, 3)), rng.normal(200, 0.1, (8, 3))])
    v = _vectors(spark, x)
    points = v.select(vector_to_array("features").alias("x"))
    cand, weight = clustering.candidate_centres(points, 5)
    assert weight.sum() == 4000 and weight[cand[:, 0] > 100].sum() == 8 and len(cand) <= 1 + clustering.DRAW_ROUNDS * clustering.DRAWN
    again = clustering.candidate_centres(points.orderBy(F.desc("x")).repartition(11), 5)
    assert (cand == again[0]).all() and (weight == again[1]).all()
    a, b = clustering.best_kmeans(v, 5, restarts=4), clustering.best_kmeans(v.repartition(9), 5, restarts=4)
    np.testing.assert_allclose(a.points, b.points, rtol=1e-9)
    assert a.cost == pytest.approx(b.cost) and sum(p[0] > 100 for p in a.points) == 1


def test_kmeans_of_few_and_equal_points(spark):
    import numpy as np

    same = clustering.best_kmeans(_vectors(spark, np.ones((20, 2))), 3, restarts=2)
    assert same.cost == 0.0 and (same.points == 1).all()
    two = clustering.best_kmeans(_vectors(spark, np.array([[0.0, 0.0]] * 5 + [[4.0, 0.0]])), 4, restarts=2)
    assert two.cost == pytest.approx(0.0)


def test_a_round_is_one_job_and_gives_plain_sums(spark):
    """Twelve fits of up to four rounds: one job a round, and sums as of plain loops."""
    import numpy as np

    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 1.0, (150, 3)) for c in (0, 3, 7)])
    df = _vectors(spark, x)
    sc = spark.sparkContext
    sc.setJobGroup("kmeans-rounds", "")
    try:
        fits = clustering.kmeans_fits(df, [(k, s) for k in (2, 3, 5) for s in range(4)], 3)
        jobs = sc.statusTracker().getJobIdsForGroup("kmeans-rounds")
    finally:
        sc._jsc.clearJobGroup()
    assert len(jobs) <= clustering.DRAW_ROUNDS + 3 + 4
    for f in fits:
        c = f.points
        assert f.cost >= ((x[:, None, :] - c[None]) ** 2).sum(-1).min(1).sum() * (1 - 1e-9)
    one, = clustering.kmeans_fits(df, [(3, 0)], 100)
    own = ((x[:, None, :] - one.points[None]) ** 2).sum(-1).argmin(1)
    np.testing.assert_allclose(one.points, [x[own == i].mean(0) for i in range(3)], atol=1e-3)
