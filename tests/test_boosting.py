"""Histogram boosting against a plain version on all rows, its tree rules, persistence and edges."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopgrain.operators import boosting as B

SCHEMA = "key bigint, y int, w double, x array<double>"


def plain(key, y, w, x, edges, p):
    """The same trees by plain loops over rows: per node every feature, cut and side of missing values is tried on the node's rows."""
    margin = np.zeros(len(y))
    trees = []
    for number in range(p.trees):
        allowed = sorted(np.random.default_rng([p.seed, number]).choice(x.shape[1], max(1, math.ceil(p.feature_share * x.shape[1] - 1e-9)), replace=False).tolist())
        drawn = B.unit(key, p.seed * 1_000_003 + number) < p.row_share
        prob = 1 / (1 + np.exp(-margin))
        g, h = w * (prob - y), w * prob * (1 - prob)

        def build(rows, depth):
            take = rows[drawn[rows]]
            gs, hs = g[take].sum(), h[take].sum()
            leaf = ("leaf", -gs / (hs + p.l2) * p.rate)
            best, score = (p.min_gain, None), lambda a, b: a * a / (b + p.l2)
            for j in allowed if depth < p.depth else ():
                for c, cut in enumerate(edges[j]):
                    for missing_left in (True, False) if np.isnan(x[take, j]).any() else (True,):
                        left = np.where(np.isnan(x[take, j]), missing_left, x[take, j] <= cut)
                        gl, hl = g[take][left].sum(), h[take][left].sum()
                        gr, hr = gs - gl, hs - hl
                        gain = (score(gl, hl) + score(gr, hr) - score(gs, hs)) / 2
                        if hl >= p.child_weight and hr >= p.child_weight and gain > best[0] + 1e-9:
                            best = (gain, (j, cut, missing_left))
            if best[1] is None:
                margin[rows] += leaf[1]
                return leaf
            j, cut, missing_left = best[1]
            left = np.where(np.isnan(x[rows, j]), missing_left, x[rows, j] <= cut)
            return (j, cut, build(rows[left], depth + 1), build(rows[~left], depth + 1))

        trees.append(build(np.arange(len(y)), 0))
    return trees, margin


def nested(t, edges, node=0):
    if t.feature[node] < 0:
        return ("leaf", t.value[node])
    j = t.feature[node]
    return (j, edges[j][t.cut[node]], nested(t, edges, t.left[node]), nested(t, edges, t.right[node]))


def flat(t):
    return [t] if t[0] == "leaf" else [t[:2], *flat(t[2]), *flat(t[3])]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(260, 4)), 2)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0) | (rng.random(260) < 0.1)).astype(int)
    x[rng.random(260) < 0.15, 0] = np.nan
    x[:, 3] = 1.0
    return np.arange(260), y, np.where(y == 1, 1.5, 1.0), x


def frame(spark, data):
    key, y, w, x = data
    return spark.createDataFrame([(int(k), int(a), float(b), [None if np.isnan(v) else float(v) for v in r]) for k, a, b, r in zip(key, y, w, x)], SCHEMA)


@pytest.mark.parametrize("changes", [{}, {"row_share": 1.0, "feature_share": 1.0, "l2": 0.0, "child_weight": 4.0}, {"min_gain": 0.6, "depth": 5, "write_every": 2}])
def test_trees_equal_the_plain_version(spark, data, changes):
    p = replace(B.BoostingParams(trees=5, depth=3, bins=16), **changes)
    rows = frame(spark, data)
    edges = B.bin_edges(rows.select(*[F.col("x")[j].alias(f"x{j}") for j in range(4)]), [f"x{j}" for j in range(4)], p.bins)
    assert edges[3] == [] and all(len(e) == 15 for e in edges[:3])
    got = [flat(nested(t, edges)) for t in B.fit_boosted(rows, edges, p)]
    want, _ = plain(*data, edges, p)
    for a, b in zip(got, map(flat, want)):
        assert [n[0] for n in a] == [n[0] for n in b]
        np.testing.assert_allclose([n[1] for n in a], [n[1] for n in b], rtol=1e-5, atol=1e-7)


def test_trees_do_not_depend_on_partitions(spark, data):
    p = B.BoostingParams(trees=3, depth=3)
    edges = [[-0.5, 0.0, 0.5], [-1.0, 0.0, 1.0], [0.0], []]
    assert B.fit_boosted(frame(spark, data).repartition(9), edges, p) == B.fit_boosted(frame(spark, data).coalesce(1), edges, p)


def test_stage_learns_saves_and_loads(spark, data, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler

    key, y, w, x = data
    df = spark.createDataFrame([(int(a), float(r[1]), float(r[2])) for a, r in zip(y, np.nan_to_num(x))], "label int, a double, b double")
    stage = B.HistogramBoosting(settings='{"trees": 12, "depth": 2, "rate": 0.3}')
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), stage]).fit(df)
    out = model.transform(df)
    assert out.where("prediction = label").count() > 0.6 * len(y)
    assert 0.99 < sum(model.stages[-1].featureImportances.toArray()) < 1.01
    model.write().overwrite().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m").transform(df)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_one_label_and_no_cuts_give_leaves(spark):
    rows = spark.createDataFrame([(i, 1, 1.0, [2.0]) for i in range(20)], SCHEMA)
    trees = B.fit_boosted(rows, [[]], B.BoostingParams(trees=2, row_share=1.0))
    assert [len(t.feature) for t in trees] == [1, 1] and trees[0].value[0] == pytest.approx(0.1 * 10 / (5 + 1))


def test_a_level_is_one_job(spark, data):
    """Three trees of depth 3 take at most 4 jobs each, and a few go to writing and counting the rows; no level has a shuffle of its own."""
    p = B.BoostingParams(trees=3, depth=3, write_every=100)
    edges = [[-0.5, 0.0, 0.5], [-1.0, 0.0, 1.0], [0.0], []]
    rows = frame(spark, data).repartition(5).localCheckpoint()
    sc = spark.sparkContext
    sc.setJobGroup("boosted-trees", "")
    try:
        B.fit_boosted(rows, edges, p)
        jobs = sc.statusTracker().getJobIdsForGroup("boosted-trees")
    finally:
        sc._jsc.clearJobGroup()
    assert len(jobs) <= 3 * 4 + 6


def test_no_rows_give_leaves_without_value(spark):
    assert [t.value for t in B.fit_boosted(spark.createDataFrame([], SCHEMA), [[0.0]], B.BoostingParams(trees=2))] == [[0.0], [0.0]]
