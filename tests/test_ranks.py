"""Order statistics against brute force, also with many value ranges."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from shopgrain.functions import ranks


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 7)


def brute(values):
    return {v: (values.count(v), sum(x < v for x in values)) for v in set(values)}


def test_ranks_across_ranges(spark, small_ranges):
    rng = random.Random(3)
    values = [float(rng.choice([0, 0, 0, rng.randrange(400), rng.random() * 1e6])) for _ in range(900)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    got = {r["v"]: (r["n"], r["before"]) for r in ranks.value_ranks(df, "v").collect()}
    assert got == brute(values)


def test_quantiles_by_group(spark, small_ranges):
    rng = random.Random(5)
    rows = [(g, float(rng.randrange(50))) for g in "abc" for _ in range(rng.randrange(30, 200))]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"q25": 0.25, "q50": 0.5, "q95": 0.95, "lo": 0.0, "hi": 1.0}
    for r in ranks.quantiles(df, "v", probs, by=["g"]).collect():
        own = [v for g, v in rows if g == r["g"]]
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(own, p))


def test_hot_value(spark, small_ranges):
    values = [1.0] * 5000 + [float(i) for i in range(2, 60)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert ranks.quantiles(df, "v", {"m": 0.5}).first()["m"] == 1.0
    top = ranks.top_share(df, "v", 0.2).first()
    assert top["top_n"] == 1011 and top["top_value"] == sum(sorted(values)[-1011:])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40))
def test_rank_sum_invariant(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    r = ranks.average_ranks(df, "v").collect()
    n = len(values)
    assert sum(x["avg_rank"] * x["n"] for x in r) == pytest.approx(n * (n + 1) / 2)


def test_extra_sums(spark, small_ranges):
    rows = [(float(i % 40), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "v double, p bigint")
    for r in ranks.value_ranks(df, "v", sums=["p"]).collect():
        assert r["p_before"] == sum(p for v, p in rows if v < r["v"]) and r["p_total"] == sum(p for _, p in rows)


def test_quantiles_write_little_and_stay_exact(spark, monkeypatch):
    """60,000 different values and 60,000 with heavy ties in two groups, one of them without a name: positions inside and at brackets' ends are exact, and a few hundred rows are kept."""

    rng = np.random.default_rng(3)
    wide, ties = rng.normal(size=60_000), np.round(rng.exponential(size=60_000), 1)
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 60_000 + [None] * 60_000, "v": np.append(wide, ties)}), "g string, v double").repartition(5)
    probs = {"lo": 0.0, "a": 0.05, "m": 0.5, "b": 0.5001, "c": 0.999, "hi": 1.0}
    kept = ranks._collapsed(df, "v", list(probs.values()), ["g"])
    assert kept.where("g = 'a'").count() < 1_500 and kept.agg(F.sum("n")).first()[0] == 120_000
    got = {r["g"]: r for r in ranks.quantiles(df, "v", probs, by=["g"]).collect()}
    for g, x in (("a", wide), (None, ties)):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-12)
    alone = ranks.quantiles(df.where("g = 'a'"), "v", {"m": 0.95}).first()["m"]
    assert alone == pytest.approx(np.quantile(wide, 0.95), rel=1e-12)
    monkeypatch.setattr(ranks, "SENT_GROUPS", 0)
    assert {r["g"]: r["m"] for r in ranks.quantiles(df, "v", {"m": 0.5}, by=["g"]).collect()} == {g: got[g]["m"] for g in got}


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert ranks.quantiles(empty, "v", {"m": 0.5}, by=["g"]).count() == 0
    assert ranks.quantiles(empty, "v", {"m": 0.5}).first()["m"] is None


def test_brackets_are_compiled(spark):
    """Rows are compared with the brackets by plain expressions; the ranks do not change."""
    df = spark.range(25_000).selectExpr("cast((id * 7919) % 25000 AS double) AS v", "id % 2 AS g")
    for by in ([], ["g"]):
        d = ranks._collapsed(df, "v", [0.25, 0.5, 0.99], by)
        assert "lambda" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert ranks.quantiles(df, "v", {"m": 0.5, "t": 0.99}).first().asDict() == {"m": 12_499.5, "t": 24_749.01}
