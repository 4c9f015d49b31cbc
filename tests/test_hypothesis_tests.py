"""Statistics and tails against values worked out by hand or by textbook tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shopgrain.functions import dist
from shopgrain.operators import hypothesis as h


def test_tails_match_tables():
    assert dist.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-8)
    assert dist.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert dist.chi2_tail(18.307038053, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.chi2_tail(22.0, 22) == pytest.approx(0.4599, abs=1e-3)
    assert dist.f_tail(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-8)
    assert dist.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)


def brute_ranks(values):
    s = sorted(values)
    return [s.index(v) + (s.count(v) + 1) / 2 for v in values]


@pytest.fixture(scope="module")
def tied(spark):
    rng = random.Random(11)
    return [(rng.choice("abc"), float(rng.randrange(8))) for _ in range(120)]


def test_kruskal_with_ties(spark, tied):
    ranks, n = brute_ranks([v for _, v in tied]), len(tied)
    groups = {g: [r for (x, _), r in zip(tied, ranks) if x == g] for g in "abc"}
    hstat = 12 / (n * (n + 1)) * sum(sum(r) ** 2 / len(r) for r in groups.values()) - 3 * (n + 1)
    vals = [v for _, v in tied]
    hstat /= 1 - sum(vals.count(v) ** 3 - vals.count(v) for v in set(vals)) / (n**3 - n)
    r = h.kruskal_wallis(spark.createDataFrame(tied, "g string, v double"), "v", "g").first()
    assert r["statistic"] == pytest.approx(hstat) and r["p_value"] == pytest.approx(math.exp(-hstat / 2))


def test_mann_whitney_counts_pairs(spark, tied):
    rows = [(int(g == "a"), v) for g, v in tied]
    a, b = [v for f, v in rows if f], [v for f, v in rows if not f]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    r = h.mann_whitney(spark.createDataFrame(rows, "f int, v double"), "v", "f").first()
    assert r["u_statistic"] == u and r["rank_biserial"] == pytest.approx(1 - 2 * u / (len(a) * len(b))) and 0 < r["p_value"] <= 1


def test_pairwise_equals_separate_tests(spark, tied):
    df = spark.createDataFrame(tied, "g string, v double")
    for r in h.pairwise_mann_whitney(df, "v", "g").collect():
        two = df.where(F.col("g").isin(r["group_a"], r["group_b"])).select((F.col("g") == r["group_a"]).cast("int").alias("f"), "v")
        one = h.mann_whitney(two, "v", "f").first()
        assert r["u_statistic"] == one["u_statistic"] and r["p_value"] == pytest.approx(one["p_value"])


@pytest.mark.parametrize("block", [1, 1_000])
def test_pairwise_over_ranges(spark, monkeypatch, tmp_path, block):
    """Many ranges, ties, labels without a value, null labels; rows are not copied once per pair."""
    monkeypatch.setattr("shopgrain.functions.ranks.ROWS_PER_RANGE", 6)
    rng = random.Random(3)
    rows = [(g, float(rng.randrange(20)) if rng.random() < 0.5 else rng.random() * 20) for g in "abcd" for _ in range(25)]
    df = spark.createDataFrame([*rows, ("e", None), (None, 1.0), ("a", None)], "g string, v double")
    got = {(r["group_a"], r["group_b"]): r for r in h.pairwise_mann_whitney(df, "v", "g", block=block).collect()}
    assert set(got) == {(a, b) for a in "abcd" for b in "abcde" if a < b}
    for (a, b), r in got.items():
        x, y = ([v for g, v in rows if g == s] for s in (a, b))
        assert r["n_a"] == len(x) and r["n_b"] == (len(y) or None)
        assert r["u_statistic"] == sum((p > q) + 0.5 * (p == q) for p in x for q in y)
        if y:
            one = h.mann_whitney(spark.createDataFrame([(1, v) for v in x] + [(0, v) for v in y], "f int, v double"), "v", "f").first()
            assert r["p_value"] == pytest.approx(one["p_value"]) and r["significant"] == (one["p_value"] < 0.05 / 10)


def test_pairwise_does_not_spread_rows_over_pairs(spark):
    df = spark.range(30_000).select((F.col("id") % 10).cast("string").alias("g"), (F.col("id") * 0.7).alias("v"))
    made = []
    real = h.checkpointed
    try:
        h.checkpointed = lambda d: made.append(d.count()) or real(d)
        assert h.pairwise_mann_whitney(df, "v", "g").count() == 45
    finally:
        h.checkpointed = real
    assert max(made) <= 30_000


def test_spearman_perfect_and_ties(spark):
    df = spark.createDataFrame([(i, i * i) for i in range(1, 30)], "x int, y int")
    assert h.spearman(df, "x", "y").first()["rho"] == pytest.approx(1)
    rows = [(1, 1), (2, 1), (2, 3), (3, 2), (4, 4)]
    a, b = brute_ranks([x for x, _ in rows]), brute_ranks([y for _, y in rows])
    ma, mb = sum(a) / 5, sum(b) / 5
    rho = sum((p - ma) * (q - mb) for p, q in zip(a, b)) / math.sqrt(sum((p - ma) ** 2 for p in a) * sum((q - mb) ** 2 for q in b))
    assert h.spearman(spark.createDataFrame(rows, "x int, y int"), "x", "y").first()["rho"] == pytest.approx(rho)


def test_anova_textbook(spark):
    rows = [("a", v) for v in (6, 8, 4, 5, 3, 4)] + [("b", v) for v in (8, 12, 9, 11, 6, 8)] + [("c", v) for v in (13, 9, 11, 8, 7, 12)]
    r = h.anova(spark.createDataFrame(rows, "g string, v int"), "v", "g").first()
    assert r["statistic"] == pytest.approx(9.2647, abs=1e-4) and r["p_value"] == pytest.approx(0.0023988, abs=1e-5)


def test_chi_square_and_yates(spark):
    rows = [("m", "y")] * 20 + [("m", "n")] * 30 + [("f", "y")] * 30 + [("f", "n")] * 20
    df = spark.createDataFrame(rows, "a string, b string")
    assert h.chi_square(df, "a", "b").first()["chi2"] == pytest.approx(4.0)
    assert h.chi_square(df, "a", "b", yates=True).first()["chi2"] == pytest.approx(3.24)
    assert h.chi_square(df, "a", "b").first()["p_value"] == pytest.approx(0.0455, abs=1e-4)


def test_kappa(spark):
    rows = [(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15
    assert h.flag_agreement(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()["kappa"] == pytest.approx(0.4)


def test_missingness_labels(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        other = rng.random() * 100
        rows.append((None if other > 70 else rng.uniform(50, 60), other, rng.random()))
    df = spark.createDataFrame(rows, "v double, other double, noise double")
    assert h.missingness_mechanism(df, "v", ["other", "noise"]).first()["mechanism"] == "MAR"
    full = df.withColumn("v", F.coalesce("v", F.lit(55.0)))
    assert h.missingness_mechanism(full, "v", ["other", "noise"]).first()["mechanism"] == "NO_MISSING"


def test_missingness_looks_at_all_columns(spark):
    """Twelve columns, of which only the last carries the signal."""
    names = [f"c{i:02d}" for i in range(12)]
    rows = [(None if i % 2 else float(i), *[float((i * 7 + j) % 5) for j in range(11)], float(i % 2 * 100 + i % 3)) for i in range(120)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in ["v", *names]))
    r = h.missingness_mechanism(df, "v", names).first()
    assert r.tests == 12 and r.mechanism == "MAR"


def test_two_thousand_labels_pair_in_blocks(spark):
    """1,999,000 pairs, each once and in order; no task has more than a tenth of them; labels are no literals of the plan."""
    rates = spark.range(2000).selectExpr("format_string('L%05d', id) AS label", "id % 50 AS k", "100 + id % 7 AS n")
    out = h.two_proportion_pairs(rates, "label", "k", "n", p_value=False)
    assert out.where("label_a < label_b").distinct().count() == out.count() == 1_999_000
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("t")).count().collect()]
    assert len(tasks) > 15 and max(tasks) < 1_999_000 / 10
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "L00017" not in plan and len(plan) < 20_000


def test_pairs_of_few_labels(spark):
    one = spark.createDataFrame([("a", 1)], "label string, x int")
    assert h.label_pairs(one, ["label", "x"]).count() == 0
    assert h.label_pairs(one.where("x = 2"), ["label", "x"]).count() == 0
    three = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "label string, x int")
    for block in (1, 2, 256):
        got = {(r.a.label, r.b.label, r.pairs) for r in h.label_pairs(three, ["label", "x"], block).collect()}
        assert got == {(None, "a", 3), (None, "b", 3), ("a", "b", 3)}
