import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from shopgrain.config import DEFAULT
from shopgrain.operators import churn, classify, features

CUT = dt.date(2024, 6, 1)


@pytest.fixture(scope="module")
def tx(make_tx):
    return make_tx([
        dict(customer_id="A", day=10, total_amount=100.0, returned=1), dict(customer_id="A", day=140, total_amount=50.0, discount=0.1), dict(customer_id="A", day=200),
        dict(customer_id="B", day=100, total_amount=80.0), dict(customer_id="N", day=190),
    ])


def test_features_and_label_at_cutoff(tx):
    got = {r["customer_id"]: r for r in churn.cutoff_features(tx, CUT).collect()}
    assert set(got) == {"A", "B"}, "customers without history drop out"
    a = got["A"]
    assert (a["frequency"], a["monetary"], a["net_monetary"], a["return_rate"], a["churn"]) == (2, 150, 50, 0.5, 0)
    assert (a["recency_days"], a["tenure_days"], a["last_order_was_return"], a["discount_usage_rate"]) == (12, 142, 0, 0.5)
    assert got["B"]["churn"] == 1


def test_lookback_limits_everything_but_tenure_and_recency(tx):
    cfg = replace(DEFAULT, churn=replace(DEFAULT.churn, lookback_days=30))
    got = {r["customer_id"]: r for r in churn.cutoff_features(tx, CUT, cfg).collect()}
    assert (got["A"]["frequency"], got["A"]["tenure_days"]) == (1, 142)
    assert (got["B"]["frequency"], got["B"]["monetary"], got["B"]["recency_days"], got["B"]["avg_order_value"]) == (0, 0, 52, None)


def test_labels_match_the_one_pass_form(tx):
    one = {r["customer_id"]: r["churn"] for r in churn.cutoff_features(tx, CUT).collect()}
    people = churn.with_history(tx.select("customer_id").distinct(), tx, CUT)
    assert {r["customer_id"]: r["churn"] for r in churn.churn_labels(people, tx, CUT).collect()} == one


def test_split_is_stratified_exact_and_repeatable(spark):
    df = spark.createDataFrame([(f"C{i}", int(i % 4 == 0)) for i in range(400)], "customer_id string, churn int")
    a = churn.stratified_split(df)
    n = {(r["churn"], r["is_train"]): r["count"] for r in a.groupBy("churn", "is_train").count().collect()}
    assert n == {(0, True): 240, (0, False): 60, (1, True): 80, (1, False): 20}
    assert sorted(a.collect()) == sorted(churn.stratified_split(df.repartition(3)).select(*a.columns).collect())


def test_loyalty_uses_train_rows_only(spark):
    df = spark.createDataFrame([("a", 0, 1, 10.0, True), ("b", 9, 5, 50.0, True), ("c", 0, 9, 90.0, False)],
                               "customer_id string, recency_days int, frequency bigint, monetary double, is_train boolean")
    got = {r["customer_id"]: r["loyalty_score"] for r in churn.min_max_loyalty(df, df.where("is_train")).collect()}
    assert got["a"] == pytest.approx(1 / 3) and got["b"] == pytest.approx(2 / 3) and got["c"] == pytest.approx((1 + 2 + 2) / 3)


def test_equal_quantiles_are_nudged(spark):
    df = spark.createDataFrame([(0.5,)] * 10, "churn_probability double")
    assert {r["risk_level"] for r in churn.risk_levels(df).collect()} == {"Medium"}
    by = spark.createDataFrame([(0.3,), (0.31,), (0.7,), (0.71,)], "churn_probability double")
    assert [r["risk_level"] for r in churn.risk_levels(by, method="threshold").orderBy("churn_probability").collect()] == ["Low", "Medium", "Medium", "High"]


def test_feature_sets():
    assert churn.feature_columns("composite")[0] == "recency_days"
    with pytest.raises(ValueError):
        churn.feature_columns("other")


@pytest.fixture(scope="module")
def separable(spark):
    rows = [(f"C{i}", int(i % 3 == 0), i % 5 != 0, float((i % 3 == 0) * 2 + (i * 7 % 10) / 10), float(i % 11)) for i in range(300)]
    return spark.createDataFrame(rows, "customer_id string, churn int, is_train boolean, signal double, noise double")


def test_models_learn_and_score(separable, spark, tmp_path):
    from shopgrain.sources import writers

    cols = ["signal", "noise"]
    models = classify.train_models(separable, cols, trees=10, boosts=5)
    m = classify.compare_models(classify.evaluate_all(models, separable.where("not is_train"), cols))
    assert all(r["roc_auc"] > 0.95 and r["f1_check"] == "PASS" for r in m.collect()) and m.count() == 3
    imp = classify.feature_importance(models["Random Forest"], cols, "rf", spark).collect()
    assert imp[0]["feature"] == "signal" and imp[-1]["cumulative_pct"] == pytest.approx(100)
    writers.export_model(models["Logistic Regression"], cols, m, str(tmp_path))
    again = classify.score(writers.load_model(str(tmp_path)), separable, cols)
    first = classify.score(models["Logistic Regression"], separable, cols)
    assert sorted(again.select("customer_id", "churn_probability").collect()) == sorted(first.select("customer_id", "churn_probability").collect())


def test_auc_counts_ties_as_half(spark):
    rows = [(1, 0.9, 1), (0, 0.9, 1), (1, 0.4, 0), (0, 0.1, 0), (0, 0.4, 0)]
    df = spark.createDataFrame(rows, "churn int, churn_probability double, churn_prediction int")
    pos, neg = [s for y, s, _ in rows if y], [s for y, s, _ in rows if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / 6
    r = classify.classification_metrics(df, "m").first()
    assert r["roc_auc"] == pytest.approx(auc) and (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 2)


def test_vif(spark):
    import random
    rng = random.Random(1)
    rows = [(a := rng.random(), b := rng.random(), a + b, 1.0) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, s double, k double")
    ok = {r["feature"]: r["vif"] for r in features.vif(df, ["a", "b", "k"]).collect()}
    assert set(ok) == {"a", "b"} and all(1 <= v < 1.2 for v in ok.values())
    assert all(r["vif"] > 1e6 and not r["passed"] for r in features.vif(df, ["a", "b", "s"]).collect())


def test_models_score_after_the_session_has_observed_a_metric(spark):
    from pyspark.sql import Observation

    seen = Observation("rows")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    data = spark.createDataFrame([(f"C{i}", i % 2, i % 5 > 0, float(i % 7), float(i % 2 * 3 + i % 3)) for i in range(80)], "customer_id string, churn int, is_train boolean, a double, b double")
    models = classify.train_models(data, ["a", "b"], trees=3, boosts=2)
    assert classify.evaluate_all(models, data.where("not is_train"), ["a", "b"]).count() == 3


def test_features_at_the_cutoff_are_built_once(tx, monkeypatch):
    """The split, the scaling and the result read one written table."""
    written, real = [], churn.materialized
    monkeypatch.setattr(churn, "materialized", lambda df: written.append(df.columns) or real(df))
    plan = churn.churn_dataset(tx)._jdf.queryExecution().executedPlan().toString()
    assert len(written) == 1 and "last_order_was_return" in written[0] and "max_by" not in plan


def test_models_are_not_written_to_lose_their_summary(separable, spark):
    """A forest of many nodes takes long to write; training rows lie in a part for each so many rows where cores allow."""
    from unittest import mock

    from pyspark.ml.util import JavaMLWriter

    with mock.patch.object(JavaMLWriter, "save", side_effect=AssertionError("written")), mock.patch.object(classify, "TRAIN_ROWS", 100):
        models = classify.train_models(separable, ["signal", "noise"], trees=3, names=["Random Forest", "Logistic Regression"])
        assert classify._dealt(separable.coalesce(1)).rdd.getNumPartitions() == 3
    assert not any(m.stages[-1].hasSummary for m in models.values())
    assert classify._dealt(separable.coalesce(1)).rdd.getNumPartitions() == 1
