import pytest
from pyspark.sql import functions as F

from shopgrain.operators import fraud
from shopgrain.operators.customers import customer_features


def test_velocity(make_tx):
    r = fraud.velocity(make_tx([dict(day=d) for d in (0, 3, 7, 8)])).first()
    assert (r["max_orders_7d"], r["max_orders_30d"], r["min_order_gap_days"], r["velocity_burst_flag"]) == (3, 4, 1, 1)
    gaps = [3, 4, 1]
    mean = sum(gaps) / 3
    assert r["gap_cv"] == pytest.approx((sum((g - mean) ** 2 for g in gaps) / 2) ** 0.5 / mean)


def test_velocity_edge_cases(make_tx):
    one = fraud.velocity(make_tx([dict(day=4)])).first()
    assert (one["max_orders_7d"], one["gap_cv"], one["min_order_gap_days"]) == (1, 0, 0)
    two = fraud.velocity(make_tx([dict(day=0), dict(day=9)])).first()
    assert (two["max_orders_7d"], two["gap_cv"], two["min_order_gap_days"]) == (1, 0, 9)
    same = fraud.velocity(make_tx([dict(day=0)] * 4)).first()
    assert (same["max_orders_7d"], same["gap_cv"], same["min_order_gap_days"]) == (4, 0, 0)


def test_concentration(make_tx):
    tx = make_tx([dict(category=c, payment_method=p) for c, p in (("a", "x"), ("a", "x"), ("b", "x"), ("c", "y"))])
    r = fraud.concentration(tx).first()
    assert (r["category_hhi"], r["n_payment_methods"], r["payment_concentration"]) == (0.375, 2, 0.75)


def test_hot_customer_equals_small_one(make_tx):
    """A customer with thousands of orders on few days goes through the same reduced rows."""
    tx = make_tx([dict(customer_id="HOT", day=i % 9) for i in range(3000)] + [dict(customer_id="C2", day=i) for i in range(5)])
    got = {r["customer_id"]: r for r in fraud.fraud_features(tx, customer_features(tx)).collect()}
    assert got["HOT"]["max_orders_7d"] == sum(1 for i in range(3000) if i % 9 <= 7)
    assert got["HOT"]["order_count"] == 3000 and got["HOT"]["order_value_cv"] == 0
    assert got["C2"]["max_orders_7d"] == 5


def test_features_shuffle_and_sort_narrow_rows(make_tx, tmp_path):
    """Amounts travel in one aggregate by customer; windows and counts by day and label carry no amount."""
    make_tx([{"customer_id": f"C{i % 3}", "day": i} for i in range(9)]).write.parquet(f"{tmp_path}/tx")
    tx = make_tx([]).sparkSession.read.parquet(f"{tmp_path}/tx")
    plans, real = [], fraud.materialized
    try:
        fraud.materialized = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df)
        assert fraud.fraud_features(tx, customer_features(tx)).count() == 3
    finally:
        fraud.materialized = real
    assert "total_amount" in plans[0]
    assert not any(" Sort [customer_id" in line and ("category" in line or "payment" in line) for line in plans[0].splitlines())


def test_null_customer_and_dates_keep_their_row(make_tx, spark):
    from pyspark.sql import functions as F

    tx = make_tx([{"customer_id": "C1", "day": d, "category": k} for d, k in ((0, "a"), (0, "b"), (9, "a"), (9, "a"), (30, "a"))])
    tx = tx.withColumns({"customer_id": F.when(F.col("order_date") > "2024-01-20", None).otherwise(F.col("customer_id")), "order_date": F.when(F.col("order_date") > "2024-01-05", F.col("order_date"))})
    got = {r["customer_id"]: r for r in fraud.fraud_features(tx, customer_features(tx)).collect()}
    assert set(got) == {"C1", None} and got[None]["category_hhi"] == 1 and got[None]["max_orders_7d"] == 1
    r = got["C1"]
    assert (r["order_count"], r["max_orders_7d"], r["n_payment_methods"], r["category_hhi"], r["min_order_gap_days"]) == (4, 2, 1, (9 + 1) / 16, 0)


def test_rules_and_tiers(spark):
    cols = ["return_rate", "max_discount_rate", "high_discount_return_rate", "max_orders_7d", "negative_margin_rate", "high_value_rate_p99", "category_hhi"]
    rows = [("a", 0.2, 0.8, 0.2, 3.0, 0.5, 0.2, 0.9), ("b", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), ("c", 0.1, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "customer_id string, " + ", ".join(f"{c} double" for c in cols))
    got = {r["customer_id"]: r for r in fraud.rule_scores(df).collect()}
    assert got["a"]["rule_fraud_score"] == pytest.approx(1.0) and got["a"]["rule_fraud_score_norm"] == 1.0
    assert got["b"]["rule_fraud_score"] == 0
    assert got["c"]["rule_fraud_score"] == pytest.approx(0.2 * 0.5 + 0.15 * 0.5)
    tiers = spark.createDataFrame([(v,) for v in (0.8, 0.79, 0.6, 0.35, 0.34)], "composite_fraud_score double")
    assert [r["risk_tier"] for r in fraud.assign_risk_tiers(tiers).orderBy(F.desc("composite_fraud_score")).collect()] == ["Critical", "High", "High", "Medium", "Low"]


def test_typology_order(spark):
    schema = "id int, return_rate double, max_discount_rate double, avg_discount double, velocity_burst_flag int, negative_margin_rate double, high_value_rate_p99 double"
    rows = [(1, 0.5, 0.9, 0.2, 1, 0.0, 0.0), (2, 0.5, 0.9, 0.1, 0, 0.0, 0.0), (3, 0.0, 0.0, 0.0, 0, 0.6, 0.3), (4, 0.0, 0.0, 0.0, 0, 0.0, 0.2)]
    got = [r["primary_typology"] for r in fraud.typology(spark.createDataFrame(rows, schema)).orderBy("id").collect()]
    assert got == ["Combined Attack", "Return Abuse", "Margin Exploitation", "Unclassified"]


def test_exposure_buckets_are_exclusive(make_tx, spark):
    tx = make_tx([
        dict(customer_id="H", returned=1, discount=0.3, total_amount=70.0, profit_margin=-1.0),
        dict(customer_id="H", discount=0.1, price=50.0, quantity=2, profit_margin=-4.0), dict(customer_id="H", profit_margin=-7.0),
        dict(customer_id="L", returned=1, total_amount=40.0)])
    prof = spark.createDataFrame([("H", "Critical"), ("L", "Low")], "customer_id string, risk_tier string")
    e = fraud.exposure(tx, prof).first()
    assert (e["return_exposure_high_risk"], e["discount_exposure_high_risk"], e["neg_margin_exposure_high_risk"]) == (70, 10, 7)
    assert e["total_exposure_all"] == 127 and e["total_overlap_orders"] == 3 and e["high_risk_pct"] == 50


def test_risk_queries_join_the_lines_once(spark, sf, monkeypatch):
    """Features, segments and exposure read one written table of the transactions."""
    from shopgrain.registry import fraud as queries

    wide = []
    plain = queries.transactions

    def counted(s, d, columns=None):
        wide.extend([columns] if columns is None or "region" in columns else [])
        return plain(s, d, columns)

    monkeypatch.setattr(queries, "transactions", counted)
    queries._merged(spark, sf)
    assert len(wide) == 1
    tx = queries._tx(spark, sf, "price")
    assert not any("Join" in line for line in tx._jdf.queryExecution().toString().splitlines())


def test_high_risk_transactions_of_repeated_parts(spark, sf, tmp_path):
    """A part that is listed twice does not list its lines twice."""
    from shopgrain.registry import fraud as queries

    for name in ("lineitem", "orders", "customer", "part", "nation", "region"):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        (df.unionByName(df) if name == "part" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    once = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").count().agg({"count": "max"}).first()[0]
    got = queries.QUERIES["high_risk_transactions"](spark, str(tmp_path)).groupBy("order_id").count().agg({"count": "max"}).first()[0]
    assert got is None or got <= once
