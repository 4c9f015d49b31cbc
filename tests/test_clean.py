import pytest
from pyspark.sql import functions as F, types as T

from shopgrain.config import DEFAULT
from shopgrain.functions.expr import redact
from shopgrain.operators import clean, quality
from shopgrain.operators.customers import customer_features
from shopgrain.sources.tables import TRANSACTION_SCHEMA

RAW = T.StructType([
    T.StructField(f.name, T.StringType() if f.name in ("order_date", "returned") else f.dataType, True) for f in TRANSACTION_SCHEMA.fields
])


def raw(make_tx, rows):
    return make_tx([{"order_date": "2024-01-05", "returned": "No", **r} for r in rows], RAW)


def test_dedup_keeps_first_in_total_order(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert sorted(map(tuple, clean.dedup_keep_first(df, "k", ["o", "v"]).collect())) == [("a", 1, "y"), ("b", 1, "z")]


def test_clean_drops_duplicates_and_bad_dates(make_tx):
    df = raw(make_tx, [dict(order_id="O001"), dict(order_id="O001"), dict(order_id="O002"), dict(order_id="O003", order_date="invalid-date")])
    out = clean.clean_transactions(df)
    assert {r["order_id"] for r in out.collect()} == {"O001", "O002"} and out.count() == 2


def test_text_and_flags(make_tx):
    df = raw(make_tx, [dict(category=c) for c in ("electronics", "ELECTRONICS", "  electronics  ", None, "")])
    assert [r["category"] for r in clean.normalize_categories(df).orderBy("order_id").collect()] == ["Electronics"] * 3 + ["Unknown"] * 2
    df = raw(make_tx, [dict(returned=v) for v in ("yes", "YES", "y", "no", "NO", "n", None, "maybe")])
    assert [r["returned"] for r in clean.decode_flag(df).orderBy("order_id").collect()] == [1, 1, 1, 0, 0, 0, 0, 0]


def test_imputation(make_tx):
    df = raw(make_tx, [dict(price=10.0, region="West"), dict(price=None, region=None), dict(price=30.0, region="East"), dict(price=50.0, region="East")])
    out = clean.impute(df).orderBy("order_id").collect()
    assert out[1]["price"] == 30.0 and out[1]["region"] == "East"
    assert not any(v is None for r in out for v in r)


def test_negative_money(make_tx):
    df = make_tx([dict(price=-5.0), dict(price=7.0)])
    assert [r["price"] for r in clean.clip_negative_money(df).orderBy("order_id").collect()] == [0.0, 7.0]
    with pytest.raises(Exception, match="negative price"):
        clean.clip_negative_money(df, auto_fix=False).collect()


@pytest.mark.parametrize("change, check", [
    (dict(price=-1.0), "positive_price"), (dict(discount=1.5), "discount_range"), (dict(quantity=0), "positive_quantity"),
    (dict(order_id="O000"), "unique_order_id"), (dict(delivery_time_days=None), "null_columns"), (dict(customer_age=150), "age_range"), (dict(returned=2), "binary_returned"),
])
def test_gate_finds_defects(make_tx, change, check):
    good = make_tx([dict(day=i) for i in range(3)])
    assert {r["status"] for r in quality.sanity_checks(good, customer_features(good)).collect()} == {"PASS"}
    bad = make_tx([dict(day=0), dict(day=1, **change)])
    got = {r["check_name"]: r["status"] for r in quality.sanity_checks(bad).collect()}
    assert got[check] in ("FAIL", "WARN")


def test_quality_score(make_tx):
    q = quality.quality_score(make_tx([dict(day=i) for i in range(3)])).first()
    assert q["quality_score"] == pytest.approx(100)
    assert quality.quality_score(make_tx([dict(day=i) for i in range(3)]), 10).first()["retention_rate"] == pytest.approx(30)
    bad = make_tx([dict(price=-50.0), dict(discount=1.5), dict(quantity=0)])
    assert quality.quality_score(bad).first()["violations"] == 3


def test_schema_contract(make_tx):
    good = make_tx([dict()])
    assert quality.enforce_schema(good, TRANSACTION_SCHEMA) is good
    with pytest.raises(quality.ContractError, match="discount le_1"):
        quality.enforce_schema(make_tx([dict(discount=2.0)]), TRANSACTION_SCHEMA)
    with pytest.raises(quality.ContractError, match="unexpected"):
        quality.enforce_schema(good.withColumn("more", F.lit(1)), TRANSACTION_SCHEMA)
    assert quality.check_kinds(good, {"price": "numeric", "order_date": "datetime", "region": "numeric", "nope": "any"}) == ["region: not numeric", "nope: missing"]


def test_fingerprint_ignores_row_order(make_tx):
    df = make_tx([dict(total_amount=float(i)) for i in range(20)])
    assert quality.fingerprint(df).first() == quality.fingerprint(df.orderBy(F.desc("order_id"))).first()


def test_redaction(spark):
    texts = [("C12345 wrote",), ("mail a.b@example.com now",), ("call 555-123-4567",), ("card 4111 1111 1111 1111",)]
    out = [r[0] for r in spark.createDataFrame(texts, "t string").select(redact(F.col("t"))).collect()]
    assert out == ["[REDACTED_CUSTOMER_ID] wrote", "mail [REDACTED_EMAIL] now", "call [REDACTED_PHONE]", "card [REDACTED_CC]"]


def test_incomplete_month(make_tx):
    from dataclasses import replace
    from shopgrain.operators.sales import complete_months

    cfg = replace(DEFAULT, sales=replace(DEFAULT.sales, incomplete_month_cutoff=None))
    assert complete_months(make_tx([dict(day=0), dict(day=35)]), cfg).count() == 1
    assert complete_months(make_tx([dict(day=0), dict(day=59)]), cfg).count() == 2


def test_copies_are_found_within_what_an_order_id_determines(spark):
    rows = [("1-1", 1, "b"), ("1-1", 1, "a"), ("1-2", 1, "c"), ("2-1", 2, "e"), ("2-1", 2, "d"), (None, None, "z"), (None, None, "y")]
    df = spark.createDataFrame([(i, k, "2024-01-01", c, 5.0, "yes") for i, k, c in rows], "order_id string, k long, order_date string, category string, total_amount double, returned string")
    by = lambda out: sorted(map(str, out.collect()))
    assert by(clean.clean_transactions(df, within=("k",))) == by(clean.clean_transactions(df.drop("k"))) and clean.clean_transactions(df, within=("k",)).count() == 4
