import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from shopgrain.config import DEFAULT
from shopgrain.operators.customers import customer_features
from shopgrain.sources import cache, readers, writers
from shopgrain.sources.tables import TRANSACTION_COLUMNS, TRANSACTION_SCHEMA, transactions

LINE = "O{i},C001,P1,{date},Electronics,North,Female,Card,100,0.1,1,90,5,10,30,3,{ret}"


@pytest.fixture
def csv(tmp_path):
    def write(lines, name="raw.csv"):
        p = tmp_path / name
        p.write_text(",".join(TRANSACTION_COLUMNS) + "\n" + "\n".join(lines) + "\n")
        return str(p)

    return write


def test_csv_reader_and_contract(spark, csv):
    path = csv([LINE.format(i=i, date="2024-01-05", ret="No") for i in range(5)])
    df = readers.read_raw_csv(spark, path)
    assert df.count() == 5 and df.schema["price"].dataType.simpleString() == "double" and df.first()["returned"] == "No"
    bad = csv([LINE.format(i=0, date="oops", ret="No")], "bad.csv")
    with pytest.raises(ValueError, match="order_date not_null"):
        readers.read_raw_csv(spark, bad)
    assert readers.read_raw_csv(spark, bad, validate=False).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_raw_csv(spark, path + ".none")


def test_many_files_equal_one(spark, csv, tmp_path):
    lines = [LINE.format(i=i, date="2024-01-05", ret="Yes") for i in range(30)]
    whole = readers.read_raw_csv(spark, csv(lines, "whole.csv"))
    parts = readers.read_raw_csv(spark, [csv(lines[:11], "p1.csv"), csv(lines[11:], "p2.csv")])
    assert sorted(whole.collect()) == sorted(parts.collect())


def test_verified_write_round_trip(spark, make_tx, tmp_path):
    tx = make_tx([dict(day=i) for i in range(7)])
    back = writers.write_verified(tx, f"{tmp_path}/t")
    assert back.columns == tx.columns and sorted(back.collect()) == sorted(tx.collect())
    assert [f.dataType for f in back.schema] == [f.dataType for f in tx.schema]
    writers.write_verified(tx.limit(2), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2


def test_processed_status(spark, make_tx, tmp_path):
    tx = make_tx([dict(day=i) for i in range(3)])
    writers.save_processed(tx, customer_features(tx), str(tmp_path))
    assert {r["status"] for r in writers.processed_status(spark, str(tmp_path)).collect()} == {"found"}
    assert writers.load_processed(spark, str(tmp_path))[1].count() == 1
    other = tmp_path / "other"
    (other / "transactions.parquet").mkdir(parents=True)
    (other / "transactions.parquet" / "part-0.parquet").write_text("not parquet")
    got = {r["table_name"]: r["status"] for r in writers.processed_status(spark, str(other)).collect()}
    assert got == {"transactions": "corrupted", "customers": "missing"}


def test_readers_check_columns_and_fingerprint(spark, make_tx, tmp_path):
    from shopgrain.operators.quality import fingerprint

    tx = writers.write_verified(make_tx([dict(day=i) for i in range(3)]), f"{tmp_path}/tx")
    mark = fingerprint(tx).first()["fingerprint"]
    assert readers.read_transactions(spark, f"{tmp_path}/tx", expected_fingerprint=mark).count() == 3
    with pytest.raises(readers.InputError, match="fingerprint"):
        readers.read_transactions(spark, f"{tmp_path}/tx", expected_fingerprint="00000000")
    writers.write_verified(tx.drop("region"), f"{tmp_path}/less")
    with pytest.raises(ValueError, match="region"):
        readers.read_transactions(spark, f"{tmp_path}/less")


def test_fraud_inputs_repair_flags(spark, make_tx, tmp_path):
    tx = make_tx([dict(day=i) for i in range(2)]).withColumn("returned", F.lit(" YES"))
    writers.write_verified(tx, f"{tmp_path}/tx")
    writers.write_verified(customer_features(make_tx([dict()])), f"{tmp_path}/c")
    got, _, warn = readers.read_fraud_inputs(spark, f"{tmp_path}/tx", f"{tmp_path}/c", expected_rows=500)
    assert {r["returned"] for r in got.collect()} == {1} and len(warn) == 1


def test_segment_csv_fallbacks(spark, tmp_path):
    spark.createDataFrame([("C1", "Loyal")], "customer_id string, segment string").write.option("header", True).csv(f"{tmp_path}/seg")
    df = readers.read_segments(spark, [f"{tmp_path}/none", f"{tmp_path}/seg"])
    assert [(r["customer_id"], r["segment_name"]) for r in df.collect()] == [("C1", "Loyal")]
    assert readers.read_predictions(spark, [f"{tmp_path}/none"]).count() == 0
    with pytest.raises(readers.InputError):
        readers.read_segments(spark, [f"{tmp_path}/none"])


def test_cache_depends_on_data_and_settings(spark, make_tx, tmp_path):
    a, b = make_tx([dict(day=0)]), make_tx([dict(day=0, total_amount=5.0)])
    other = replace(DEFAULT, customer=replace(DEFAULT.customer, churn_days=60))
    assert len({cache.cache_key(a), cache.cache_key(b), cache.cache_key(a, other)}) == 3
    assert cache.cached_customers(a, str(tmp_path)).count() == cache.cached_customers(a, str(tmp_path)).count() == 1
    assert len(os.listdir(tmp_path)) == 1
    assert cache.clear_cache(spark, str(tmp_path), older_than_hours=24) == 0
    assert cache.clear_cache(spark, str(tmp_path)) == 1 and os.listdir(tmp_path) == []


def test_column_choice_does_not_change_rows(spark, sf):
    whole, few = transactions(spark, sf), transactions(spark, sf, ["order_id", "total_amount"])
    assert sorted(whole.select("order_id", "total_amount").collect()) == sorted(few.collect())
    with pytest.raises(ValueError):
        transactions(spark, sf, ["nope"])
    assert whole.columns == list(TRANSACTION_SCHEMA.fieldNames())


def test_bad_csv_lines_are_kept_apart(spark, tmp_path):
    from shopgrain.sources.tables import TRANSACTION_COLUMNS

    good = "O1,C1,P1,2024-01-02,Books,North,F,Card,10.5,0.1,2,9.45,1.0,3.0,30,4,Yes"
    lines = [
        good, good.replace("O1", "O2").replace("10.5", "ten"), good.replace("O1", "O3").replace("2024-01-02", "2024-13-40").replace(",2,", ",two,"), "O4,C1,P1",
        good.replace("O1", "O5") + ",extra", good.replace("O1", "O6").replace("Books", ""), good.replace("O1", "O7").replace(",4,", ",,"), '"O8,C1,P1',
    ]
    (tmp_path / "a.csv").write_text("\n".join([",".join(TRANSACTION_COLUMNS), *lines[:4]]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([",".join(TRANSACTION_COLUMNS), *lines[4:]]) + "\n")
    found = readers.read_checked_csv(spark, str(tmp_path))
    assert sorted(r["order_id"] for r in found.clean.collect()) == ["O1", "O7"]
    assert found.clean.count() == 2, "what is asked for does not change which lines are broken"
    row = found.clean.where("order_id = 'O1'").first()
    assert (row["price"], row["quantity"], row["returned"], str(row["order_date"])) == (10.5, 2, "Yes", "2024-01-02")
    bad = {r["line"]: r for r in found.quarantine.collect()}
    assert len(bad) == 6 and {r["file"].rsplit("/", 1)[1] for r in bad.values()} == {"a.csv", "b.csv"}
    assert bad[lines[1]]["reasons"] == ["price: not a double"]
    assert bad[lines[2]]["reasons"] == ["order_date: not a date", "quantity: not a int"]
    assert bad["O4,C1,P1"]["reasons"] == bad[lines[4]]["reasons"] == ["malformed line"]
    assert [r["reasons"] for r in bad.values() if r["order_id"] == "O6"] == [["category: empty"]]
    assert found.quarantine.select("reasons").count() == 6 and found.quarantine.where("line LIKE 'O4%'").first()["order_id"] == "O4"
