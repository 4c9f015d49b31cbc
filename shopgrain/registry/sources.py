"""Round trips through the readers and sinks: tables of the test data are written to the shared folder and read back."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators.customers import customer_features
from ..operators.quality import fingerprint
from ..session import shared_folder
from ..functions.expr import money_sum
from ..sources import cache, readers, versions, writers
from ..sources.tables import transactions
from . import cohorts as cohort_queries, customers as customer_queries, fraud as fraud_queries
from .base import CFG, TX, rounded

_COLUMNS = ["order_id", "customer_id", "order_date", "category", "quantity", "total_amount", "returned"]


def _folder(s):
    return f"{shared_folder(s)}/io-{uuid.uuid4().hex}"


def _stored(s, d):
    """Folder with both processed tables."""
    folder = _folder(s)
    tx = transactions(s, d)
    writers.save_processed(tx, customer_features(tx, CFG), folder)
    return folder, f"{folder}/transactions.parquet", f"{folder}/customers.parquet"


def _short(df):
    return rounded(df.select("order_id", "customer_id", F.col("order_date").cast("date").alias("order_date"), "category", F.col("quantity").cast("int").alias("quantity"), "total_amount", F.col("returned").cast("int").alias("returned")))


def _csv(s, d):
    path = _folder(s)
    writers.write_csv(transactions(s, d), path)
    return _short(readers.read_raw_csv(s, path, validate=False))


def _parquet(s, d):
    path = _folder(s)
    tx = transactions(s, d)
    writers.write_verified(tx, path)
    return _short(readers.read_transactions(s, path, expected_fingerprint=fingerprint(tx).first()["fingerprint"]))


def _sink(s, d):
    return _short(writers.write_verified(transactions(s, d), _folder(s), partition_by=("returned",)))


def _reload(s, d):
    folder, _, _ = _stored(s, d)
    return rounded(writers.load_processed(s, folder)[1], exact=("avg_order_value",))


def _status(s, d):
    folder, _, _ = _stored(s, d)
    return writers.processed_status(s, folder, ("transactions", "customers", "predictions"))


def _segmentation(s, d):
    _, tx, cust = _stored(s, d)
    return rounded(readers.read_segmentation_inputs(s, tx, cust)[1].select("customer_id", "recency_days", "frequency", "monetary"))


def _exported(s, d):
    """Folder with the segment export of the customer table."""
    folder = _folder(s)
    cust = customer_features(transactions(s, d), CFG).withColumn("segment_name", F.when(F.col("frequency") > 5, "frequent").otherwise("rare"))
    writers.export_segments(cust, cust.groupBy("segment_name").agg(F.count("*").alias("customers")), folder, CFG)
    return folder


def _segments(s, d):
    folder = _exported(s, d)
    return readers.read_segments(s, [f"{folder}/not-there", f"{folder}/customer_segments"]).select("customer_id", "segment_name", F.col("churn").cast("int").alias("churn"))


def _churn(s, d):
    _, tx, cust = _stored(s, d)
    tx, cust, seg = readers.read_churn_inputs(s, tx, cust, f"{_exported(s, d)}/customer_segments")
    last = tx.groupBy("customer_id").agg(F.max("order_date").alias("last_order"))
    return cust.select("customer_id").join(last, "customer_id").join(seg.select("customer_id", "segment_name"), "customer_id")


def _fraud(s, d):
    path, cust = _folder(s), _folder(s)
    tx = transactions(s, d)
    writers.write_verified(tx.withColumn("returned", F.when(F.col("returned") == 1, " Yes").otherwise("No")), path)
    writers.write_verified(tx.select("customer_id").distinct(), cust)
    return readers.read_fraud_inputs(s, path, cust)[0].select("order_id", "returned")


def _cohort(s, d):
    _, tx, cust = _stored(s, d)
    tx, cust = readers.read_cohort_inputs(s, tx, cust)
    return tx.join(cust.select("customer_id"), "customer_id", "left_semi").groupBy("customer_id").agg(F.min("order_date").alias("first_order"), F.count("*").alias("orders"))


def _predictions(s, d):
    folder = _folder(s)
    pred = fraud_queries.QUERIES["risk_tiers_quantile"](s, d)
    writers.export_predictions(pred, folder)
    return readers.read_predictions(s, [f"{folder}/not-there", f"{folder}/churn_predictions"])


def _cells(s, d):
    folder = _folder(s)
    q = cohort_queries.QUERIES
    cells = cohort_queries._cells(s, d)
    writers.save_cohorts(cells, q["cohort_summary"](s, d), q["segment_ltv"](s, d), folder)
    return rounded(s.read.parquet(f"{folder}/cohort_cells.parquet"), exact=("ltv",))


def _cached(s, d):
    folder = _folder(s)
    tx = transactions(s, d)
    cache.cached_customers(tx, folder, CFG)
    return rounded(cache.cached_customers(tx, folder, CFG), exact=("avg_order_value",))


#: Quantities whose lines are written with a fault, and the fault.
FAULTS = {13: "price: not a double", 17: "order_date: not a date", 19: "malformed line", 23: "category: empty"}


def _checked(s, d):
    """Lines with faults by quantity, read with quarantine: one row a line, clean lines without reasons."""
    tx, path = transactions(s, d), _folder(s)
    q, cells = F.col("quantity"), {c: F.col(c).cast("string") for c in tx.columns}
    cells |= {"price": F.when(q == 13, "n/a").otherwise(cells["price"]), "order_date": F.when(q == 17, "31.31.").otherwise(cells["order_date"]), "category": F.when(q == 23, "").otherwise(cells["category"])}
    line = F.when(q == 19, F.concat_ws(",", *list(cells.values())[:3])).otherwise(F.array_join(F.array(*cells.values()), ",", ""))
    header = ",".join(tx.columns)

    def under_header(batches):  # the CSV writer writes no broken lines
        first = [header]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(first + batch.column(0).to_pylist(), pa.string())], ["value"])
            first = []

    tx.select(line.alias("value")).mapInArrow(under_header, "value string").write.text(path)
    found = readers.read_checked_csv(s, path)
    bad = found.quarantine.select("order_id", F.array_join("reasons", ";").alias("reasons"))
    return found.clean.select("order_id", F.lit("").alias("reasons")).unionByName(bad)


def _versions(s, d):
    """All orders as version 1, kept ones as version 2, and a third that fails its check: what is current, and what version 1 still has."""
    tx, path = transactions(s, d), _folder(s)
    versions.publish(tx, path)
    versions.publish(tx.where("returned = 0"), path, partition_by=("category",))
    try:
        versions.publish(tx.limit(0), path, expected_rows=1)
    except versions.WriteCheckError:
        pass
    now = versions.read_version(s, path).groupBy("category").agg(F.count("*").alias("kept"), money_sum(F.col("total_amount")).alias("revenue"))
    first = versions.read_version(s, path, 1).groupBy("category").agg(F.count("*").alias("orders"))
    return rounded(now.join(first, "category").withColumn("versions", F.lit(versions.history(s, path).count())))


QUERIES = {
    "csv_quarantine": _checked, "published_versions": _versions,
    "csv_scan": _csv, "parquet_scan": _parquet, "verified_sink": _sink, "processed_reload": _reload, "processed_status": _status,
    "segmentation_inputs": _segmentation, "segment_csv": _segments, "churn_inputs": _churn, "fraud_inputs": _fraud, "cohort_inputs": _cohort,
    "prediction_export": _predictions, "cohort_sink": _cells, "feature_cache": _cached,
}

_SHORT = f"WITH {TX} SELECT order_id, customer_id, order_date, category, quantity, round(total_amount, 6) AS total_amount, returned FROM tx"
ORACLES = {
    "csv_quarantine": f"""WITH {TX} SELECT order_id, CASE quantity {' '.join(f"WHEN {q} THEN '{r}'" for q, r in FAULTS.items())} ELSE '' END AS reasons FROM tx""",
    "published_versions": f"""WITH {TX} SELECT category, count(*) FILTER (WHERE returned = 0) AS kept, round(sum(amt) FILTER (WHERE returned = 0) / 10000.0, 6) AS revenue,
  count(*) AS orders, 2 AS versions FROM tx GROUP BY 1""",
    "csv_scan": _SHORT, "parquet_scan": _SHORT, "verified_sink": _SHORT,
    "processed_reload": customer_queries.ORACLES["customer_features"], "feature_cache": customer_queries.ORACLES["customer_features"],
    "processed_status": f"""WITH {TX} SELECT 'transactions' AS table_name, 'found' AS status, count(*) AS rows FROM tx
UNION ALL SELECT 'customers', 'found', count(DISTINCT customer_id) FROM tx UNION ALL SELECT 'predictions', 'missing', NULL""",
    "segmentation_inputs": customer_queries.ORACLES["customer_features"].rsplit("SELECT", 1)[0] + "SELECT customer_id, recency_days, frequency, round(monetary, 6) AS monetary FROM cust",
    "segment_csv": customer_queries.ORACLES["customer_features"].rsplit("SELECT", 1)[0] + "SELECT customer_id, CASE WHEN frequency > 5 THEN 'frequent' ELSE 'rare' END AS segment_name, churn FROM cust",
    "churn_inputs": f"""WITH {TX} SELECT customer_id, max(order_date) AS last_order, CASE WHEN count(*) FILTER (WHERE returned = 0) > 5 THEN 'frequent' ELSE 'rare' END AS segment_name FROM tx GROUP BY 1""",
    "fraud_inputs": f"WITH {TX} SELECT order_id, returned FROM tx",
    "cohort_inputs": f"WITH {TX} SELECT customer_id, min(order_date) AS first_order, count(*) AS orders FROM tx GROUP BY 1",
    "prediction_export": fraud_queries.ORACLES["risk_tiers_quantile"],
    "cohort_sink": cohort_queries.ORACLES["cohort_cells"],
}
