"""Feature cache: the customer table under a key of its configuration and its input."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT, Config
from ..operators.customers import customer_features
from ..operators.quality import fingerprint

PREFIX = "customers_"


def cache_key(tx: DataFrame, cfg: Config = DEFAULT) -> str:
    """Hash of the customer settings and of the input's row digest: other data never hits an old entry."""
    settings = json.dumps(dataclasses.asdict(cfg.customer), sort_keys=True)
    mark = fingerprint(tx).first()
    return hashlib.md5(f"{settings}|{mark['rows']}|{mark['row_digest']}".encode()).hexdigest()[:16]


def cached_customers(tx: DataFrame, folder: str, cfg: Config = DEFAULT) -> DataFrame:
    """The stored customer table when one matches, else a new one, stored on the way."""
    spark = tx.sparkSession
    path = f"{folder}/{PREFIX}{cache_key(tx, cfg)}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):  # written beside the entry first, so that nobody reads half of it
        fresh = f"{path}-{uuid.uuid4().hex}"
        customer_features(tx, cfg).write.parquet(fresh)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), at):
            return spark.read.parquet(fresh)
    return spark.read.parquet(path)


def _entries(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return fs, []
    return fs, [s for s in fs.listStatus(root) if s.getPath().getName().startswith(PREFIX)]


def clear_cache(spark: SparkSession, folder: str, older_than_hours: float | None = None) -> int:
    """Delete cache entries, all or those older than a time to live; returns how many went.

    Only entries of this cache (by name prefix) in ``folder`` are touched.
    """
    fs, entries = _entries(spark, folder)
    limit = None if older_than_hours is None else (time.time() - older_than_hours * 3600) * 1000
    gone = [s for s in entries if limit is None or s.getModificationTime() < limit]
    return sum(bool(fs.delete(s.getPath(), True)) for s in gone)
