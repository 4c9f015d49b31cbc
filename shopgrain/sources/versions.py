"""Staged and versioned tables: nothing that readers see changes until what was written has been read back and compared.

A staged write puts a plain folder in the place of the old one by renames. A published table keeps its versions beside each other; a manifest entry, itself put in place by
one rename that fails if the entry is there, makes a version the current one. Paths may be of any file system that Spark knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

_MANIFEST = "version bigint, folder string, rows bigint, columns array<string>"


class WriteCheckError(RuntimeError):
    """A table read back differs from what was written, or could not be put in its place."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """False if the target is there already."""
    fs, p = _fs(spark, source)
    t = _fs(spark, target)[1]
    fs.mkdirs(t.getParent())
    return not fs.exists(t) and fs.rename(p, t)


def staged(spark: SparkSession, path: str, write: Callable[[str], None], check: Callable[[str], None] = lambda path: None) -> None:
    """``write`` fills a folder beside ``path``, ``check`` raises if it is wrong, then it takes the place of ``path``. Until then, and if either fails, the old folder stays as it is."""
    new, old = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.replaced-{uuid.uuid4().hex}"
    try:
        write(new)
        check(new)
    except BaseException:
        delete(spark, new)
        raise
    had = exists(spark, path) and _rename(spark, path, old)
    if not _rename(spark, new, path):
        if had:
            _rename(spark, old, path)
        delete(spark, new)
        raise WriteCheckError(f"{path}: the new folder could not be put in place")
    if had:
        delete(spark, old)


def counted(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Rows of ``df``, counted as ``write`` writes them."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


def compare(spark: SparkSession, path: str, rows: int, columns: list[str]) -> DataFrame:
    """The table at ``path`` if it has these rows and columns."""
    back = spark.read.parquet(path)
    found = back.count()
    if rows != found or set(back.columns) != set(columns):
        raise WriteCheckError(f"{path}: expected {rows} rows {columns}, read {found} rows {back.columns}")
    return back.select(*columns)


def history(spark: SparkSession, path: str) -> DataFrame:
    """(version, folder, rows, columns) of every published version; no rows if nothing has been published."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/manifest/*.json")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), expected_rows: int | None = None) -> int:
    """Write ``df`` as the next version of ``path``, compare what is read back, and enter it in the manifest; the version's number.

    Of two writers that publish at the same time one enters the next version and the other raises; a version that is not entered is never read.
    """
    spark = df.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    try:
        rows = counted(df, lambda d: (d.write.partitionBy(*partition_by) if partition_by else d.write).parquet(f"{path}/{folder}"))
        compare(spark, f"{path}/{folder}", rows if expected_rows is None else expected_rows, df.columns)
        version = (history(spark, path).agg(F.max("version")).first()[0] or 0) + 1
        draft = f"{path}/draft-{uuid.uuid4().hex}"
        spark.createDataFrame([(version, folder, rows, df.columns)], _MANIFEST).coalesce(1).write.json(draft)
        fs, p = _fs(spark, f"{draft}/part-*")
        part = fs.globStatus(p)[0].getPath().toString()
        entered = _rename(spark, part, f"{path}/manifest/{version:012d}.json")
        delete(spark, draft)
        if not entered:
            raise WriteCheckError(f"{path}: version {version} has been entered by another writer")
    except BaseException:
        delete(spark, f"{path}/{folder}")
        raise
    return version


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The current version of a published table, or an earlier one by number."""
    h = history(spark, path)
    row = (h if version is None else h.where(F.col("version") == version)).orderBy(F.desc("version")).first()
    if row is None:
        raise FileNotFoundError(f"{path}: no version {'' if version is None else version} has been published")
    return spark.read.parquet(f"{path}/{row['folder']}").select(*row["columns"])


def expire(spark: SparkSession, path: str, keep: int) -> int:
    """Take the data and entries of all but the last ``keep`` (one or more) versions away; how many went."""
    if keep < 1:
        raise ValueError("the current version is kept")
    rows = history(spark, path).orderBy(F.desc("version")).collect()[keep:]  # one row a version
    for r in rows:
        delete(spark, f"{path}/manifest/{r['version']:012d}.json")
        delete(spark, f"{path}/{r['folder']}")
    return len(rows)
