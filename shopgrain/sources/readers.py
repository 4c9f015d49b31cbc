"""Input readers with their contracts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..config import DEFAULT, Config
from ..operators.clean import TRUE_WORDS
from ..operators.quality import (
    COHORT_COLUMNS, SALES_COLUMNS, enforce_schema, fingerprint, require_columns, segmentation_input_checks,
)
from ..operators.segments import ensure_rfm_scores
from .tables import TRANSACTION_SCHEMA

SEGMENT_SCHEMA = "customer_id string, segment_name string, cluster int, loyalty_score double, churn_risk string, churn int"
PREDICTION_SCHEMA = "customer_id string, churn_probability double, risk_level string"
LABEL_COLUMNS = ("segment_name", "segment", "cluster_name", "rfm_segment")


class InputError(ValueError):
    """An input is missing or does not meet its contract."""


def _all_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def read_raw_csv(spark: SparkSession, path: str | Sequence[str], validate: bool = True, schema: T.StructType = TRANSACTION_SCHEMA) -> DataFrame:
    """Raw order CSV with header, columns in schema order; values are coerced, then checked.

    Splits take the place of chunked reading. Dates that do not parse become null; the return
    flag stays text. A violated rule raises with the counts of every violated rule.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(_all_text(schema)).csv(path)
    df = raw.select(*[
        F.col(f.name) if f.name == "returned" else F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields
    ])
    return enforce_schema(df, schema) if validate else df


#: Column of lines that the CSV parser could not take apart.
_BROKEN = "_broken_line"


@dataclass(frozen=True)
class CheckedCsv:
    """Rows that meet the schema, and (file, line, reasons, and what could be read as text) of those that do not. Every line of the input is in one of the two."""

    clean: DataFrame
    quarantine: DataFrame


def read_checked_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = TRANSACTION_SCHEMA) -> CheckedCsv:
    """CSV with header whose bad lines are kept apart and not turned into nulls: lines with too few or too many cells, cells that are no value of their column's type, empty cells of columns
    that must have a value. The return flag stays text.

    ``reasons`` has one entry per bad cell, in column order, or the single entry "malformed line"; ``file`` is the input file, ``line`` the line as it stands, or written anew from its cells if only those are bad.
    """
    text = T.StructType([*_all_text(schema).fields, T.StructField(_BROKEN, T.StringType())])
    raw = (
        spark.read.option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN)
        .option("columnPruning", False).schema(text).csv(path)  # whether a line is broken must not hang on the columns asked for
    )
    typed = {f.name: F.col(f.name) if f.name == "returned" else F.col(f.name).try_cast(f.dataType) for f in schema.fields}
    bad = [
        F.when(F.col(f.name).isNotNull() & typed[f.name].isNull(), F.lit(f"{f.name}: not a {f.dataType.simpleString()}")).when(F.lit(not f.nullable) & F.col(f.name).isNull(), F.lit(f"{f.name}: empty"))
        for f in schema.fields
    ]
    reasons = F.when(F.col(_BROKEN).isNotNull(), F.array(F.lit("malformed line"))).otherwise(F.array_compact(F.array(*bad)))
    rows = raw.select("*", F.col("_metadata.file_path").alias("_file"), reasons.alias("_reasons"))
    clean = rows.where(F.size("_reasons") == 0).select(*[c.alias(n) for n, c in typed.items()])
    names = schema.fieldNames()
    line = F.coalesce(F.col(_BROKEN), F.to_csv(F.struct(*names)))
    return CheckedCsv(clean, rows.where(F.size("_reasons") > 0).select(F.col("_file").alias("file"), line.alias("line"), F.col("_reasons").alias("reasons"), *names))


def read_transactions(spark: SparkSession, path: str, required: Sequence[str] = SALES_COLUMNS, expected_fingerprint: str | None = None) -> DataFrame:
    """Cleaned Parquet table, with its columns and, if given, its fingerprint checked."""
    df = require_columns(_dated(_read(spark, path)), required, path)
    if expected_fingerprint is not None:
        found = fingerprint(df).first()["fingerprint"]
        if found != expected_fingerprint:
            raise InputError(f"{path}: fingerprint {found}, expected {expected_fingerprint}")
    return df


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise InputError(f"{path}: {e.getCondition() or e}") from e


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("order_date", F.col("order_date").cast("date")) if "order_date" in df.columns else df


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(_read(spark, path), ["customer_id"], path)


def read_segmentation_inputs(spark: SparkSession, tx_path: str, cust_path: str) -> tuple[DataFrame, DataFrame]:
    """Transactions and customers, with 1..5 scores added where missing and checked."""
    tx, cust = _dated(_read(spark, tx_path)), ensure_rfm_scores(read_customers(spark, cust_path))
    require_columns(cust, ["recency_days", "frequency", "monetary", "loyalty_score"], cust_path)
    bad = [r["check_name"] for r in segmentation_input_checks(cust).where("status <> 'PASS'").collect()]
    if bad:
        raise InputError(f"{cust_path}: {bad}")
    return tx, cust


def read_churn_inputs(spark: SparkSession, tx_path: str, cust_path: str, segment_path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    tx = require_columns(_dated(_read(spark, tx_path)), ["customer_id", "order_date", "total_amount"], tx_path)
    seg = read_segments(spark, [segment_path]) if segment_path else None
    return tx, read_customers(spark, cust_path), seg


def repair_returned(df: DataFrame) -> DataFrame:
    """Text return flags to 1/0; numeric flags keep their value, nulls become 0."""
    if isinstance(df.schema["returned"].dataType, T.StringType):
        word = F.lower(F.trim("returned"))
        return df.withColumn("returned", F.when(word.isin(*TRUE_WORDS), 1).otherwise(0))
    return df.withColumn("returned", F.coalesce(F.col("returned").cast("int"), F.lit(0)))


def read_fraud_inputs(spark: SparkSession, tx_path: str, cust_path: str, expected_rows: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Transactions with repaired types, customers, and warnings (row count off by more than 100)."""
    tx = repair_returned(require_columns(_dated(_read(spark, tx_path)), TRANSACTION_SCHEMA.fieldNames(), tx_path))
    warnings = []
    if expected_rows is not None:
        rows = tx.count()
        if abs(rows - expected_rows) > 100:
            warnings.append(f"{tx_path}: {rows} rows, expected about {expected_rows}")
    return tx, read_customers(spark, cust_path), warnings


def read_cohort_inputs(spark: SparkSession, tx_path: str, cust_path: str) -> tuple[DataFrame, DataFrame]:
    return require_columns(_dated(_read(spark, tx_path)), COHORT_COLUMNS, tx_path), read_customers(spark, cust_path)


def read_first_csv(spark: SparkSession, paths: Sequence[str], schema: str, required: bool = False) -> DataFrame:
    """The first candidate path that exists, columns by header name; an empty typed frame when none does."""
    want = spark.createDataFrame([], schema)
    for p in paths:
        try:
            df = spark.read.option("header", True).csv(p)
        except AnalysisException:
            continue
        if not df.columns:
            continue
        extra = [F.col(c) for c in df.columns if c not in want.columns]
        return df.select(*[
            (F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.schema.fields
        ], *extra)
    if required:
        raise InputError(f"none of {list(paths)} exists")
    return want


def read_segments(spark: SparkSession, paths: Sequence[str], required: bool = True) -> DataFrame:
    """Segment labels; the first label column that the file has is used as segment_name."""
    df = read_first_csv(spark, paths, SEGMENT_SCHEMA, required)
    names = [F.col(c) for c in LABEL_COLUMNS if c in df.columns]
    return df.withColumn("segment_name", F.coalesce(*names)).select("customer_id", "segment_name", "cluster", "loyalty_score", "churn_risk", "churn")


def read_predictions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Churn predictions, or an empty typed frame."""
    return read_first_csv(spark, paths, PREDICTION_SCHEMA).select("customer_id", "churn_probability", "risk_level")
