"""Sinks. Large tables stay partitioned; single-file output is only for tables of bounded size."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DEFAULT, Config
from ..operators.cohorts import wide_matrix
from ..operators.fraud import PROFILE_COLUMNS
from ..operators.segments import churn_risk_band
from . import versions
from .versions import WriteCheckError  # noqa: F401  (raised by the writers here)


def write_verified(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), expected_rows: int | None = None) -> DataFrame:
    """Snappy Parquet, read back and compared by row count and columns before it takes the place of what was at ``path``; returns the read table.

    Without ``expected_rows`` the rows are counted as they are written. The table may be made from the one at ``path``.
    """
    spark, rows = df.sparkSession, expected_rows

    def write(folder: str) -> None:
        nonlocal rows
        seen = versions.counted(df, lambda d: (d.write.partitionBy(*partition_by) if partition_by else d.write).option("compression", "snappy").parquet(folder))
        rows = seen if rows is None else rows

    versions.staged(spark, path, write, lambda folder: versions.compare(spark, folder, rows, df.columns))
    return spark.read.parquet(path).select(*df.columns)


def save_processed(tx: DataFrame, cust: DataFrame | None, folder: str) -> dict[str, DataFrame]:
    out = {"transactions": write_verified(tx, f"{folder}/transactions.parquet")}
    if cust is not None:
        out["customers"] = write_verified(cust, f"{folder}/customers.parquet")
    return out


def load_processed(spark: SparkSession, folder: str, with_customers: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """The stored tables; a missing customer table gives None."""
    tx = spark.read.parquet(f"{folder}/transactions.parquet")
    if not with_customers:
        return tx, None
    try:
        return tx, spark.read.parquet(f"{folder}/customers.parquet")
    except AnalysisException:
        return tx, None


def processed_status(spark: SparkSession, folder: str, names: tuple[str, ...] = ("transactions", "customers")) -> DataFrame:
    """One row per expected table: found, missing or corrupted. The whole table is read."""
    rows = []
    for n in names:
        try:
            df = spark.read.parquet(f"{folder}/{n}.parquet")
        except AnalysisException as e:
            rows.append((n, "missing" if e.getCondition() == "PATH_NOT_FOUND" else "corrupted", None))
            continue
        except Exception:  # unreadable footers surface as job errors
            rows.append((n, "corrupted", None))
            continue
        try:
            k = df.agg(*[F.count(c) for c in df.columns], F.count(F.lit(1)).alias("_rows")).first()["_rows"]
            rows.append((n, "found", k))
        except Exception:  # a damaged file surfaces as a task error
            rows.append((n, "corrupted", None))
    return spark.createDataFrame(rows, "table_name string, status string, rows bigint")


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with header. ``single`` is for reports whose size does not grow with the data."""
    one = df.coalesce(1) if single else df
    versions.staged(df.sparkSession, path, lambda folder: one.write.option("header", True).csv(folder))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON file of a table of bounded size."""
    versions.staged(df.sparkSession, path, lambda folder: df.coalesce(1).write.json(folder))


def write_small(df: DataFrame, path: str) -> None:
    """One Parquet file of a table of bounded size."""
    versions.staged(df.sparkSession, path, lambda folder: df.coalesce(1).write.parquet(folder))


def export_segments(cust: DataFrame, profiles: DataFrame, folder: str, cfg: Config = DEFAULT) -> None:
    """Customer labels as CSV, profiles as JSON and their summary as CSV."""
    cols = [c for c in ("customer_id", "cluster", "segment_name", "loyalty_score") if c in cust.columns]
    extra = [F.col("churn")] if "churn" in cust.columns else []
    write_csv(cust.select(*cols, churn_risk_band(F.col("recency_days"), cfg).alias("churn_risk"), *extra), f"{folder}/customer_segments")
    write_json(profiles, f"{folder}/segment_profiles")
    write_csv(profiles, f"{folder}/segment_summary", single=True)


def export_predictions(predictions: DataFrame, folder: str, name: str = "churn_predictions") -> None:
    write_csv(predictions, f"{folder}/{name}")


def export_deliverables(importance: DataFrame, risk: DataFrame, campaigns: DataFrame, folder: str) -> None:
    write_csv(importance, f"{folder}/feature_importance", single=True)
    write_csv(risk, f"{folder}/customer_risk_segments")
    write_csv(campaigns, f"{folder}/campaigns", single=True)


def export_model(model: PipelineModel, features: list[str], metrics: DataFrame, folder: str) -> None:
    """The fitted pipeline (fill, scaling and model), its feature names and its metrics."""
    spark = metrics.sparkSession
    versions.staged(spark, f"{folder}/model", model.save)
    write_json(spark.createDataFrame([(i, f) for i, f in enumerate(features)], "position int, feature string"), f"{folder}/features")
    write_json(metrics, f"{folder}/metrics")


def load_model(folder: str) -> PipelineModel:
    return PipelineModel.load(f"{folder}/model")


def save_fraud_profile(profile: DataFrame, folder: str) -> DataFrame:
    """The risk profile as Parquet, and High and Critical customers by score as CSV."""
    table = write_verified(profile.select(*PROFILE_COLUMNS), f"{folder}/fraud_risk_profile.parquet")
    top = table.where(F.col("risk_tier").isin("Critical", "High")).select(
        "customer_id", "composite_fraud_score", "risk_tier", "primary_typology", "return_rate", "max_discount_rate", "max_orders_7d", "category_hhi")
    write_csv(top.orderBy(F.desc("composite_fraud_score"), "customer_id"), f"{folder}/fraud_risk_summary")
    return table


def save_cohorts(cells: DataFrame, summary: DataFrame, segment_ltv: DataFrame, folder: str) -> None:
    """The long cell table, the three wide matrices, the cohort summary and the segment LTV table."""
    cells = write_verified(cells, f"{folder}/cohort_cells.parquet")
    for name in ("retention", "revenue", "ltv"):
        write_small(wide_matrix(cells, name), f"{folder}/{name}_matrix.parquet")
    write_small(summary.withColumn("cohort_month", F.date_format("cohort_month", "yyyy-MM")), f"{folder}/cohort_summary.parquet")
    write_small(segment_ltv, f"{folder}/segment_ltv.parquet")
