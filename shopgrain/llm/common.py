"""What the operators share: reading tables, row keys, written intermediates."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialized  # noqa: F401  (a general helper, passed on to the operators)

#: Stands for a null doc_id: such rows come after all others and count as one document.
LAST_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unsigned_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes; of no bytes for a null."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def keyed(docs: DataFrame) -> DataFrame:
    """(did, th, text): id with nulls last, and a hash that tells rows of one id with different texts apart. Equal rows keep equal keys."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col("text")
    )


def id_back(did: Column) -> Column:
    return F.when(did != LAST_ID, did)


def give_back() -> None:
    """Return what earlier tasks of this Python worker no longer use to the system: workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim:
        trim(0)
