"""Sharding by fixed virtual slots: records hash into thousands of slots, and a versioned map sends slots to shards.

Everything on the rows is DataFrame functions. The driver sees only the bytes per slot, at most ``slots`` numbers, and edits the map on them.
Routing a record needs its id and the map, not the table. Moving load means a new map version that differs in a few slots.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import shared_folder
from .common import materialized, table, unsigned_crc32

SLOTS = 4096
SHARDS = 8
#: Pieces of a slot that are ranked apart, so that no window holds a whole slot.
PIECES = 16


def initial_map(slots: int, shards: int) -> list[int]:
    return [s % shards for s in range(slots)]


def rebalanced(slot_map: list[int], load: dict[int, int], shards: int) -> list[int]:
    """Next version of the map: slots move from the fullest to the emptiest shard while that lessens their difference."""
    out = list(slot_map)
    full = [0] * shards
    members: list[list[int]] = [[] for _ in range(shards)]
    for s in sorted(load):
        full[out[s]] += load[s]
        members[out[s]].append(s)
    while True:
        hi, lo = max(range(shards), key=lambda i: (full[i], -i)), min(range(shards), key=lambda i: (full[i], i))
        gap = full[hi] - full[lo]
        movable = [s for s in members[hi] if 0 < load[s] < gap]
        if not movable:
            return out
        s = min(movable, key=lambda s: (abs(gap - 2 * load[s]), s))
        members[hi].remove(s)
        members[lo].append(s)
        full[hi] -= load[s]
        full[lo] += load[s]
        out[s] = lo


def grown(slot_map: list[int], load: dict[int, int], shards: int) -> list[int]:
    """Map with one more shard: slots move only into it, from each old shard in proportion to its load."""
    out, share = list(slot_map), sum(load.values()) / (shards + 1)
    full = [0] * (shards + 1)
    for s, n in load.items():
        full[out[s]] += n
    for s in sorted(load, key=lambda s: (-load[s], s)):
        old = out[s]
        if full[old] - load[s] >= share * 0.98 and full[shards] + load[s] <= share * 1.02:
            full[old] -= load[s]
            full[shards] += load[s]
            out[s] = shards
    return out


def store_map(spark: SparkSession, versions: list[list[int]], path: str | None = None) -> tuple[str, DataFrame]:
    """Write the map's versions as a table (version, vslot, shard); its size is bounded by slots times versions."""
    path = path or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = [(v, s, shard) for v, m in enumerate(versions) for s, shard in enumerate(m)]
    spark.createDataFrame(rows, "version int, vslot int, shard int").coalesce(1).write.parquet(path)
    return path, spark.read.parquet(path)


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Rows with size, text_crc32, vslot, shard and slot (place in the shard, gapless from 0), and the map of all versions.

    Version 0 deals slots out in turn; version 1 is that map edited on the measured bytes, so sizes of the shards are near equal. A null text has
    size 1 and the CRC of no bytes. A null id is a value like others. Rows equal in id and text share a slot. An empty table gives no rows.
    """
    spark = docs.sparkSession
    narrow = materialized(
        docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), unsigned_crc32(F.col("text")).alias("text_crc32"))
        .withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))
        .withColumn("rid", F.monotonically_increasing_id())
        .withColumn("piece", F.pmod(F.xxhash64("rid"), F.lit(PIECES)).cast("int"))
    )
    pieces = materialized(narrow.groupBy("vslot", "piece").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).coalesce(1))
    load = {r.vslot: r.bytes for r in pieces.groupBy("vslot").agg(F.sum("bytes").alias("bytes")).collect()}  # at most ``slots`` rows
    start = initial_map(slots, shards)
    _, maps = store_map(spark, [start, rebalanced(start, load, shards)])
    current = maps.where("version = 1").select("vslot", "shard")
    # Offsets of the pieces within their shard: at most slots * PIECES rows, whatever the table's size.
    before = Window.partitionBy("shard").orderBy("vslot", "piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.join(F.broadcast(current), "vslot").select("vslot", "piece", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("vslot", "piece").orderBy("rid")) - 1
    placed = narrow.withColumn("place", place).join(F.broadcast(offsets), ["vslot", "piece"])
    return placed.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("base") + F.col("place")).cast("bigint").alias("slot")), maps


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards under the law ``bytes``."""
    placed, _ = shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )
