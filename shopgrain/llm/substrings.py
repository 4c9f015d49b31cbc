"""Substring dedup: Rabin-Karp hashes of every window of ``window`` words, counted in Spark; repeated windows merge into maximal intervals.

Windows that share a minimizer (the least hash of their k-word grams) are neighbours and travel as one run. Equal windows have equal minimizers, so a
run whose minimizer occurs in one document only holds no repeated window and is not shuffled again. A run whose whole content is also in a
smaller document is removed at once; only runs that differ under one minimizer, such as those at the ends of a passage, are taken apart into windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import text as X
from .common import id_back, keyed, materialized, table

WINDOW = 50
GRAM = 8


def _two_lanes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    return [X.span_hash(X.prefix_hash(t[data]), start, end) for t in X.TABLES]


def _int64(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def _runs(window: int, gram: int, content: bool):
    """Rows (did, m), or with ``content`` (did, th, start, n, m, r1, r2): each run, and the hash of all its words in two lanes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.utf8(batch.column("text"))
            did, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "th"))
            for i, j in X.rounds(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                a, b, of = X.words(part, at)
                lanes = _two_lanes(part, a, b)
                row, start, n, m = X.runs(lanes[0], of, window, gram)
                cols = {"did": pa.array(did[i:j][row]), "m": _int64(m)}
                if content:
                    r1, r2 = (X.span_hash(X.prefix_hash(h), start, start + n + window - 1) for h in lanes)
                    cols |= {"th": pa.array(th[i:j][row]), "start": pa.array((start - of[row]).astype(np.int32)), "n": pa.array(n.astype(np.int32)), "r1": _int64(r1), "r2": _int64(r2)}
                    cols = {c: cols[c] for c in ("did", "th", "start", "n", "m", "r1", "r2")}
                yield pa.RecordBatch.from_pydict(cols)

    return task


def _windows(window: int):
    """Rows (did, th, start, h1, h2) of all windows in the given runs of each document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.utf8(batch.column("text"))
            did, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "th"))
            lists = batch.column("runs")
            flat = lists.flatten()
            starts, counts = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            bound = np.append(0, np.cumsum(np.asarray(lists.value_lengths())))
            for i, j in X.rounds(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                a, b, of = X.words(part, at)
                s, n = starts[bound[i] : bound[j]], counts[bound[i] : bound[j]]
                row = np.repeat(np.arange(j - i), np.diff(bound[i : j + 1]))
                first = np.repeat(of[row] + s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(row, n)
                h1, h2 = (X.span_hash(X.prefix_hash(h), first, first + window) for h in _two_lanes(part, a, b))
                yield pa.RecordBatch.from_pydict({"did": pa.array(did[i:j][row]), "th": pa.array(th[i:j][row]), "start": pa.array((first - of[row]).astype(np.int32)), "h1": _int64(h1), "h2": _int64(h2)})

    return task


def repeated_intervals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(did, th, spans): per document the word intervals [start, end) that windows found in a smaller document cover, unmerged.

    Documents without such a window have no row.
    """
    docs = keyed(docs)
    shared = (
        docs.mapInArrow(_runs(window, gram, False), "did bigint, m bigint")
        .groupBy("m").agg(F.min("did").alias("lo"), F.max("did").alias("hi")).where("lo < hi").select("m")
    )
    found = materialized(docs.mapInArrow(_runs(window, gram, True), "did bigint, th bigint, start int, n int, m bigint, r1 bigint, r2 bigint").join(shared, "m"))
    content = materialized(found.groupBy("m", "r1", "r2").agg(F.min("did").alias("first")))
    mixed = content.groupBy("m").count().where("count > 1").select("m", F.lit(True).alias("mixed"))
    content = content.join(mixed, "m", "left")
    judged = found.join(content, ["m", "r1", "r2"])
    whole = judged.where("did > first").select("did", "th", "start", (F.col("start") + F.col("n") + (window - 1)).alias("end"))
    open_runs = judged.where("did = first AND mixed").groupBy("did", "th").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    windows = materialized(docs.join(open_runs, ["did", "th"]).mapInArrow(_windows(window), "did bigint, th bigint, start int, h1 bigint, h2 bigint"))
    firsts = windows.groupBy("h1", "h2").agg(F.min("did").alias("first"), F.max("did").alias("latest")).where("first < latest")
    single = windows.join(firsts, ["h1", "h2"]).where("did > first").select("did", "th", "start", (F.col("start") + window).alias("end"))
    return whole.unionByName(single).groupBy("did", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals of a union of intervals; touching ones join."""
    out: list[list[int]] = []
    for i in np.argsort(start, kind="stable"):
        if out and start[i] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(end[i]))
        else:
            out.append([int(start[i]), int(end[i])])
    return [(a, b) for a, b in out]


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = X.utf8(batch.column("text"))
        lists = batch.column("spans")
        flat = lists.flatten()
        s, e = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        bound = np.append(0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0))))
        n_words, n_removed, kept, removed = [], [], [], []
        for i in range(batch.num_rows):
            all_words = data[offsets[i] : offsets[i + 1]].tobytes().split()  # on exactly the bytes in X.SPACE
            cut = merged(s[bound[i] : bound[i + 1]], e[bound[i] : bound[i + 1]])
            n_words.append(len(all_words))
            n_removed.append(sum(b - a for a, b in cut))
            for a, b in reversed(cut):
                del all_words[a:b]
            kept.append(b" ".join(all_words).decode())
            removed.append([{"start": a, "end": b} for a, b in cut])
        out = [batch.column("did"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        yield pa.RecordBatch.from_arrays(out, ["did", "n_words", "n_removed", "kept", "removed"])


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (its other words, joined by one space) and removed (maximal word intervals).

    A null text has no words; texts shorter than a window keep all. Rows that share a doc_id are one document: their windows are never repeats
    of each other. Rows with a null doc_id come after all others and count as one document. An empty table gives no rows.
    """
    spans = repeated_intervals(docs, window, gram)
    out = keyed(docs).join(spans, ["did", "th"], "left").select("did", "text", "spans").mapInArrow(
        _cleaned, "did bigint, n_words bigint, n_removed bigint, kept string, removed array<struct<start:int,end:int>>"
    )
    return out.select(id_back(F.col("did")).alias("doc_id"), "n_words", "n_removed", "kept", "removed")


def op7_rabin_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents without those in 50-word windows of smaller documents."""
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
