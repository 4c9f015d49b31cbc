"""Benchmark decontamination by pigeonhole edit matching.

An item of length n may occur with up to k = RATE * n edits. It is split into k + 1 pieces; where it occurs with at most k edits, one piece at least is untouched.
All pieces of a block of items are found in one pass over a document (Aho-Corasick); each place a piece points to is verified with Myers' bit-parallel
distance. Case and the amount of white space do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

RATE = 0.05
#: Characters of items that one pass carries; more items are matched in several passes over the documents.
BLOCK_CHARS = 4_000_000

#: A prepared item: its id, normalised text, error budget, and (offset, piece) of each piece.
Item = tuple[object, str, int, list[tuple[int, str]]]


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def prepared(item_id: object, text: str | None, rate: float = RATE) -> Item | None:
    """None for an item without text: it matches nothing."""
    t = normal(text)
    if not t:
        return None
    k = int(rate * len(t))
    cut = [i * len(t) // (k + 1) for i in range(k + 2)]
    return item_id, t, k, [(a, t[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def distance(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to a part of ``text`` and the first end of such a part, if at most ``most``: Myers' vectors as integers."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = (m, 0) if m <= most else None
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq
        hp = minus | (~(d | plus) & full)
        hn = plus & d
        score += 1 if hp & top else -1 if hn & top else 0
        hp, hn = hp << 1, hn << 1  # a part may start anywhere, so no step is carried in
        plus = (hn | ~(x | hp)) & full
        minus = hp & x & full
        if score <= most and (best is None or score < best[0]):
            best = (score, end)
            if not score:
                break
    return best


class Matcher:
    def __init__(self, items: list[Item]):
        self.items = items
        self.automaton = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for number, (_, _, _, pieces) in enumerate(items):
            for offset, piece in pieces:
                at.setdefault(piece, []).append((number, offset))
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str | None, first_only: bool = False) -> list[tuple[object, int, int]]:
        """(item_id, distance, end) of each item found in the text, at its least distance."""
        t = normal(text)
        if not t or not len(self.automaton):
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(t):
            for number, offset in places:
                starts.setdefault(number, set()).add(end + 1 - size - offset)
        out = []
        for number in sorted(starts):
            item_id, pattern, k, _ = self.items[number]
            best, ordered = None, sorted(starts[number])
            i = 0
            while i < len(ordered):  # starts close to each other are one region
                j = i
                while j + 1 < len(ordered) and ordered[j + 1] - ordered[j] <= 2 * k + 1:
                    j += 1
                lo = max(0, ordered[i] - k)
                got = distance(pattern, t[lo : max(0, ordered[j] + len(pattern) + k)], k)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], lo + got[1])
                i = j + 1
            if best:
                out.append((item_id, *best))
                if first_only:
                    break
        return out


def blocks(benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> Iterator[list[Item]]:
    """Items in blocks of bounded size; one block is in the driver at a time."""
    size, block = 0, []
    for r in benchmark.select("item_id", "text").toLocalIterator():
        item = prepared(r.item_id, r.text, rate)
        if item is None:
            continue
        if block and size + len(item[1]) > block_chars:
            yield block
            size, block = 0, []
        size += len(item[1])
        block.append(item)
    if block:
        yield block


def _matches(items: list[Item]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items)
        for batch in batches:
            rows = [(d, *f) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")) for f in matcher.find(t.as_py())]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], ["doc_id", "item_id", "distance", "match_end"])

    return task


def contaminations(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, match_end): the items found in each document, at their least distance and its first end in the normalised text.

    Null and empty texts and items match nothing. Equal rows give equal results each. Without documents or items there are no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, distance int, match_end bigint")
    for items in blocks(benchmark, rate, block_chars):
        out = out.unionByName(docs.mapInArrow(_matches(items), out.schema))
    return out


def _clean(items: list[Item]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.find(t.as_py(), first_only=True) for t in batch.column("text")], pa.bool_()))

    return task


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs``, all columns, without the rows in which an item is found."""
    for items in blocks(benchmark, rate, block_chars):
        docs = docs.mapInArrow(_clean(items), docs.schema)
    return docs


def op1_pigeonhole_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents, at up to 5 % edits."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
