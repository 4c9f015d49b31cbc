"""Best-fit packing of token pieces into sequences: bin completion branch-and-bound over the histogram of piece lengths.

A piece is at most ``capacity`` tokens, so the whole packing problem is a histogram of at most ``capacity`` numbers, whatever the corpus holds. The
driver solves that bounded problem and gets a list of fillings with multiplicities; the pieces are then placed by Spark: a piece's rank among the
pieces of its length decides which filling, copy and place it takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import give_back, materialized, table
from .tokens import encoder, vocabulary_paths

CAPACITY = 1024
END = 2
#: Nodes of the search beyond the first descent. More can only lower the number of sequences; every piece is packed with any value.
NODES = 3000
#: Fillings that are tried at one node beyond the best.
BREADTH = 4
#: Pieces of one batch of rows.
ROWS = 4096


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (lengths, copies) by best fit in decreasing order: the largest piece, then the largest that still fits, and so on."""
    left = {k: v for k, v in counts.items() if v}
    out = []
    while left:
        room, filling, used = capacity, [], {}
        for size in sorted(left, reverse=True):
            n = min(left[size], room // size)
            if n and not filling:
                n = 1
            if n:
                filling += [size] * n
                used[size] = n
                room -= n * size
            if filling and room < 1:
                break
        copies = min(left[s] // n for s, n in used.items())
        out.append((tuple(filling), copies))
        for s, n in used.items():
            left[s] -= n * copies
            if not left[s]:
                del left[s]
    return out


def _completions(left: np.ndarray, largest: int, capacity: int) -> list[tuple[int, ...]]:
    """Undominated sets of further pieces beside ``largest``, least waste first; ``left`` counts what is there besides that piece."""
    room = capacity - largest
    sizes = [int(s) for s in np.flatnonzero(left[: room + 1]) if s]
    if not sizes:
        return [()]
    if left[room]:
        return [(room,)]  # one piece that fills the room dominates every other set
    present = np.append(0, np.cumsum(left > 0))  # sizes present below each size
    below = np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))  # the largest size present up to each size

    found: dict[tuple[int, ...], int] = {}
    for a in reversed(sizes):  # pairs and single pieces
        rest = room - a
        b = int(below[min(rest, a)])
        if b == a and left[a] < 2:
            b = int(below[a - 1]) if a else 0
        found[(a, b) if b else (a,)] = rest - b
        if rest == b and len(found) > 8 * BREADTH:
            break
    if min(found.values()):  # no pair fills the room: best fit with three and more
        for a in reversed(sizes[-32:]):
            filling, rest, spare = [a], room - a, {a: 1}
            while rest:
                b = int(below[rest])
                while b and left[b] - spare.get(b, 0) < 1:
                    b = int(below[b - 1])
                if not b:
                    break
                filling.append(b)
                spare[b] = spare.get(b, 0) + 1
                rest -= b
            found[tuple(sorted(filling, reverse=True))] = rest
            if not rest:
                break
            for b in reversed([s for s in sizes if s <= a and s < room - a][-16:]):
                c = int(below[min(room - a - b, b)])
                need = {a: 1}
                for s in (b, c):
                    need[s] = need.get(s, 0) + 1
                if c and all(left[s] >= n for s, n in need.items()):
                    found[(a, b, c)] = room - a - b - c

    def dominated(filling: tuple[int, ...], waste: int) -> bool:
        sums = {0}
        for s in filling:
            sums |= {x + s for x in sums}
        sums.discard(0)
        for x in sums:  # a larger piece could take the place of some, or one piece the place of several of the same total
            hi = min(x + waste, len(left) - 1)
            if hi > x and present[hi + 1] > present[x + 1]:
                return True
        return False

    order = sorted(found.items(), key=lambda f: (f[1], len(f[0]), tuple(-s for s in f[0])))
    good = []
    for filling, waste in order[: 16 * BREADTH]:
        if not dominated(filling, waste):
            good.append(filling)
            if len(good) == BREADTH:
                break
    return good or [order[0][0]]


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and copies that use every piece once, in as few bins as the search finds.

    Depth first: at each node the largest piece left gets its undominated completions, least waste first, and as many copies as the counts allow. A branch whose
    waste cannot beat the incumbent is cut. Incumbents are the best-fit solution and the best descent; the search ends at the lower bound.
    """
    best = best_fit(counts, capacity)
    total = sum(k * v for k, v in counts.items())
    bins = sum(n for _, n in best)
    bound = -(-total // capacity)
    left = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        left[k] = v

    def branch():
        sizes = np.flatnonzero(left)
        largest = int(sizes[-1])
        left[largest] -= 1
        options = _completions(left, largest, capacity)
        left[largest] += 1
        return [(largest, *o) for o in options]

    path: list[tuple[tuple[int, ...], int]] = []
    stack: list[list[tuple[int, ...]]] = []
    waste, used, budget, descent = 0, 0, nodes, True
    if total:
        stack.append(branch())
    while stack and bins > bound:
        if len(path) == len(stack):  # return from a child: take its filling back
            filling, copies = path.pop()
            for s in filling:
                left[s] += copies
            used -= copies
            waste -= copies * (capacity - sum(filling))
        if budget <= 0:
            break
        if not stack[-1]:
            stack.pop()
            descent = False
            continue
        filling = stack[-1].pop(0)
        need: dict[int, int] = {}
        for s in filling:
            need[s] = need.get(s, 0) + 1
        copies = int(min(left[s] // n for s, n in need.items()))
        more = copies * (capacity - sum(filling))
        budget -= not descent
        if waste + more > (bins - 1) * capacity - total:  # the waste that a better solution may have
            descent = False
            continue
        for s in filling:
            left[s] -= copies
        path.append((filling, copies))
        waste += more
        used += copies
        if left.any():
            stack.append(branch())
        else:
            descent = False
            if used < bins:
                best, bins = list(path), used
            stack.append([])
    return best


def _pieces(path: str, ranks_path: str, capacity: int, end: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        enc = encoder(path, ranks_path)
        kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [()] * 5, kinds)], [n for n, _ in kinds])

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            rows: list[tuple] = []
            for doc_id, text in zip(ids, texts):
                tokens = np.append(enc.encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                start = 0
                for k in range(-(-len(tokens) // capacity)):
                    stop = len(tokens) - (-(-len(tokens) // capacity) - 1 - k) * capacity
                    rows.append((doc_id, k, start, stop - start, crc32(tokens[start:stop].tobytes())))
                    start = stop
                if len(rows) >= ROWS:
                    yield packed(rows)
                    rows = []
            yield packed(rows)
        give_back()

    return task


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the end id, cut from the back into pieces of ``capacity``."""
    path, ranks_path = vocabulary or vocabulary_paths()
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _pieces(path, ranks_path, capacity, end), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def placed(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``pieces`` with sequence_id and offset, by the plan for their histogram."""
    spark = pieces.sparkSession
    pieces = materialized(pieces.withColumn("rid", F.monotonically_increasing_id()))
    # A piece's rank among those of its length: ranks inside (length, writing task, quarter), plus the rows of the earlier ones.
    part = [F.shiftright("rid", 33).alias("part"), F.pmod("rid", F.lit(4)).alias("quarter")]
    keyed = pieces.select("*", *part)
    counts = materialized(keyed.groupBy("length", "part", "quarter").count())
    histogram = {int(r.length): r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``capacity`` rows
    slots, first, taken = [], 0, dict.fromkeys(histogram, 0)
    for filling, copies in bin_completion(histogram, capacity, nodes):
        offset = 0
        for size in sorted(set(filling), reverse=True):
            k = filling.count(size)
            slots.append((size, taken[size], taken[size] + k * copies, copies, first, offset))
            taken[size] += k * copies
            offset += k * size
        first += copies
    plan = spark.createDataFrame(slots, "length bigint, lo bigint, hi bigint, copies bigint, first bigint, base bigint")
    before = Window.partitionBy("length").orderBy("part", "quarter").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", "quarter", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    in_part = F.row_number().over(Window.partitionBy("length", "part", "quarter").orderBy("rid")) - 1
    ranked = keyed.withColumn("in_part", in_part).join(offsets, ["length", "part", "quarter"]).withColumn("rank", F.col("earlier") + F.col("in_part"))
    # The plan has at most a few rows per length, bounded by the capacity, and so can be sent to all tasks.
    j = F.col("rank") - F.col("lo")
    at = ranked.join(F.broadcast(plan.withColumnRenamed("length", "size")), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return at.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + j % F.col("copies")).cast("bigint").alias("sequence_id"),
        (F.col("base") + F.floor(j / F.col("copies")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, nodes: int = NODES, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``capacity`` tokens.

    A null or empty text is the end id alone. Every row is packed, equal rows and null ids too. An empty table gives no rows.
    """
    return placed(pieces_of(docs, capacity, vocabulary=vocabulary), capacity, nodes)


def op2_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
