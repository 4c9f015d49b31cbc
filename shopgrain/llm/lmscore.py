"""LM scoring by online logistic context mixing.

A document is its lower-cased words, each followed by a space, the last by the end byte; the model predicts it bit by bit. Each context (the last 2 to 4 bytes, and the word so far)
looks up, under a hash of the context and of the part already known of the byte, how often a 0 and a 1 followed in all training documents. The logits of these
estimates are added with weights that are gated by which long contexts were seen at all, and after each bit the weights move along the coding error, so that a text
settles on the contexts that serve it. The weights start anew every ``SEGMENT`` bits, with the bytes before still as context; so segments are scored side by
side. Total bits follow as -log2 of the product of all predictions. A byte is a path in a prefix code, so a frequent one takes few predictions.

Counts are gathered in tables of ``2 ** SLOT_BITS`` slots whatever the corpus holds, and so can be sent to every task. A unigram base score over
words is made by packed postings: words above one in ``COMMON`` of all tokens are few enough to send to every task, the others are counted in groups.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import text as X
from .common import give_back, id_back, keyed, materialized, table
from .langid import fold

#: Slots per context: the last 2, 3 and 4 bytes, the word so far.
SLOT_BITS = (18, 20, 21, 23)
CONTEXTS = len(SLOT_BITS)
#: Bits after which the weights start anew.
SEGMENT = 2048
END = b"\n"
RATE = 0.01
#: Weights at the start of a segment, by gate: whether the word so far was seen (second digit) and the last four bytes were (first digit).
START = np.array([[0.5, 0.5, 0.0, 0.0], [0.3, 0.4, 0.3, 0.0], [0.2, 0.4, 0.0, 0.4], [0.15, 0.25, 0.3, 0.3]], np.float32)
#: Added to both counts of a slot.
PRIOR = 0.02
_ONES = np.ones(CONTEXTS, np.float32)
_CLIP = 7.9
_QUANTUM = 16
#: Text bytes per group of rare words.
GROUP_BYTES = 1 << 24
COMMON = 100_000
#: Slots that travel in one row.
_PIECE = 1 << 15
#: Text bytes counted, or taken apart into words, in one go: beside the table of counts each needs some hundred bytes.
_COUNT_BYTES = 1 << 17
_OFFSETS = np.append(0, np.cumsum([1 << b for b in SLOT_BITS]))


def _normal(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    low = X.LOWER[data]
    return [b" ".join(low[a:b].tobytes().split()) + END for a, b in zip(offsets[:-1], offsets[1:])]


def _mixed(h: np.ndarray, context: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * context)
    h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
    return h ^ (h >> np.uint32(15))


def context_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each context before each byte; rows of ``data`` begin at ``starts`` and have only end bytes before them."""
    n = len(data)
    row = np.zeros(n, np.int64)
    row[starts[starts < n]] = starts[starts < n]
    begin = np.maximum.accumulate(row)
    at = np.arange(n)
    out = np.empty((CONTEXTS, n), np.uint32)
    h = np.zeros(n, np.uint32)
    for o in range(1, 5):
        before = np.where(at - o >= begin, data[np.maximum(at - o, 0)], END[0]).astype(np.uint32)
        h = h | before << np.uint32(8 * (o - 1))
        if o > 1:
            out[o - 2] = _mixed(h, o)
    gap = np.zeros(n, np.int64)
    after_space = np.flatnonzero(data[:-1] == 0x20) + 1
    gap[after_space] = after_space
    word = np.maximum(np.maximum.accumulate(gap), begin)
    out[3] = _mixed((X.span_hash(X.prefix_hash(data.astype(np.uint64) + np.uint64(1)), word, at) >> np.uint64(32)).astype(np.uint32), 5)
    return out


class Code:
    """Prefix code of bytes, shorter for frequent ones: a byte is a path in a binary tree, each step one bit to predict."""

    def __init__(self, histogram: np.ndarray):
        heap = [(int(n) + 1, i, i) for i, n in enumerate(histogram)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        node = 256
        while len(heap) > 1:
            (m, _, a), (n, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a], parent[b] = (node, 0), (node, 1)
            heapq.heappush(heap, (m + n, node, node))
            node += 1
        paths = []
        for i in range(256):
            path, at = [], i
            while at in parent:
                path.append(parent[at])
                at = parent[at][0]
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths])
        self.node, self.bit = np.zeros((2, 256, self.length.max()), np.int64)
        for i, path in enumerate(paths):
            for j, (n, b) in enumerate(path):
                self.node[i, j], self.bit[i, j] = n - 256, b

    def bits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Byte, tree node and value of each bit, and the first bit of each byte (and the end)."""
        size = self.length[data]
        first = np.append(0, np.cumsum(size))
        byte = np.repeat(np.arange(len(data)), size)
        step = np.arange(len(byte)) - first[byte]
        at = data[byte]
        return byte, self.node[at, step].astype(np.uint32), self.bit[at, step].astype(np.uint8), first


def slots(hashes: np.ndarray, byte: np.ndarray, node: np.ndarray, context: int) -> np.ndarray:
    """Place in the joint table of the context's counts at a node."""
    h = (hashes[byte] + node * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(16)
    return ((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - SLOT_BITS[context])).astype(np.int64) + _OFFSETS[context]


def count(counts: np.ndarray, code: Code, texts: list[bytes]) -> None:
    """Add the bits of ``texts`` to ``counts`` (slot, bit)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    hashes = context_hashes(data, np.cumsum(size) - size)
    byte, node, bit, _ = code.bits(data)
    flat = counts.reshape(-1)
    for c in range(CONTEXTS):
        np.add.at(flat, slots(hashes[c], byte, node, c) << 1 | bit, np.uint32(1))


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        data, offsets = X.utf8(batch.column("text"))
        for i, j in X.rounds(offsets):
            total += np.bincount(X.LOWER[data[offsets[i] : offsets[j]]], minlength=256)
    yield pa.RecordBatch.from_pydict({"byte": pa.array(np.arange(256), pa.int32()), "n": pa.array(total)})


def _counts(code: Code):
    """Counts of a task's documents, in packed pieces of the table."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        counts, rows = np.zeros((_OFFSETS[-1], 2), np.uint32), 0
        for batch in batches:
            data, offsets = X.utf8(batch.column("text"))
            for i, j in X.rounds(offsets, _COUNT_BYTES):
                count(counts, code, _normal(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                rows += j - i
        pack = zstandard.ZstdCompressor(level=1)
        if rows:
            for part in range(len(counts) // _PIECE):
                piece = counts[part * _PIECE : (part + 1) * _PIECE]
                if piece.any():
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": pa.array([pack.compress(piece.tobytes())], pa.binary())})

    return task


def logits(counts: np.ndarray) -> np.ndarray:
    """Logit of a 1 for each slot, in steps of 1 / 16; 0 for what was never seen."""
    c = counts.astype(np.float64)
    return np.clip(np.rint(np.log((c[..., 1] + PRIOR) / (c[..., 0] + PRIOR)) * _QUANTUM), -_CLIP * _QUANTUM, _CLIP * _QUANTUM).astype(np.int8)


def _total(t: pa.Table) -> np.ndarray:
    total = np.zeros((_PIECE, 2), np.uint64)
    for packed in t.column("counts"):
        total += np.frombuffer(zstandard.decompress(packed.as_py()), np.uint32).reshape(-1, 2)
    return total


def _partly(t: pa.Table) -> pa.Table:
    total = np.minimum(_total(t), 1 << 27).astype(np.uint32)  # beyond this a count no longer changes its logit's step
    return pa.table({"part": t.column("part").slice(0, 1), "counts": pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())})


def _summed(t: pa.Table) -> pa.Table:
    return pa.table({"part": t.column("part").slice(0, 1), "logits": pa.array([logits(_total(t)).tobytes()], pa.binary())})


def fit(docs: DataFrame) -> tuple[Code, np.ndarray]:
    """Byte code and logits from the texts of all ``docs``; one byte per slot, whatever their number."""
    histogram = np.zeros(256, np.int64)
    for r in docs.select("text").mapInArrow(_histogram, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        histogram[r.byte] = r.n
    code = Code(histogram)
    parts = docs.select("text").mapInArrow(_counts(code), "part int, counts binary")
    # Sums in sixteen shares first, so that a piece's counts from all tasks do not meet in one.
    shares = parts.groupBy("part", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("share")).applyInArrow(_partly, "part int, counts binary")
    out = np.zeros(_OFFSETS[-1], np.int8)
    for r in shares.groupBy("part").applyInArrow(_summed, "part int, logits binary").toLocalIterator():  # the bounded table itself
        out[r.part * _PIECE : (r.part + 1) * _PIECE] = np.frombuffer(r.logits, np.int8)
    return code, out


def mixed_scores(code: Code, table_: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size) - size
    hashes = context_hashes(data, first)
    byte, node, bit, bit_at = code.bits(data)
    x = np.empty((len(byte), CONTEXTS), np.int8)
    for c in range(CONTEXTS):
        x[:, c] = table_.take(slots(hashes[c], byte, node, c))
    n_bits = len(byte)
    del byte, node, hashes
    gate = (x[:, 2] != 0).astype(np.int8) + np.int8(2) * (x[:, 3] != 0)
    # Segments of each text's bits, longest first; then all bits by their step in the segment, so that one step of all segments lies together.
    lo, hi = bit_at[first], bit_at[first + size]
    pieces = -(-(hi - lo) // SEGMENT)
    start = np.repeat(lo, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
    length = np.minimum(np.repeat(hi, pieces) - start, SEGMENT)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    live = np.searchsorted(-length, -np.arange(length[0]), "left")  # segments longer than each step
    step_at = np.append(0, np.cumsum(live))
    own = (np.arange(step_at[-1]) - np.repeat(step_at[:-1], live)).astype(np.int32)
    at = (start.astype(np.int32)[own] + np.repeat(np.arange(len(live), dtype=np.int32), live)).astype(np.int32)
    own *= len(START)
    own += gate[at]
    v_all = x[at].astype(np.float32)
    v_all *= np.float32(1 / _QUANTUM)
    bit_all = bit[at].astype(np.float32)
    del x, bit, gate
    coded = np.empty(len(at), np.float32)
    weights = np.tile(START, (len(start), 1))
    rows = weights.view(np.dtype((np.void, 4 * CONTEXTS))).ravel()  # a row moves as one item
    for a, b in zip(step_at[:-1].tolist(), step_at[1:].tolist()):
        v, mine = v_all[a:b], own[a:b]
        taken = rows.take(mine)
        w = taken.view(np.float32).reshape(-1, CONTEXTS)
        z = (w * v) @ _ONES
        np.clip(z, -11, 11, out=z)
        np.negative(z, out=z)
        np.exp(z, out=z)
        z += 1
        np.reciprocal(z, out=z)
        np.subtract(bit_all[a:b], z, out=z)
        coded[a:b] = z
        z *= np.float32(RATE)
        w += v * z[:, None]
        rows[mine] = taken
    likelihood = np.empty(n_bits, np.float64)
    likelihood[at] = 1 - np.abs(coded)
    return np.add.reduceat(np.log10(likelihood), lo)


def _scores(model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        code, table_ = model.value
        for batch in batches:
            data, offsets = X.utf8(batch.column("text"))
            for i, j in X.rounds(offsets):
                texts = _normal(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cols = [batch.column(c).slice(i, j - i) for c in ("did", "th")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([len(t) for t in texts], pa.int64()), pa.array(mixed_scores(code, table_, texts))], ["did", "th", "n_bytes", "score"])

    return task


# The unigram base.


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the row's word borders."""
    low = X.LOWER[data]
    a, b, of = X.words(low, offsets)
    return X.span_hash(X.prefix_hash(X.TABLES[0][low]), a, b).view(np.int64), of


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = X.utf8(batch.column("text"))
        words = [_word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0] for i, j in X.rounds(offsets)]
        w, n = np.unique(np.concatenate(words), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n)], ["w", "n"])


def _postings(common: tuple[np.ndarray, np.ndarray], groups: int):
    """Rows of kind 0: a batch's documents with their tokens and what common words give; of kind 1: the postings of a group of its other words."""
    words, weight = common

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            name = TaskContext.get().partitionId() << 24 | number  # the same again if the task is repeated
            data, offsets = X.utf8(batch.column("text"))
            parts, rows, n_tokens = [], [], []
            for i, j in X.rounds(offsets):
                w, of = _word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts.append(w)
                rows.append(np.repeat(np.arange(i, j), np.diff(of)))
                n_tokens.append(np.diff(of))
            w, row, n_tokens = (np.concatenate(x) for x in (parts, rows, n_tokens))
            at = np.minimum(np.searchsorted(words, w), max(len(words) - 1, 0))
            is_common = words[at] == w if len(words) else np.zeros(len(w), bool)
            log = np.bincount(row[is_common], weight[at[is_common]], batch.num_rows)
            known = np.bincount(row[is_common], minlength=batch.num_rows)
            w, row = w[~is_common], row[~is_common]
            group = np.abs(w // 7) % groups  # any rule that words alone decide
            order = np.lexsort((row, w, group))
            w, row, group = w[order], row[order], group[order]
            train = batch.column("train").to_numpy(zero_copy_only=False)
            lists = {"dids": [batch.column("did").to_numpy()], "ths": [batch.column("th").to_numpy()], "n": [n_tokens], "known": [known], "log": [log], "w": [[]], "times": [[]], "rows": [[]], "train": [[]]}
            ids = [-1]
            cut = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)) if len(group) else np.zeros(1, int)
            for a, b in zip(cut[:-1], cut[1:]):
                ids.append(int(group[a]))
                u, first = np.unique(w[a:b], return_index=True)
                for key, value in (("w", u), ("times", np.diff(np.append(first, b - a))), ("rows", row[a:b]), ("train", train[row[a:b]])):
                    lists[key].append(value)
                for key in ("dids", "ths", "n", "known", "log"):
                    lists[key].append([])
            kinds = {"dids": pa.int64(), "ths": pa.int64(), "n": pa.int32(), "known": pa.int32(), "log": pa.float64(), "w": pa.int64(), "times": pa.int32(), "rows": pa.int32(), "train": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.int64()), pa.array(ids, pa.int32()), *[pa.array(lists[k], pa.list_(t)) for k, t in kinds.items()]], ["batch", "word_group", *kinds])

    return task


_POSTINGS = "batch bigint, word_group int, dids array<bigint>, ths array<bigint>, n array<int>, known array<int>, log array<double>, w array<bigint>, times array<int>, rows array<int>, train array<boolean>"
_PARTS = "batch bigint, rows array<int>, known array<int>, log array<double>"


def _flat(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _lengths(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().value_lengths().to_numpy(zero_copy_only=False)


def _rare(t: pa.Table) -> pa.Table:
    """What a group of words gives to the documents of each batch."""
    w, number = np.unique(np.repeat(_flat(t, "w"), _flat(t, "times")), return_inverse=True)
    c = np.bincount(number, _flat(t, "train"), len(w))
    row, cut = _flat(t, "rows"), np.append(0, np.cumsum(_lengths(t, "rows")))
    per = np.log10(c + 0.1)[number]
    rows, known, log = [], [], []
    for a, b in zip(cut[:-1], cut[1:]):
        u, at = np.unique(row[a:b], return_inverse=True)
        rows.append(u)
        known.append(np.bincount(at, c[number[a:b]] > 0, len(u)).astype(np.int32))
        log.append(np.bincount(at, per[a:b], len(u)))
    return pa.table({"batch": t.column("batch"), "rows": pa.array(rows, pa.list_(pa.int32())), "known": pa.array(known, pa.list_(pa.int32())), "log": pa.array(log, pa.list_(pa.float64()))})


def _gathered(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums per document of one batch; ``left`` is its row of kind 0."""
    known, log = _flat(left, "known").astype(np.int64), _flat(left, "log").copy()
    if right.num_rows:
        rows = _flat(right, "rows")
        known = known + np.bincount(rows, _flat(right, "known"), len(known)).astype(np.int64)
        log = log + np.bincount(rows, _flat(right, "log"), len(log))
    return pa.table({"did": pa.array(_flat(left, "dids")), "th": pa.array(_flat(left, "ths")), "n_words": pa.array(_flat(left, "n").astype(np.int64)), "n_known": pa.array(known), "log": pa.array(log)})


def unigram(docs: DataFrame) -> tuple[DataFrame, int]:
    """(did, th, n_tokens, n_known, base_score) of keyed docs with a column train, each (did, th) once, and the number of training tokens.

    The end of a document is a token like the words.
    """
    spark = docs.sparkSession
    sizes = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.col("train").cast("bigint")).alias("ends")).first()
    groups, ends = max(1, -(-(sizes.bytes or 0) // GROUP_BYTES)), sizes.ends or 0
    vocabulary = materialized(docs.where("train").select("text").mapInArrow(_tallied, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")))
    totals = vocabulary.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    n, v = (totals.n or 0) + ends, totals.v + (ends > 0)
    common = sorted((r.w, r.n) for r in vocabulary.where(F.col("n") > n / COMMON).collect())  # fewer than COMMON words
    common = np.array([w for w, _ in common], np.int64), np.log10(np.array([c for _, c in common], np.float64) + 0.1)
    packed = materialized(docs.select("did", "th", "text", "train").mapInArrow(_postings(common, groups), _POSTINGS))
    rare = materialized(packed.where("word_group >= 0").groupBy("word_group").applyInArrow(_rare, _PARTS))
    sums = packed.where("word_group < 0").groupBy("batch").cogroup(rare.groupBy("batch")).applyInArrow(_gathered, "did bigint, th bigint, n_words bigint, n_known bigint, log double")
    per_token = math.log10(n + 0.1 * (v + 1)) if n + v else 0.0
    out = sums.groupBy("did", "th").agg(F.first("n_words").alias("n_words"), F.first("n_known").alias("n_known"), F.first("log").alias("log"))  # equal rows have equal sums
    n_tokens = F.col("n_words") + 1
    out = out.select("did", "th", n_tokens.alias("n_tokens"), (F.col("n_known") + int(ends > 0)).alias("n_known"), (F.col("log") + math.log10(ends + 0.1) - n_tokens * per_token).alias("base_score"))
    return out, n


def score(docs: DataFrame, train) -> DataFrame:
    """Per row: did, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    ``train`` is the condition of the rows to learn from. A null or empty text is the end alone. Without training rows nothing is known and every bit is even.
    """
    docs = keyed(docs).withColumn("train", train(id_back(F.col("did"))))
    base, n = unigram(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where("train")))
    scores = docs.select("did", "th", "text").mapInArrow(_scores(model), "did bigint, th bigint, n_bytes bigint, score double")
    scores = scores.withColumn("train", train(id_back(F.col("did"))))
    return scores.join(base, ["did", "th"]).select(
        "did", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score",
        (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; nine tenths of the ids teach."""
    out = score(table(spark, sf_dir, "documents"), lambda doc_id: fold(doc_id, 10) != 0)
    return out.select(id_back(F.col("did")).alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
