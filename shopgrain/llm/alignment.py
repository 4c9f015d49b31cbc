"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of linked token pairs.

Texts are cut before every space that follows a character other than white space. Neither vocabulary has a token across such a place, so a segment's tokens, groups and links are those it
has anywhere; all different segments of a block of texts are encoded and aligned once. Token ends of both sides cut a segment into stretches, and each stretch is one link: the A and the B token over it.

Counts take two passes over the texts. The first gathers per task the distinct pairs and in how many texts each is linked, in blocks by A id. The blocks' keys meet by a tree of unions, and
each block gets a minimal perfect hash; every task's counts become a dense vector at the hash's indices, and the vectors are summed by a tree. The second pass aligns the texts anew and looks the counts up, with the key at each index
verified. The tables go out in slices of bounded size, one pass of the texts each; a block holds 393 A ids at most, thus 393 * 32,000 pairs whatever the corpus.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import text as X
from .common import materialized, table
from .runs import ragged

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Bytes of text that are aligned together, pairs a task holds before it hands them on, blocks of pairs, vectors that one task adds up, and bytes of tables that a worker holds.
GROUP_BYTES = 4 << 20
TASK_PAIRS = 2 << 20
BLOCKS = 128
FAN = 32
SLICE_BYTES = 64 << 20
#: Characters of joined segments that the piece encoder takes at once.
JOINED = 1 << 10

_UNDERLINE = "▁"
#: UTF-8 of the white space beyond ASCII, as numbers of two and three bytes.
_WIDE = [int.from_bytes(chr(c).encode(), "big") for c in range(0x80, 0x10000) if chr(c).isspace()]
_ASCII_SPACE = np.array([c < 128 and chr(c).isspace() for c in range(256)])


class Tokenizers:
    """Both vocabularies, with the bytes of every token. A is read as ranks: the same ids as those of its tokenizer file with special strings as plain text, at less memory."""

    def __init__(self, a_path: str, b_path: str):
        with open(a_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            a_bytes[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_UNDERLINE, " ").encode() for i, p in enumerate(pieces)]
        if any(b" " in t.lstrip(b" ") and t.strip(b" ") for t in b_bytes):
            raise ValueError(f"{b_path} has pieces across words")
        self.space = self.b.piece_to_id(_UNDERLINE)
        self.n_b = len(b_bytes)
        self.a_bytes, self.a_size = _byte_table(a_bytes)
        self.b_bytes, self.b_size = _byte_table(b_bytes)
        self.a_names, self.b_names = (pa.array([str(i) for i in range(n)], pa.string()) for n in (len(a_bytes), self.n_b))

    def encode(self, segments: list[str], plain: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments by A and by B. Each begins with a space; those from ``plain`` on end with white space too, which would run into the next one's space, and are encoded one by one."""
        ends = np.cumsum([len(s) for s in segments[:plain]])
        runs, at = [], 0
        while at < plain:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + JOINED, "right")))
            runs.append("".join(segments[at:to]))
            at = to
        runs += segments[plain:]
        ids_a = [self.a.encode_to_numpy(r, disallowed_special=()) for r in runs]
        ids_b = [self.b.encode(r[1:], num_threads=1) if len(r) > 1 else [self.space] for r in runs]
        return (np.concatenate(ids_a).astype(np.int64) if ids_a else np.zeros(0, np.int64)), np.fromiter(chain.from_iterable(ids_b), np.int64)


def _byte_table(tokens: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    size = np.array([len(t) for t in tokens], np.int64)
    return (np.frombuffer(b"".join(tokens), np.uint8), np.append(0, np.cumsum(size))[:-1]), size


def _bytes(table: tuple[np.ndarray, np.ndarray], size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    n = size[ids]
    return table[0][np.repeat(table[1][ids], n) + ragged(n)]


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(paths: tuple[str, str]) -> Tokenizers:
    """One pair per Python worker."""
    if paths not in _loaded:
        _loaded[paths] = Tokenizers(*paths)
    return _loaded[paths]


@dataclass
class Aligned:
    """A block of texts. ``word`` numbers each text's segments among the different ones, ``of`` bounds the texts; the rest is per different segment."""

    of: np.ndarray
    word: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    links: np.ndarray  # A id * n_b + B id of every link, segment by segment
    link_of: np.ndarray  # bounds of the segments' links
    groups: pa.Array = field(default=None)


def _distinct(values: np.ndarray) -> np.ndarray:
    """All different values, ascending. Sorting is several times as fast here as the hash table of ``np.unique``."""
    values = np.sort(values, kind="stable")
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _segments(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """Segments of " " + text for every text (none for an empty one), and how many lie before each bound. A segment begins at a space that follows a character other than white space."""
    data, offsets = X.utf8(pa.array([" " + t if t else "" for t in texts], pa.string()))
    at = np.flatnonzero(data == 0x20)
    at = at[at > 0]
    at = at[~_ASCII_SPACE[data[at - 1]]]
    wide = np.flatnonzero(data[at - 1] >= 0x80)
    two = data[at[wide] - 2].astype(np.int64) << 8 | data[at[wide] - 1]
    three = data[np.maximum(at[wide] - 3, 0)].astype(np.int64) << 16 | two
    at = np.delete(at, wide[np.isin(two, _WIDE) | np.isin(three, _WIDE)])
    cuts = _distinct(np.append(at, offsets))
    return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)), np.searchsorted(cuts, offsets)


def align(model: Tokenizers, texts: list[str], with_groups: bool) -> Aligned:
    """Align all texts; one that the piece vocabulary cannot give back (it holds U+2581) has no tokens."""
    words, of = _segments(["" if _UNDERLINE in t else t for t in texts])
    numbered = words.dictionary_encode()
    segments = numbered.dictionary.to_pylist()
    word = np.asarray(numbered.indices, dtype=np.int64)
    open_end = np.array([s[-1].isspace() for s in segments], bool)
    apart = np.argsort(open_end, kind="stable")  # those that end with white space come last
    place = np.empty(len(segments), np.int64)
    place[apart] = np.arange(len(segments))
    segments, word = [segments[i] for i in apart.tolist()], place[word]
    a, b = model.encode(segments, int((~open_end).sum()))
    data, bound = X.utf8(pa.array(segments, pa.string()))
    same = [np.array_equal(_bytes(t, size, ids), data) for t, size, ids in ((model.a_bytes, model.a_size, a), (model.b_bytes, model.b_size, b))]
    if not all(same):
        raise ValueError("a vocabulary does not give back the bytes of plain text")
    a_end, b_end = np.cumsum(model.a_size[a]), np.cumsum(model.b_size[b])
    cuts = _distinct(np.append(a_end, b_end))
    both = a_end[np.isin(a_end, b_end, assume_unique=True, kind="sort")]
    links = a[np.searchsorted(a_end, cuts)] * model.n_b + b[np.searchsorted(b_end, cuts)]

    def per_segment(ends: np.ndarray) -> np.ndarray:
        return np.searchsorted(ends, bound, "right")

    at_a, at_b, at_g, at_l = (per_segment(e) for e in (a_end, b_end, both, cuts))
    out = Aligned(of, word, np.diff(at_a), np.diff(at_b), np.diff(at_g), links, at_l)
    if with_groups:
        sides = []
        for names, ids, ends in ((model.a_names, a, a_end), (model.b_names, b, b_end)):
            group = np.append(0, np.searchsorted(ends, both, "right"))
            sides.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(group, pa.int32()), names.take(pa.array(ids))), ","))
        each = pc.binary_join_element_wise(*sides, "|")
        out.groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(at_g, pa.int32()), each), ";")
    return out


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    column = batch.column("text")
    _, offsets = X.utf8(column)
    for i, j in X.rounds(offsets, GROUP_BYTES):
        yield i, j, [t or "" for t in column.slice(i, j - i).to_pylist()]


def text_counts(aligned: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """All different linked pairs of the block, ascending, and in how many texts each is linked."""
    pairs, at = np.unique(aligned.links, return_inverse=True)
    n_texts, n_words = len(aligned.of) - 1, len(aligned.n_a)
    text = np.repeat(np.arange(n_texts), np.diff(aligned.of))
    seen = _distinct(text * max(n_words, 1) + aligned.word)  # each segment once a text
    text, word = seen // max(n_words, 1), seen % max(n_words, 1)
    n = np.diff(aligned.link_of)[word]
    cell = np.repeat(text, n) * max(len(pairs), 1) + at[np.repeat(aligned.link_of[word], n) + ragged(n)]
    return pairs, np.bincount(_distinct(cell) % max(len(pairs), 1), minlength=len(pairs)).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _gather(paths: tuple[str, str], task_pairs: int, blocks: int):
    """Rows (block, part, keys, counts): the pairs of a task by block, in as many parts as the bound asks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizers(paths)
        partition = TaskContext.get().partitionId()
        keys, counts, parts = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def handed_on():
            block = keys // model.n_b % blocks
            order = np.argsort(block, kind="stable")
            bound = np.searchsorted(block[order], np.arange(blocks + 1))
            rows = [b for b in range(blocks) if bound[b] < bound[b + 1]]
            pick = [order[bound[b] : bound[b + 1]] for b in rows]
            cols = [pa.array(rows, pa.int32()), pa.array([partition << 20 | parts] * len(rows), pa.int64()), *(pa.array([v[p].tobytes() for p in pick], pa.binary()) for v in (keys, counts))]
            return pa.RecordBatch.from_arrays(cols, ["block", "part", "keys", "counts"])

        for batch in batches:
            for _, _, texts in _texts(batch):
                more = text_counts(align(model, texts, False))
                keys, counts = _summed(np.append(keys, more[0]), np.append(counts, more[1]))
                if len(keys) >= task_pairs:
                    yield handed_on()
                    keys, counts, parts = keys[:0], counts[:0], parts + 1
        if len(keys):
            yield handed_on()

    return task


class MinimalHash:
    """Minimal perfect hash of distinct keys: level by level, keys alone in their slot of a bit map are placed; a key's index is the number of bits set before its own."""

    def __init__(self, keys: np.ndarray, spread: float = 2.0):
        self.sizes: list[int] = []
        levels = []
        rest = keys
        while len(rest):
            size = max(64, int(spread * len(rest)) + 63 & ~63)
            slot = self._slot(rest, len(self.sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            self.sizes.append(size)
            rest = rest[~alone[slot]]
        self.bits = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.bits))).astype(np.int64)

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (X.mix(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; a number that is no key may get any index, or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        base = 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            slot = self._slot(keys[todo], level, size) + base
            word, bit = slot >> 6, (slot & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            below = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            todo = todo[~hit]
            base += size
        return out


class Counts:
    """Counts of pairs behind a minimal perfect hash, the key at each index kept to verify what is asked."""

    def __init__(self, hashed: MinimalHash, keys: np.ndarray, counts: np.ndarray | None = None):
        self.hashed, self.keys, self.counts = hashed, keys, counts

    @classmethod
    def of(cls, keys: np.ndarray) -> Counts:
        hashed = MinimalHash(keys)
        placed = np.empty(len(keys), np.uint32)
        placed[hashed(keys)] = keys
        return cls(hashed, placed)

    def index(self, keys: np.ndarray) -> np.ndarray:
        at = self.hashed(keys)
        if not np.array_equal(self.keys[at], keys) or (at < 0).any():
            raise KeyError("a pair is missing from the table of counts")
        return at


def _unpacked(column) -> np.ndarray:
    return np.concatenate([np.frombuffer(c, np.int64) for c in column])


def _union(key: tuple, rows: pa.Table) -> pa.Table:
    keys = _distinct(_unpacked(rows.column("keys").to_pylist()))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "keys": pa.array([keys.tobytes()], pa.binary())})


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [pickle.dumps(Counts.of(np.frombuffer(k, np.int64))) for k in batch.column("keys").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(made, pa.binary())], ["block", "hash"])


def _dense(key: tuple, rows: pa.Table, hashes: pa.Table) -> pa.Table:
    counts = pickle.loads(hashes.column("hash")[0].as_py())
    vector = np.zeros(len(counts.keys), np.int64)
    for keys, n in zip(rows.column("keys").to_pylist(), rows.column("counts").to_pylist()):
        vector[counts.index(np.frombuffer(keys, np.int64))] += np.frombuffer(n, np.int64)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "vector": pa.array([vector.tobytes()], pa.binary())})


def _vector_sum(key: tuple, rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(v, np.int64) for v in rows.column("vector").to_pylist()], axis=0)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "vector": pa.array([total.tobytes()], pa.binary())})


def _grouped(df: DataFrame, parts: int):
    return df.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(parts))).groupBy("block", "part")


def pair_counts(docs: DataFrame, paths: tuple[str, str], task_pairs: int = TASK_PAIRS, blocks: int = BLOCKS, fan: int = FAN) -> DataFrame:
    """(block, hash, vector): per block of pairs a pickled ``Counts`` without its counts, and these as a vector of int64 at the hash's indices."""
    gathered = materialized(docs.select("text").mapInArrow(_gather(paths, task_pairs, blocks), "block int, part bigint, keys binary, counts binary"))
    most = gathered.groupBy("block").count().agg(F.max("count")).first()[0] or 1
    levels = []
    while not levels or levels[-1] > 1:
        levels.append(-(-(levels[-1] if levels else most) // fan))
    keys = gathered.select("block", "part", "keys")
    for parts in levels:
        keys = _grouped(keys, parts).applyInArrow(_union, "block int, part bigint, keys binary")
    hashes = materialized(keys.select("block", "keys").mapInArrow(_hash, "block int, hash binary"))
    each = hashes.select("block", F.explode(F.expr(f"sequence(0L, {levels[0] - 1}L)")).alias("part"), "hash")
    vectors = _grouped(gathered, levels[0]).cogroup(each.groupBy("block", "part")).applyInArrow(_dense_or_none, "block int, part bigint, vector binary")
    for parts in levels[1:]:
        vectors = _grouped(vectors, parts).applyInArrow(_vector_sum, "block int, part bigint, vector binary")
    return materialized(vectors.select("block", "vector").join(hashes, "block"))


def _dense_or_none(key: tuple, rows: pa.Table, hashes: pa.Table) -> pa.Table:
    if rows.num_rows:
        return _dense(key, rows, hashes)
    return pa.table({"block": pa.array([], pa.int32()), "part": pa.array([], pa.int64()), "vector": pa.array([], pa.binary())})


_ROW = "doc_id bigint, text string, n_best bigint, count_sum bigint"
_OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"


def _look_up(paths: tuple[str, str], blocks: int, tables, last: bool):
    """Adds what the links in the given blocks have; with ``last`` the alignment takes the place of the text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizers(paths)
        have = {}
        for b, (hashed, vector) in tables.value.items():
            counts = pickle.loads(hashed)
            counts.counts = np.frombuffer(vector, np.int64)
            highest = np.zeros(len(model.a_names) // blocks + 1, np.int64)  # by A id, of which every block has each ``blocks``-th
            np.maximum.at(highest, counts.keys // model.n_b // blocks, counts.counts)
            have[b] = counts, highest
        for batch in batches:
            for i, j, texts in _texts(batch):
                aligned = align(model, texts, last)
                pairs, at = np.unique(aligned.links, return_inverse=True)
                block = pairs // model.n_b % blocks
                count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
                order = np.argsort(block, kind="stable")
                bound = np.searchsorted(block[order], np.arange(blocks + 1))
                for b, (counts, highest) in have.items():
                    k = order[bound[b] : bound[b + 1]]
                    count[k] = counts.counts[counts.index(pairs[k])]
                    best[k] = count[k] == highest[pairs[k] // model.n_b // blocks]

                def per_text(of_segment: np.ndarray) -> np.ndarray:
                    return np.diff(np.append(0, np.cumsum(of_segment[aligned.word]))[aligned.of])

                def per_link(of_pair: np.ndarray) -> np.ndarray:
                    return per_text(np.diff(np.append(0, np.cumsum(of_pair[at]))[aligned.link_of]))

                cols = {"doc_id": batch.column("doc_id").slice(i, j - i)}
                added = {c: np.asarray(batch.column(c).slice(i, j - i)) + per_link(v) for c, v in (("n_best", best), ("count_sum", count))}
                if last:
                    cols |= {"n_a": per_text(aligned.n_a), "n_b": per_text(aligned.n_b), "n_groups": per_text(aligned.n_groups), "n_links": per_text(np.diff(aligned.link_of)), **added}
                    groups = pa.ListArray.from_arrays(pa.array(aligned.of, pa.int32()), aligned.groups.take(pa.array(aligned.word)))
                    cols["groups"] = pc.binary_join(groups, ";")
                else:
                    cols |= {"text": batch.column("text").slice(i, j - i), **added}
                yield pa.RecordBatch.from_pydict(cols)

    return task


def _slices(sizes: list[tuple[int, int]], limit: int) -> list[list[int]]:
    """Blocks, in order, in slices of at most ``limit`` bytes, or of one block."""
    out: list[list[int]] = []
    room = 0
    for block, size in sizes:
        if not out or size > room:
            out.append([])
            room = limit
        out[-1].append(block)
        room -= size
    return out


def vocabulary_paths() -> tuple[str, str]:
    return public_tokenizers.path(A_VOCABULARY), public_tokenizers.path(B_VOCABULARY)


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None, task_pairs: int = TASK_PAIRS, blocks: int = BLOCKS, fan: int = FAN, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per row: doc_id, n_a and n_b (tokens of " " + text by A, of text by B), n_groups (stretches between places where tokens of both end), n_links (pairs of tokens with bytes in common), n_best (links of a
    pair whose count is its A id's highest), count_sum (over links, of the number of rows with that pair linked) and groups (``a1,a2|b1;a3|b2``).

    A null or empty text, and one with U+2581, which B turns into a space, has no tokens: zeros and an empty ``groups``. Each row is one text, repeated rows and ids as well, also in the counts;
    ids may be null, further columns play no part. An empty table gives no rows.

    Every slice of the counts (``slice_bytes``, or one block) costs one pass over the texts; what has been added up is written between passes.
    """
    paths = paths or vocabulary_paths()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = pair_counts(rows, paths, task_pairs, blocks, fan)
    sizes = counts.select("block", (F.length("hash") + F.length("vector")).alias("size")).orderBy("block").collect()  # one row a block
    slices = _slices([(r.block, r.size) for r in sizes], slice_bytes) or [[]]
    out = rows.select("*", F.lit(0).cast("bigint").alias("n_best"), F.lit(0).cast("bigint").alias("count_sum"))
    for k, names in enumerate(slices):
        tables = docs.sparkSession.sparkContext.broadcast({r.block: (bytes(r.hash), bytes(r.vector)) for r in counts.where(F.col("block").isin(names)).collect()})
        last = k == len(slices) - 1
        out = out.mapInArrow(_look_up(paths, blocks, tables, last), _OUT if last else _ROW)
        if not last:
            out = materialized(out)
    return out


def op12_minimal_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers on all documents, with counts of linked pairs over all of them."""
    out = aligned(table(spark, sf_dir, "documents"))
    return out.select(*out.columns[:-1], F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256"))
