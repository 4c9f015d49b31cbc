"""BPE encoding by a dynamic programme over prefixes, and decoding.

Of a word's encoding under byte-pair merges every prefix has one last token: the longest vocabulary entry that ends there and is compatible with the last token of the prefix before it. A
suffix automaton of the vocabulary finds the entries that end at each place, longest first; two tokens are compatible when no merge across their border would have come before
the merges that made them. Following the tokens back from the end gives the ids, with no merge ever carried out.

The words of a block of texts are numbered, and all different words go through the programme side by side, one place at a time. The tables of the automaton are built once from
the vocabulary file and broadcast: their size is bound by the vocabulary (49,408 entries: some 10 MB).
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from . import text as X
from .common import table
from .runs import ragged

VOCABULARY = "word_bpe_49k.json"
#: Bytes of text whose words are numbered together, and the number of words that are worth an array step.
GROUP_BYTES = 4 << 20
FEW = 8
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
_NEVER = np.iinfo(np.int32).max


def byte_alphabet() -> list[str]:
    """The characters that stand for bytes 0 to 255 in byte-level vocabularies: printable ones for themselves, the others by ascending code points from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def character_classes() -> np.ndarray:
    """Class of every code point. Those without a category here are UNKNOWN: the tokenizer's library may know them from a later Unicode version."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], OTHER) for i in range(sys.maxunicode + 1)], np.uint8)
    for c in range(sys.maxunicode + 1):
        if chr(c).isspace() and not 0x1C <= c <= 0x1F:
            out[c] = SPACE
    return out


class Lookup:
    """Open-addressed table from 64-bit keys to int32, asked with whole arrays; -1 where a key is missing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = (1 << int(3 * len(keys) + 8).bit_length()) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at], self.values[at] = keys[todo[won]], values[todo[won]]
            stay = np.ones(len(todo), bool)
            stay[won] = False
            todo, slot = todo[stay], (slot[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) >> np.uint64(7)).view(np.int64) & self.mask

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], -1)
        todo = np.flatnonzero((seen != keys) & (seen >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            seen = self.keys[slot]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (seen >= 0)
            todo, slot = todo[go], slot[go]
        return out

    def as_dict(self) -> dict[int, int]:
        used = self.keys >= 0
        return dict(zip(self.keys[used].tolist(), self.values[used].tolist()))


def suffix_automaton(words: list[tuple[int, ...]]) -> tuple[list[dict[int, int]], list[int], list[int], dict[tuple[int, ...], int]]:
    """Transitions, suffix links and lengths of the automaton of all substrings of ``words``, and the state of each word. Words enter by length, over their trie."""
    edges, link, length = [{}], [-1], [0]
    state = {(): 0}
    by_depth: dict[int, dict[tuple[int, ...], None]] = {}
    for w in words:
        for k in range(1, len(w) + 1):
            by_depth.setdefault(k, {})[w[:k]] = None
    for depth in sorted(by_depth):
        for prefix in by_depth[depth]:
            c, p = prefix[-1], state[prefix[:-1]]
            new = len(edges)
            edges.append({})
            link.append(0)
            length.append(length[p] + 1)
            state[prefix] = new
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p < 0:
                continue
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
                continue
            copy = len(edges)
            edges.append(dict(edges[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            while p >= 0 and edges[p].get(c) == q:
                edges[p][c] = copy
                p = link[p]
            link[q] = link[new] = copy
    return edges, link, length, {w: state[w] for w in words}


class PrefixModel:
    """The tables: symbols are bytes 0 to 255, and the same plus 256 for the last byte of a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, merges = spec["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.path, end = path, spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.n = max([*vocabulary.values(), *self.special.values()]) + 1
        self.strings: list[str | None] = [None] * self.n
        for s, i in [*vocabulary.items(), *self.special.items()]:
            self.strings[i] = s
        alphabet = byte_alphabet()
        symbols: dict[int, tuple[int, ...]] = {vocabulary[c]: (b,) for b, c in enumerate(alphabet)} | {vocabulary[c + end]: (b + 256,) for b, c in enumerate(alphabet)}
        self.first = np.full(self.n, -1, np.int32)  # the two parts of a merged token; itself for a single symbol
        self.second = np.full(self.n, -1, np.int32)
        born = np.full(self.n, -1, np.int32)  # when a token's merge comes; single symbols are there from the start
        for t in symbols:
            self.first[t] = self.second[t] = t
        for rank, (a, b) in enumerate(merges):
            i, j, t = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if i not in symbols or j not in symbols or t in symbols:
                raise ValueError(f"merge {rank} of {path} comes before its parts or makes a token twice")
            symbols[t], self.first[t], self.second[t], born[t] = symbols[i] + symbols[j], i, j, rank
        self.born = born
        self.size = np.zeros(self.n, np.int32)
        self.size[list(symbols)] = [len(s) for s in symbols.values()]
        merged = np.flatnonzero(born >= 0)
        self.pairs = Lookup(self.first[merged].astype(np.int64) * self.n + self.second[merged], born[merged])
        edges, link, length, state = suffix_automaton(list(symbols.values()))
        token = {state[s]: t for t, s in symbols.items()}
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)
        self.head = np.full(len(link), -1, np.int32)  # the longest token that ends a state's longest string
        for v in np.argsort(self.length, kind="stable"):
            self.head[v] = token.get(v, self.head[link[v]] if v else -1)
        self.shorter = np.full(self.n, -1, np.int32)  # the next shorter token that ends a token
        for s, t in ((state[s], t) for t, s in symbols.items()):
            self.shorter[t] = self.head[link[s]]
        flat = [(v * 512 + c, to) for v, e in enumerate(edges) for c, to in e.items()]
        self.edges = Lookup(np.array([k for k, _ in flat], np.int64), np.array([x for _, x in flat], np.int32))
        self.classes = character_classes()
        self._library: Tokenizer | None = None
        self._plain: dict | None = None

    def library(self) -> Tokenizer:
        """For texts with characters unknown here: only its normaliser and its splitter are asked."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
        return self._library

    def __getstate__(self):
        return self.__dict__ | {"_library": None, "_plain": None}

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave a and b side by side.

        Back in time from (a, b), the piece that came later is undone: of a its right part stays at the border, of b its left part. Two pieces that stand at the border
        together are merged if that merge comes before the one that takes up a's piece, and not after the one that takes up b's (of equal merges the left one comes first).
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a, b
        x_ends = np.full(len(a), _NEVER, np.int32)
        y_ends = x_ends
        while len(at):
            m = self.pairs(x.astype(np.int64) * self.n + y)
            bad = (m >= 0) & (m < x_ends) & (m <= y_ends)
            good[at[bad]] = False
            bx, by = self.born[x], self.born[y]
            go = ~bad & ((bx >= 0) | (by >= 0))
            at, x, y, x_ends, y_ends, bx, by = (v[go] for v in (at, x, y, x_ends, y_ends, bx, by))
            undo = bx > by
            x_ends, y_ends = np.where(undo, bx, x_ends), np.where(undo, y_ends, by)
            x, y = np.where(undo, self.second[x], x), np.where(undo, y, self.first[y])
        return good

    def last_tokens(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Last token of every prefix of the words symbols[start : start + size], at the prefix's last place. Words by falling size."""
        last = np.zeros(len(symbols), np.int32)
        v, l = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
        for i in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -i, "left"))  # words with more than i symbols
            if k < FEW:
                for w in range(k):
                    self._rest(symbols[start[w] : start[w] + size[w]], last[start[w] : start[w] + size[w]], i, int(v[w]), int(l[w]))
                break
            o = start[:k] + i
            v, l = self._advanced(v[:k], l[:k], symbols[o])
            t = np.where(l == self.length[v], self.head[v], self.head[self.link[v]])
            todo = np.flatnonzero(self.size[t] < i + 1)
            while len(todo):
                before = last[o[todo] - self.size[t[todo]]]
                todo = todo[~self.compatible(before, t[todo])]
                t[todo] = self.shorter[t[todo]]
                todo = todo[self.size[t[todo]] < i + 1]
            last[o] = t
        return last

    def _advanced(self, v: np.ndarray, l: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and length of the longest match that ends with the next symbol."""
        v, l = v.copy(), l.copy()
        to = self.edges(v.astype(np.int64) * 512 + c)
        todo = np.flatnonzero(to < 0)
        while len(todo):
            v[todo] = self.link[v[todo]]
            l[todo] = self.length[v[todo]]
            to[todo] = self.edges(v[todo].astype(np.int64) * 512 + c[todo])
            todo = todo[to[todo] < 0]
        return to.astype(np.int32), l + 1

    def _rest(self, symbols: np.ndarray, last: np.ndarray, i: int, v: int, l: int) -> None:
        """The same from place i on for one word, in plain numbers: long words are few."""
        if self._plain is None:
            tables = {c: getattr(self, c).tolist() for c in ("born", "first", "second", "size", "link", "length", "head", "shorter")}
            self._plain = tables | {"edges": self.edges.as_dict(), "pairs": self.pairs.as_dict()}
        link, length, head, shorter, sizes, edges = (self._plain[c] for c in ("link", "length", "head", "shorter", "size", "edges"))
        known = last[:i].tolist()
        for k, c in enumerate(symbols[i:].tolist(), i):
            while (to := edges.get(v * 512 + c)) is None:
                v = link[v]
                l = length[v]
            v, l = to, l + 1
            t = head[v] if l == length[v] else head[link[v]]
            while sizes[t] <= k and not self._pair(known[k - sizes[t]], t):
                t = shorter[t]
            known.append(t)
        last[i:] = known[i:]

    def _pair(self, x: int, y: int) -> bool:
        """``compatible`` for two tokens."""
        born, first, second, pairs = (self._plain[c] for c in ("born", "first", "second", "pairs"))
        x_ends = y_ends = _NEVER
        while True:
            m = pairs.get(x * self.n + y)
            if m is not None and m < x_ends and m <= y_ends:
                return False
            bx, by = born[x], born[y]
            if bx < 0 and by < 0:
                return True
            if bx > by:
                x, x_ends = second[x], bx
            else:
                y, y_ends = first[y], by

    def encode_words(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        order = np.argsort(-size, kind="stable")
        last = self.last_tokens(symbols, start[order], size[order])
        steps, left, at = [], size.astype(np.int64), np.arange(len(size))
        at = at[left > 0]
        while len(at):
            t = last[start[at] + left[at] - 1]
            steps.append((at, t))
            left[at] -= self.size[t]
            at = at[left[at] > 0]
        counts = np.zeros(len(size), np.int64)
        for at, _ in steps:
            counts[at] += 1
        ids, ends = np.empty(counts.sum(), np.int32), np.cumsum(counts)
        for k, (at, t) in enumerate(steps):
            ids[ends[at] - 1 - k] = t
        return ids, counts


def split_words(text: str, rows: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """UTF-8 bytes of all words, their ends, and how many words lie before each row bound; ``rows`` bounds the rows of the joined text in characters. None if a character is unknown.

    Words are runs of letters, single numbers and runs of other characters without white space; an apostrophe that begins a run of its own takes s, t, m, d, re, ve or ll with it.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    code = data if len(data) == len(text) else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = classes[code]
    if (kind == UNKNOWN).any():
        return None
    n = len(code)
    new = np.ones(n + 1, bool)
    new[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    new[rows] = True
    quote = np.flatnonzero((code == 0x27) & new[:n] & new[1:])
    quote = quote[quote < n - 1]
    quote = quote[(kind[quote + 1] == LETTER) & ~np.isin(quote + 1, rows)]
    one = code[quote + 1]
    two = np.where(new[np.minimum(quote + 2, n)], 0, code[np.minimum(quote + 2, n - 1)])
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(quote), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    new[quote[short | long] + 1] = False
    new[quote[short] + 2] = True
    new[quote[long] + 3] = True
    ink = kind != SPACE
    first = np.flatnonzero(new[:n] & ink)
    if code is data:
        letters, width = data[ink], ink.astype(np.int64)
    else:
        each = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        letters, width = data[np.repeat(ink, each)], np.where(ink, each, 0)
    before = np.append(0, np.cumsum(width))
    return letters, before[np.append(first[1:], n)] if len(first) else before[:0], np.searchsorted(first, rows)


def _normalized(s: str) -> str:
    """Composed and in lower case, letter by letter: a final sigma has no form of its own."""
    if s.isascii():
        return s.lower()
    return unicodedata.normalize("NFC", s).replace("Σ", "σ").lower()


def _word_chunk(model: PrefixModel, segments: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """Words of all segments, and how many lie before each bound."""
    normal = [_normalized(s) for s in segments]
    found = split_words("".join(normal), np.append(0, np.cumsum([len(s) for s in normal])).astype(np.int64), model.classes)
    if found is None:
        library = model.library()
        lists = []
        for s in segments:
            s = library.normalizer.normalize_str(s)
            lists.append([s[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(s)])
        return pa.array([w for ws in lists for w in ws], pa.string()), np.append(0, np.cumsum([len(ws) for ws in lists])).astype(np.int64)
    letters, ends, of = found
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters))), of


def encode_texts(model: PrefixModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and how many each has."""
    pattern = re.compile("|".join(re.escape(s) for s in sorted(model.special, key=len, reverse=True)))
    chunks, bounds, marks = [], [], []  # marks: the special token after each segment, or -1
    owner: list[int] = []
    segments: list[str] = []
    size = 0

    def close():
        words, of = _word_chunk(model, segments)
        chunks.append(words)
        bounds.append(np.diff(of))
        segments.clear()

    for r, text in enumerate(texts):
        at = 0
        for hit in pattern.finditer(text) if "<|" in text else ():
            segments.append(text[at : hit.start()])
            owner.append(r)
            marks.append(model.special[hit.group()])
            at = hit.end()
        segments.append(text[at:] if at else text)
        owner.append(r)
        marks.append(-1)
        size += len(text)
        if size >= X.ROUND_BYTES:
            close()
            size = 0
    if segments:
        close()
    numbered = pa.chunked_array(chunks, pa.string()).dictionary_encode().combine_chunks() if chunks else None
    if numbered is None:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    if isinstance(numbered, pa.ChunkedArray):
        numbered = numbered.chunk(0)
    letters, offsets = X.utf8(numbered.dictionary)
    symbols = letters.astype(np.int16)
    symbols[offsets[1:] - 1] += 256
    ids, counts = model.encode_words(symbols, offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64))
    # the special tokens stand behind the words as words of one token
    mark, owner_at = np.array(marks, np.int64), np.array(owner, np.int64)
    special = list(model.special.values())
    ids, counts = np.append(ids, special), np.append(counts, np.ones(len(special), np.int64))
    word = np.asarray(numbered.indices, dtype=np.int64)
    per_segment = np.concatenate(bounds)
    marked = np.flatnonzero(mark >= 0)
    word = np.insert(word, np.cumsum(per_segment)[marked], len(numbered.dictionary) + np.array([special.index(m) for m in mark[marked]], np.int64))
    per_segment[marked] += 1
    per_text = np.bincount(owner_at, per_segment, len(texts)).astype(np.int64)
    n = counts[word]
    first = np.append(0, np.cumsum(counts))[word]
    out = ids[np.repeat(first, n) + ragged(n)]
    whole = np.append(0, np.cumsum(n))
    return out.astype(np.int32), np.diff(whole[np.append(0, np.cumsum(per_text))])


def _encode(model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            _, offsets = X.utf8(column)
            for i, j in X.rounds(offsets, GROUP_BYTES):
                ids, counts = encode_texts(model.value, [t or "" for t in column.slice(i, j - i).to_pylist()])
                at = np.append(0, np.cumsum(4 * counts)).astype(np.int32)
                cells = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(ids.astype("<u4")))])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(i, j - i), "n_tokens": pa.array(counts, pa.int64()), "ids": cells})

    return task


def _decode(model, keep: list[str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.array(model.value.strings, pa.string())
        for batch in batches:
            column = batch.column("ids").fill_null(b"").cast(pa.large_binary())
            offsets = np.append(0, np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))).astype(np.int64)
            for i, j in X.rounds(offsets, GROUP_BYTES):
                ids = np.frombuffer(b"".join(column.slice(i, j - i).to_pylist()), "<u4")
                known = np.append(0, np.cumsum(ids < len(strings)))
                bound = known[(offsets[i : j + 1] - offsets[i]) // 4]
                tokens = strings.take(pa.array(ids[ids < len(strings)], pa.uint32()))
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(bound, pa.int32()), tokens), " ")
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in keep), text], [*keep, "decoded"])

    return task


def model(spark: SparkSession, path: str | None = None):
    """The broadcast tables of a vocabulary file with word ends; a merge whose parts come later than itself is refused."""
    return spark.sparkContext.broadcast(PrefixModel(path or public_tokenizers.path(VOCABULARY)))


def encoded(docs: DataFrame, tables) -> DataFrame:
    """Per row: doc_id, n_tokens and ids (little-endian unsigned 32-bit numbers) of the whole text; ``tables`` from ``model``.

    A null or empty text, or one of white space, has no tokens. The strings of special tokens in a text become those tokens. Each row is one text: repeated rows, equal or null
    ids and further columns play no part. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(tables), "doc_id bigint, n_tokens bigint, ids binary")


def decoded(rows: DataFrame, tables) -> DataFrame:
    """All columns and ``decoded``: the vocabulary's strings of ``ids`` joined by one space, special tokens too, as the vocabulary names no decoder. Ids outside the vocabulary are left out; null ids give an empty text."""
    plain = rows.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(_decode(tables, plain.columns), f"{schema}, decoded string")


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    tables = model(spark)
    out = decoded(encoded(table(spark, sf_dir, "documents"), tables), tables)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
