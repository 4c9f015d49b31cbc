"""Periodic runs of words: longest common extensions over a difference cover, asked on a harmonic grid.

A run is a maximal stretch of consecutive words whose smallest period is q and whose length is at least ``max(least, times * q)``. For every period q the words
at a grid of step ``(times - 1) * q`` are compared with those q further on; a run of that period holds a grid point, so n/1 + n/2 + ... comparisons find all runs.

How far two suffixes agree is an exact question: words are compared one by one until both positions lie in a difference cover (at most ``MODULUS - 1`` words), from
there the answer is the least common-prefix value between the two in the sorted order of the sampled suffixes, by a sparse table. Only texts in which some comparison gets that
far have their samples sorted. Words are numbered exactly, not hashed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import text as X
from .common import table

#: A perfect difference set: every difference modulo 13 is a difference of two members.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Grid comparisons of one round of array work.
QUERIES = 1 << 20

_IN_COVER = np.full(MODULUS, -1, np.int64)
_IN_COVER[list(COVER)] = range(len(COVER))


def _shifts() -> np.ndarray:
    """[(j - i) % MODULUS, i % MODULUS] -> words to go until both i and j are sampled."""
    out = np.zeros((MODULUS, MODULUS), np.int64)
    for x in COVER:
        for y in COVER:
            out[(y - x) % MODULUS] = (x - np.arange(MODULUS)) % MODULUS
    return out


SHIFT = _shifts()


def ragged(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for each count c."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Extensions:
    """Common extensions of suffixes of one text. ``ids`` are word numbers from 1, with a 0 after each text; ``text`` numbers the texts, ``wanted`` names those to index."""

    def __init__(self, ids: np.ndarray, text: np.ndarray, wanted: np.ndarray):
        self.ids = ids
        n, v = len(ids), MODULUS
        at = np.flatnonzero((_IN_COVER[np.arange(n) % v] >= 0) & wanted[text])
        self.sample = np.full(n + v + 1, -1, np.int32)
        self.sample[at] = np.arange(len(at), dtype=np.int32)
        padded = np.append(ids, np.zeros(v, ids.dtype))
        names, order = _names([text[at]] + [padded[at + k] for k in range(v)])
        levels = [names]
        step = v
        while True:  # windows of twice the words, for the names that several windows bear
            bearers = np.bincount(names, minlength=len(at))
            open_ = np.flatnonzero(bearers[names] > 1)
            if not len(open_):
                break
            later = self.sample[np.minimum(at[open_] + step, n)]
            second = np.where(later >= 0, names[later], -1)
            finer, _ = _names([names[open_], second])
            base = np.sort(names[open_])
            names = names.copy()
            names[open_] = _refined(base, finer, len(open_))
            levels.append(names)
            step *= 2
        self.rank = names  # all different now
        order = np.empty(len(at), np.int64)
        order[names] = np.arange(len(at))
        self.table = _sparse_minima(self._neighbours(at, order, levels))

    def _neighbours(self, at: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common words of each sampled suffix with the one before it in sorted order, up to the end of the text."""
        a, b = at[order[:-1]], at[order[1:]]
        common = np.zeros(len(a), np.int64)
        n = len(self.ids)
        for k in range(len(levels) - 1, -1, -1):
            x, y = self.sample[np.minimum(a + common, n)], self.sample[np.minimum(b + common, n)]
            same = (x >= 0) & (y >= 0)
            same[same] = levels[k][x[same]] == levels[k][y[same]]
            common[same] += MODULUS << k
        return np.append(0, common + _direct(self.ids, a + common, b + common, np.full(len(a), MODULUS)))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words of the suffixes at i and j, both in one indexed text."""
        shift = SHIFT[(j - i) % MODULUS, i % MODULUS]
        out = _direct(self.ids, i, j, shift)
        far = np.flatnonzero(out == shift)
        far = far[i[far] != j[far]]
        x, y = self.rank[self.sample[i[far] + shift[far]]], self.rank[self.sample[j[far] + shift[far]]]
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out[far] += np.minimum(self.table[level, lo], self.table[level, hi - (1 << level) + 1])
        return out


def _names(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each element how many have a smaller key (the first of ``keys`` counts most), and the sorted order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        s = key[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    names = np.empty(len(order), np.int64)
    names[order] = first
    return names, order


def _refined(base: np.ndarray, finer: np.ndarray, n: int) -> np.ndarray:
    """Names among the open ones turned into names among all: a group's first name plus the place inside the group."""
    group = np.maximum.accumulate(np.where(np.append(True, base[1:] != base[:-1]), np.arange(n), 0))
    return base[finer] + finer - group[finer]


def _sparse_minima(values: np.ndarray) -> np.ndarray:
    """[k, i]: least of the 2**k values from i on."""
    rows = [values.astype(np.int32)]
    width = 1
    while 2 * width <= len(values):
        last = rows[-1]
        rows.append(np.append(np.minimum(last[:-width], last[width:]), last[-width:]))
        width *= 2
    return np.stack(rows)


def _direct(ids: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int = 1) -> np.ndarray:
    """Words that agree from i and j on (backwards with ``step`` -1), at most ``most``."""
    out = np.zeros(len(i), np.int64)
    alive = np.flatnonzero(most > 0)
    n = 0
    while len(alive):
        a, b = i[alive] + step * n, j[alive] + step * n
        same = (a >= 0) & (b < len(ids))
        same &= ids[np.maximum(a, 0)] == ids[np.minimum(b, len(ids) - 1)]
        alive = alive[same]
        n += 1
        out[alive] = n
        alive = alive[most[alive] > n]
    return out


def _grid_hits(spread: np.ndarray, first: np.ndarray, counts: np.ndarray, times: int, least: int) -> np.ndarray:
    """Rows text, period, number and place of the grid points whose word is also one period further on, by text, period and number."""
    periods = np.where(counts >= least, counts // times, 0)
    of, q = np.repeat(np.arange(len(counts)), periods), ragged(periods) + 1
    points = (counts[of] - 1 - q) // ((times - 1) * q) + 1
    bound = np.append(0, np.cumsum(points))
    found = [np.zeros((4, 0), np.int64)]
    p = 0
    while p < len(q):
        e = max(p + 1, int(np.searchsorted(bound, bound[p] + QUERIES, "right")) - 1)
        c = points[p:e]
        qq, tt, k = np.repeat(q[p:e], c), np.repeat(of[p:e], c), ragged(c)
        i = first[tt] + k * (times - 1) * qq
        hit = np.flatnonzero(spread[i] == spread[i + qq])
        found.append(np.stack([tt[hit], qq[hit], k[hit], i[hit]]))
        p = e
    return np.concatenate(found, axis=1)


def find_runs(ids: np.ndarray, offsets: np.ndarray, times: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run, by text, start and period. ``ids`` number the words of all texts from 1, ``offsets`` bound the texts."""
    counts = np.diff(offsets)
    n_texts = len(counts)
    text = np.repeat(np.arange(n_texts), counts + 1)
    spread = np.zeros(len(ids) + n_texts, np.int64)
    first = offsets[:-1] + np.arange(n_texts)  # one place more per text, for the 0 at its end
    spread[np.repeat(np.arange(n_texts), counts) + np.arange(len(ids))] = ids
    t, q, k, i = _grid_hits(spread, first, counts, times, least)
    need = np.maximum(least - q, (times - 1) * q)  # words equal to the one q further on
    ahead = SHIFT[q % MODULUS, i % MODULUS]
    right = _direct(spread, i, i + q, np.maximum(ahead, MODULUS))
    room = np.minimum((times - 1) * q, i - first[t])
    left = _direct(spread, i - 1, i - 1 + q, np.minimum(room, MODULUS), -1)
    long_right, long_left = right >= np.maximum(ahead, MODULUS), (left >= MODULUS) & (room > MODULUS)
    stay = long_right | long_left | (right + left >= need)
    t, q, k, i, need, room, right, left, long_right, long_left = (a[stay] for a in (t, q, k, i, need, room, right, left, long_right, long_left))
    wanted = np.zeros(n_texts, bool)
    wanted[t[long_right | long_left]] = True
    if wanted.any():
        common = Extensions(spread, text, wanted)
        right[long_right] = common(i[long_right], i[long_right] + q[long_right])
        # a run that reaches back to the grid point before is found there
        before = np.flatnonzero(k > 0)
        seen = np.zeros(len(k), bool)
        prior = (k[before - 1] == k[before] - 1) & (q[before - 1] == q[before]) & (t[before - 1] == t[before]) & (before > 0)
        seen[before[prior]] = right[before[prior] - 1] >= ((times - 1) * q)[before[prior]]
        stay = ~seen & (long_left | (right + left >= need))
        t, q, i, need, room, right, left, long_left = (a[stay] for a in (t, q, i, need, room, right, left, long_left))
        far = np.flatnonzero(long_left)
        lo, hi = left[far], room[far]  # lo words back agree; the largest such number is asked for
        while len(far):
            mid = (lo + hi + 1) // 2
            s = i[far] - mid
            good = common(s, s + q[far]) >= mid
            lo, hi = np.where(good, mid, lo), np.where(good, hi, mid - 1)
            left[far] = lo
            more = lo < hi
            far, lo, hi = far[more], lo[more], hi[more]
    start, length = i - left, left + right + q
    step = (times - 1) * q
    whole = (left + right >= need) & ~((left >= step) & (i - first[t] >= step))  # the latter are found at the grid point before
    t, q, start, length = t[whole], q[whole], start[whole], length[whole]
    order = np.lexsort([q, length, start])
    t, q, start, length = t[order], q[order], start[order], length[order]
    new = np.ones(len(t), bool)  # of one stretch the smallest period counts
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    t, q, start, length = t[new], q[new], start[new], length[new]
    order = np.lexsort([q, start])
    t, q, start, length = t[order], q[order], start[order], length[order]
    return t, start - first[t], length, q


def _strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """Index of the run with the greatest exact length / period; ties to the smallest start, then period."""
    near = np.flatnonzero(length / period >= (length / period).max() * (1 - 1e-12))
    best = near[0]
    for k in near[1:]:
        a, b = int(length[k]) * int(period[best]), int(length[best]) * int(period[k])
        if a > b or (a == b and (start[k], period[k]) < (start[best], period[best])):
            best = k
    return int(best)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _task(times: int, least: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.utf8(batch.column("text"))
            for i, j in X.rounds(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                a, b, of = X.words(part, at)
                letters = np.ascontiguousarray(part[~X.SPACE[part]])
                ends = np.append(0, np.cumsum(b - a))
                words = pa.StringArray.from_buffers(len(a), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters))
                ids = np.asarray(words.dictionary_encode().indices, dtype=np.int64) + 1
                t, start, length, period = find_runs(ids, of, times, least)
                # words covered by a run after its first period
                edge = np.zeros(len(a) + 1, np.int64)
                np.add.at(edge, of[t] + start + period, 1)
                np.add.at(edge, of[t] + start + length, -1)
                stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                kept = pa.ListArray.from_arrays(pa.array(np.searchsorted(stay, of), pa.int32()), words.take(pa.array(stay)))
                bound = np.searchsorted(t, np.arange(j - i + 1))
                runs = pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_RUN)))
                best = [None] * (j - i)
                for d in np.unique(t):
                    k = slice(bound[d], bound[d + 1])
                    s = bound[d] + _strongest(start[k], length[k], period[k])
                    best[d] = {"start": int(start[s]), "length": int(length[s]), "period": int(period[s])}
                out = {"doc_id": batch.column("doc_id").slice(i, j - i), "n_words": pa.array(np.diff(of), pa.int64()), "runs": runs, "best": pa.array(best, _RUN), "collapsed": pc.binary_join(kept, " ")}
                yield pa.RecordBatch.from_pydict(out)

    return task


def periodic_runs(docs: DataFrame, times: int = 4, least: int = 6) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period in words, by start, then period), best (the run of greatest length / period, ties to the smallest
    start, then period; null without runs) and collapsed (the words outside of runs and those of each run's first period, joined by one space).

    Words are parted by space and 0x09 to 0x0D. A null or empty text has no words, no runs and an empty ``collapsed``. Each row is one text: repeated rows and ids, null
    ids and further columns play no part. An empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _task(times, least), "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, best struct<start:bigint,length:bigint,period:bigint>, collapsed string"
    )


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by CRC-32 of the decimal id, the words from one on repeat with a period drawn from the same number; white space there becomes single spaces.

    Rows with a null id or without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g, n = F.floor(h / 10), F.size("w")
    a = (F.col("g") % F.col("n")).cast("int")
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")

    def moved(w: Column, i: Column) -> Column:
        return F.when(i < F.col("a"), w).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")))

    hit = h % 10 == 0
    rows = docs.select("doc_id", "text", F.when(hit, words).alias("w"), g.alias("g"))
    rows = rows.select("*", n.alias("n")).select("*", F.when(F.col("n") > 0, a).alias("a")).select("*", F.when(F.col("n") > 0, p).alias("p"))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.transform("w", moved), " ")).otherwise(F.col("text")).alias("text"))


def op11_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of exponent 4 and more in all documents, whose texts are first given periodic tails by id."""
    found = periodic_runs(with_periodic_tails(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.start.alias("start"), best.length.alias("length"), best.period.alias("period"),
        F.floor(1000 * best.length / best.period).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
