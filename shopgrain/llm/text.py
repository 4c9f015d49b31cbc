"""Vectorised text helpers used inside tasks: UTF-8 buffers, words, prefix-sum hashes and minimizer runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that part words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one round of array work takes; a longer document is a round of its own.
ROUND_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]] if len(at) else whole[:0], at - (at[0] if len(at) else 0)


def rounds(offsets: np.ndarray, limit: int = ROUND_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(lane: int) -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64) + np.uint64(0x1234567 + 977 * lane)) | np.uint64(1)


TABLES = [_table(0), _table(1)]


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n; kept up to the usual round size."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.empty(max(n, ROUND_BYTES + 4096), np.uint64)
        have[0] = 1
        filled = 1
        while filled < len(have):
            step = min(filled, len(have) - filled)
            have[filled : filled + step] = have[:step] * np.uint64(int(have[filled - 1]) * int(base) % (1 << 64))
            filled += step
        if len(have) <= 4 * ROUND_BYTES:
            _powers[int(base)] = have
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * base ** i before each position (n + 1 of them)."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed Rabin-Karp hash of every span, the same wherever the span lies; lengths enter the hash."""
    n = len(prefix)
    raw = (prefix[end] - prefix[start]) * powers(_INVERSE, n)[start]
    return mix(raw ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def fixed_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of every span of ``k`` values."""
    if len(prefix) <= k:
        return np.zeros(0, np.uint64)
    return mix((prefix[k:] - prefix[:-k]) * powers(_INVERSE, len(prefix))[: len(prefix) - k])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and offsets of the rows' words; no word crosses a row."""
    space = SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = ~space[inner]
    last = ~space
    if len(data):
        last[:-1] &= space[1:]
    cut = inner[inner > 0] - 1
    last[cut] = ~space[cut]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(values: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive windows that have the same minimizer.

    ``values`` are one number per unit, ``offsets`` bound the rows. A window's minimizer is the least hash of its k-grams, so equal windows have
    equal minimizers wherever they occur. Returns row, start, number of windows and minimizer of each run.
    """
    least = sliding_min(fixed_hash(prefix_hash(values), k), window - k + 1)
    n = len(least)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    valid = np.zeros(n + 1, np.int32)  # windows that end inside their row
    lo, hi = offsets[:-1], np.maximum(offsets[1:] - window + 1, offsets[:-1])
    np.add.at(valid, np.minimum(lo, n), 1)
    np.add.at(valid, np.minimum(hi, n), -1)
    valid = np.cumsum(valid[:-1]) > 0
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    row_start = lo[(hi > lo) & (lo < n)]
    new[row_start] = valid[row_start]
    start = np.flatnonzero(new)
    row = np.searchsorted(offsets, start, "right") - 1
    stop = np.append(start[1:], n)
    stop = np.minimum(stop, hi[row])
    return row, start, stop - start, least[start]
