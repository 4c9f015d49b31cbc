"""Language ID by nearest centroid: normalised TF-IDF vectors of hashed byte n-grams, several clustered centroids per language, cosine, rejection.

Document frequencies, final centroids and the distances that set the rejection bounds come from all training rows. Only the start of the clustering uses
a sample, of about ``SEEDS`` rows per language, drawn with a fixed seed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import text as X
from .common import table

DIMS = 8192
GRAMS = (2, 3, 4)
CLUSTERS = 3
#: Rows per language on which the clustering starts.
SEEDS = 150
SEED = 11
ROUNDS = 8
#: More labels than this are no languages; fitting stops with an error.
MOST_LANGUAGES = 400
#: A text is rejected when its cosine, or the margin of that over the mean cosine to all centroids, is under this share of the bound below which
#: ``REJECT_QUANTILE`` of the training rows of like language and length lie. Each training row counts as if its centroid had been made without it.
REJECT_SHARE = 0.9
REJECT_QUANTILE = 0.001
_BINS = 1000
_SIZES = 24
_STEP_ROWS = 128


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, one row per text; A-Z count as a-z."""
    n, out = len(offsets) - 1, None
    low = X.LOWER[data].astype(np.uint32)
    for g in GRAMS:
        if len(low) < g:
            continue
        v = low[: len(low) - g + 1].copy()
        for j in range(1, g):
            v = (v << np.uint32(8)) | low[j : len(low) - g + 1 + j]
        bucket = ((v * np.uint32(2654435761 + 2 * g)) >> np.uint32(32 - 13)).astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(offsets))[: len(v)]
        whole = np.arange(len(v)) + g <= np.repeat(offsets[1:], np.diff(offsets))[: len(v)]
        c = np.bincount((row * DIMS + bucket)[whole], minlength=n * DIMS)
        out = c if out is None else out + c
    return (np.zeros(n * DIMS, np.int64) if out is None else out).reshape(n, DIMS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length one, or zero for texts without n-grams."""
    v = np.log1p(counts.astype(np.float32)) * idf
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, counts and byte lengths, a bounded number of rows at a time."""
    data, offsets = X.utf8(batch.column("text"))
    for a, b in X.rounds(offsets):
        for i in range(a, b, _STEP_ROWS):
            j = min(b, i + _STEP_ROWS)
            yield i, j, grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), np.diff(offsets[i : j + 1])


def _size_class(length: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(length, 1)).astype(np.int64), _SIZES - 1)


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    bounds: np.ndarray  # per centroid, size class and measure (cosine, margin): the least that is accepted


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for i, j, counts, _ in _steps(batch):
            total += (counts > 0).sum(0)
            rows += j - i
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"dim": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(total[at], rows), pa.int64())})


def _seed_vectors(idf: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, counts, _ in _steps(batch):
                v = vectors(counts, idf)
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, j - i), pa.array([x.tobytes() for x in v], pa.binary())], ["lang", "vector"])

    return task


def clustered(v: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from far-apart starts; at most ``k`` centroids of length one."""
    centres = [v[0]]
    for _ in range(1, min(k, len(v))):
        centres.append(v[np.argmin(np.max(v @ np.array(centres).T, 1))])
    c = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(v @ c.T, 1)
        c = np.array([v[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _refined(langs: list[str], centroids: np.ndarray, idf: np.ndarray):
    """One step of the clustering over all training rows: sums per centroid, as (centroid * DIMS + dim, value)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), DIMS), np.float64)
        names = np.array(langs, object)
        for batch in batches:
            own = np.array(batch.column("lang").to_pylist(), object)
            for i, j, counts, _ in _steps(batch):
                v = vectors(counts, idf)
                cos = np.where(own[i:j, None] == names[None, :], v @ centroids.T, -1)
                np.add.at(total, np.argmax(cos, 1), v)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int32()), "value": pa.array(total.ravel()[at])})

    return task


def _measures(cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, and by row the cosine to it and its margin over the mean of all, both 0 to 1."""
    best = np.argmax(cos, 1)
    top = np.clip(cos[np.arange(len(best)), best], 0, 1)
    return best, np.column_stack([top, np.clip(top - cos.mean(1), 0, 1)])


def _closeness(langs: list[str], start: np.ndarray, centroids: np.ndarray, norm: np.ndarray, idf: np.ndarray):
    """Histograms of the training rows' measures by nearest language and size class, as (cell, n).

    ``start`` are the centroids that dealt the rows out, ``norm`` the lengths of the sums. Of a row's own centroid the row itself is taken off."""
    names = np.array(langs, object)
    of = np.unique(names, return_inverse=True)[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((of.max() + 1, _SIZES, 2, _BINS), np.int32)
        for batch in batches:
            label = np.array(batch.column("lang").to_pylist(), object)
            for i, j, counts, length in _steps(batch):
                v = vectors(counts, idf)
                cos = v @ centroids.T
                own = label[i:j, None] == names[None, :]
                row = np.flatnonzero(own.any(1))
                at = np.argmax(np.where(own, v @ start.T, -1), 1)[row]
                s, size = norm[at], (v[row] * v[row]).sum(1)
                left = s * s - 2 * s * cos[row, at] + size
                cos[row, at] = np.where(left > 1e-3, (s * cos[row, at] - size) / np.sqrt(np.maximum(left, 1e-3)), 0)
                best, found = _measures(cos)
                bins = np.minimum((found * _BINS).astype(int), _BINS - 1)
                for m in range(2):
                    np.add.at(total, (of[best], _size_class(length), m, bins[:, m]), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int32()), "n": pa.array(total.ravel()[at], pa.int64())})

    return task


def _bounds(seen: np.ndarray) -> np.ndarray:
    """Bounds by language, size class and measure, from the nearest size classes that have rows enough for the quantile; a language without so many takes all languages' rows."""
    out = np.zeros(seen.shape[:3])
    for g, own in enumerate(seen):
        rows = own if own[:, 0].sum() * REJECT_QUANTILE >= 1 else seen.sum(0)
        for c in range(_SIZES):
            for width in range(_SIZES):
                near = rows[max(0, c - width) : c + width + 1].sum(0)
                if near[0].sum() * REJECT_QUANTILE >= 1:
                    break
            for m in range(2):
                if near[m].any():  # fewer rows than the quantile needs: the least of them says less
                    share = REJECT_SHARE * min(1.0, math.sqrt(near[m].sum() * REJECT_QUANTILE))
                    out[g, c, m] = share * np.searchsorted(np.cumsum(near[m]), REJECT_QUANTILE * near[m].sum(), "right") / _BINS
    return out


def fit(rows: DataFrame, clusters: int = CLUSTERS, seeds: int = SEEDS) -> Model | None:
    """Model of rows (text, lang); null and empty texts and null langs teach nothing. None if there is no row to learn from."""
    rows = rows.select("text", "lang").where("lang IS NOT NULL AND length(text) > 0")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different values of lang")
    if not sizes:
        return None
    df = {r.dim: r.n for r in rows.select("text").mapInArrow(_frequencies, "dim int, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    n = df.pop(-1)
    idf = np.full(DIMS, math.log(1 + n), np.float32)
    for d, f in df.items():
        idf[d] = math.log((1 + n) / (1 + f)) + 0.1
    # About ``seeds`` rows of each language, copies drawn apart; all rows of a language that has no more.
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, seeds / v))]), F.col("lang"))
    drawn = F.rand(SEED) < share
    start: dict[str, list] = {k: [] for k in sizes}
    for r in rows.where(drawn).mapInArrow(_seed_vectors(idf), "lang string, vector binary").collect():
        if len(start[r.lang]) < 4 * seeds:
            start[r.lang].append(np.frombuffer(r.vector, np.float32))
    langs, parts = [], []
    for k in sorted(start):
        if start[k]:
            c = clustered(np.array(sorted(start[k], key=lambda v: v.tobytes())), clusters)
            langs += [k] * len(c)
            parts.append(c)
    if not langs:
        return None
    centroids = np.concatenate(parts).astype(np.float32)
    sums = np.zeros(centroids.size)
    for r in rows.where(F.col("lang").isin(sorted(set(langs)))).mapInArrow(_refined(langs, centroids, idf), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toLocalIterator():
        sums[r.cell] = r.value
    sums = sums.reshape(centroids.shape)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    start_centroids, centroids = centroids, np.where(norm > 0, sums / np.maximum(norm, 1e-12), centroids).astype(np.float32)
    of = np.unique(np.array(langs, object), return_inverse=True)[1]
    seen = np.zeros((of.max() + 1, _SIZES, 2, _BINS), np.int64)
    for r in rows.mapInArrow(_closeness(langs, start_centroids, centroids, norm[:, 0], idf), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        seen.ravel()[r.cell] = r.n
    bounds = _bounds(seen)[of]
    return Model(langs, centroids, idf, bounds)


def _predicted(model: Model, keep: list[str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.langs, object)
        for batch in batches:
            lang, score, far = [], [], []
            for _, _, counts, length in _steps(batch):
                cos = vectors(counts, model.idf) @ model.centroids.T
                best, found = _measures(cos)
                lang += names[best].tolist()
                score += found[:, 0].astype(float).tolist()
                far += ((found[:, 0] == 0) | (found < model.bounds[best, _size_class(length)]).any(1)).tolist()
            cols = [batch.column(c) for c in keep] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "lang_pred", "score", "far"])

    return task


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected.

    Null texts and texts without a letter are ``und`` with score 0 and rejected; so is every text if there is no model. Columns of ``docs`` that have
    these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected", "far")
    if model is None:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string, score double, far boolean"])
    out = docs.mapInArrow(_predicted(model, docs.columns), schema)
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    return out.select(
        *docs.columns,
        F.when(letters, F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(letters, F.col("score")).otherwise(0.0).alias("score"),
        (~letters | F.col("far")).alias("rejected"),
    )


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def op3_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from two thirds of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
