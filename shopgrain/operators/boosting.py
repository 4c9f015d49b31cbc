"""Second-order boosted trees over feature histograms.

Features are cut into bins once. For every tree a level's gradient and hessian sums per (node, feature, bin) are added up in Spark, a level in one job; from these sums, whose number the tree's shape
bounds, the driver picks each node's best cut. A tree sees a random part of the rows and of the features, drawn by hash, so results do not depend on partitions.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.ranks import quantiles
from ..session import materialized


@dataclass(frozen=True)
class BoostingParams:
    """``l2`` shrinks leaf values, ``child_weight`` is the least hessian sum of a child, ``min_gain`` the least gain of a cut (exclusive)."""

    trees: int = 200
    depth: int = 6
    rate: float = 0.1
    row_share: float = 0.8
    feature_share: float = 0.8
    l2: float = 1.0
    child_weight: float = 1.0
    min_gain: float = 0.0
    bins: int = 64
    seed: int = 42
    #: Margins are written to the checkpoint folder after so many trees.
    write_every: int = 25


@dataclass
class Tree:
    """Nodes in order of creation; the children of node i are left[i] and right[i], -1 in a leaf. Rows with bin <= cut go left; rows without a value go left where ``missing_left``."""

    feature: list[int]
    cut: list[int]
    left: list[int]
    right: list[int]
    missing_left: list[bool]
    value: list[float]
    gain: list[float]
    weight: list[float]

    @classmethod
    def stump(cls) -> Tree:
        return cls([-1], [0], [-1], [-1], [True], [0.0], [0.0], [0.0])

    def add(self) -> int:
        for column, v in zip(asdict(self).keys(), (-1, 0, -1, -1, True, 0.0, 0.0, 0.0)):
            getattr(self, column).append(v)
        return len(self.feature) - 1

    def nodes_of(self, binned: np.ndarray) -> np.ndarray:
        """The leaf of every row; bin -1 stands for a missing value."""
        feature, cut, left, right, missing = (np.array(v) for v in (self.feature, self.cut, self.left, self.right, self.missing_left))
        at = np.zeros(len(binned), np.int64)
        rows = np.arange(len(binned))
        for _ in range(len(feature)):
            inner = feature[at] >= 0
            if not inner.any():
                break
            b = binned[rows, np.maximum(feature[at], 0)]
            go_left = np.where(b < 0, missing[at], b <= cut[at])
            at = np.where(inner, np.where(go_left, left[at], right[at]), at)
        return at


def unit(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) per key and salt."""
    with np.errstate(over="ignore"):
        h = key.astype(np.int64).view(np.uint64) ^ np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((h ^ (h >> np.uint64(33))) >> np.uint64(11)) / 2.0**53


def bin_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Cuts of each feature: its distinct exact quantiles at i / bins but the last value; a value goes to the bin of the first cut that is not below it."""
    long = df.select([F.col(c).cast("double").alias(c) for c in features]).unpivot([], features, "feature", "value")
    q = quantiles(long, "value", {f"q{i}": i / bins for i in range(1, bins)}, by=["feature"])
    found = {r["feature"]: sorted({r[f"q{i}"] for i in range(1, bins)}) for r in q.collect()}  # one row a feature
    top = df.agg(*[F.max(F.col(c).cast("double")).alias(c) for c in features]).first()
    return [[v for v in found.get(c, []) if v < top[c]] for c in features]


def binned(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin numbers; -1 where there is no value."""
    out = np.empty(x.shape, np.int16)
    for j, cuts in enumerate(edges):
        out[:, j] = np.searchsorted(np.array(cuts), x[:, j], "left")
        out[np.isnan(x[:, j]), j] = -1
    return out


def gradients(y: np.ndarray, margin: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the logistic loss by the margin."""
    p = 1 / (1 + np.exp(-margin))
    return weight * (p - y), weight * p * (1 - p)


def histogram(b: np.ndarray, node: np.ndarray, nodes: int, width: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """[node, feature, bin + 1, (gradient, hessian)] sums; place 0 holds the rows without a value. Rows with node -1 take no part."""
    out = np.zeros((nodes, b.shape[1], width, 2))
    keep = node >= 0
    b, node, g, h = b[keep], node[keep], g[keep], h[keep]
    for j in range(b.shape[1]):
        cell = node * width + b[:, j] + 1
        for k, v in enumerate((g, h)):
            out[:, j, :, k] = np.bincount(cell, v, nodes * width).reshape(nodes, width)
    return out


def best_cut(hist: np.ndarray, allowed: list[int], p: BoostingParams) -> tuple[float, int, int, bool]:
    """(gain, feature, cut, missing left) of one node's sums; ties to the first feature, then the least cut, then left."""
    best = (p.min_gain, -1, 0, True)
    if not hist[:, :, 1].any():
        return 0.0, -1, 0, True
    score = lambda g, h: np.divide(g * g, h + p.l2)
    for j in allowed:
        g, h = hist[j, :, 0], hist[j, :, 1]
        whole = score(g.sum(), h.sum())
        gl, hl = np.cumsum(g[1:])[:-1], np.cumsum(h[1:])[:-1]
        for left in (True, False) if h[0] > 0 else (True,):
            gg, hh = (gl + g[0], hl + h[0]) if left else (gl, hl)
            gr, hr = g.sum() - gg, h.sum() - hh
            with np.errstate(divide="ignore", invalid="ignore"):  # an empty side without shrinkage is ruled out below
                gain = np.where((hh >= p.child_weight) & (hr >= p.child_weight), (score(gg, hh) + score(gr, hr) - whole) / 2, -np.inf)
            if len(gain) and gain.max() > best[0] + 1e-12:
                best = (float(gain.max()), j, int(gain.argmax()), left)
    return best


def grow(sums, features: int, tree_number: int, p: BoostingParams) -> Tree:
    """One tree. ``sums(tree, open nodes, all features)`` gives the histograms of the open nodes, of the first feature alone where only totals count."""
    rng = np.random.default_rng([p.seed, tree_number])
    allowed = sorted(rng.choice(features, max(1, math.ceil(p.feature_share * features - 1e-9)), replace=False).tolist())
    tree, level = Tree.stump(), [0]
    for depth in range(p.depth + 1):
        hist = sums(tree, level, depth < p.depth)
        after = []
        for k, node in enumerate(level):
            g, h = hist[k, 0, :, 0].sum(), hist[k, 0, :, 1].sum()
            tree.value[node], tree.weight[node] = float(-g / (h + p.l2) * p.rate) if h + p.l2 else 0.0, float(h)
            gain, j, cut, missing_left = best_cut(hist[k], allowed, p) if depth < p.depth else (0.0, -1, 0, True)
            if j < 0:
                continue
            tree.feature[node], tree.cut[node], tree.missing_left[node], tree.gain[node] = j, cut, missing_left, gain
            tree.left[node], tree.right[node] = tree.add(), tree.add()
            after += [tree.left[node], tree.right[node]]
        level = after
        if not level:
            break
    return tree


#: Rows of a block, the unit in which binned rows are kept, and of a task; partial sums that the driver adds up itself: of more tasks' sums executors make fewer first.
BLOCK_ROWS, TASK_ROWS, DIRECT_SUMS = 50_000, 20_000, 64

#: (key, y, w, margin, bins) of some rows.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _to_blocks(edges: list[list[float]]):
    """Pickled blocks of a task's rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []

        def packed() -> pa.RecordBatch:
            key, y, w, b = (np.concatenate(c) for c in zip(*parts))
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps((key, y, w, np.zeros(len(y)), b))], pa.binary()), pa.array([len(y)])], ["block", "n"])

        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(edges))
            parts.append((*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "y", "w")), binned(x, edges)))
            if sum(len(p[0]) for p in parts) >= BLOCK_ROWS:
                yield packed()
        if parts:
            yield packed()

    return task


def _with_tree(tree: Tree):
    """A block with the margins after one more tree."""

    def block(rows: Block) -> Block:
        key, y, w, margin, b = rows
        return key, y, w, margin + np.array(tree.value)[tree.nodes_of(b)], b

    return block


def _drawn(number: int, p: BoostingParams):
    """Bins, gradients and hessians of the rows that a tree sees."""

    def block(rows: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, y, w, margin, b = rows
        take = unit(key, p.seed * 1_000_003 + number) < p.row_share
        return b[take], *gradients(y[take], margin[take], w[take])

    return block


def _level_sums(tree: Tree, level: list[int], features: int, width: int):
    def task(blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        place = np.full(len(tree.feature), -1, np.int64)
        place[level] = np.arange(len(level))
        total = np.zeros((len(level), features, width, 2))
        for b, g, h in blocks:
            total += histogram(b[:, :features], place[tree.nodes_of(b)], len(level), width, g, h)
        yield total

    return task


def fit_boosted(rows: DataFrame, edges: list[list[float]], p: BoostingParams) -> list[Tree]:
    """Trees fitted to ``rows``: key (bigint, the draw of rows hangs on it), y (0 or 1), w (weight) and x (array<double>, one value per list of ``edges``; NaN or null is no value).

    Blocks of rows with their margins are kept from tree to tree, and those of the drawn rows with their gradients from level to level; a level is one job without a shuffle.
    """
    features, width = len(edges), max((len(e) for e in edges), default=0) + 2
    x = F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan"))))
    blocks = rows.select("key", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"), x.alias("x")).mapInArrow(_to_blocks(edges), "block binary, n bigint")
    written = materialized(blocks)
    parts = written.agg(F.greatest(F.ceil(F.sum("n") / F.lit(TASK_ROWS)), F.lit(1))).first()[0] or 1
    kept = [written.rdd.coalesce(parts).map(lambda r: pickle.loads(r.block)).persist(StorageLevel.MEMORY_AND_DISK)]
    depth = 1 if kept[0].getNumPartitions() <= DIRECT_SUMS else 2
    trees: list[Tree] = []
    for number in range(p.trees):
        sample = kept[-1].map(_drawn(number, p)).persist(StorageLevel.MEMORY_AND_DISK)

        def sums(tree: Tree, level: list[int], whole: bool) -> np.ndarray:
            seen = features if whole else 1
            total = sample.mapPartitions(_level_sums(tree, level, seen, width)).treeAggregate(np.zeros((len(level), seen, width, 2)), np.add, np.add, depth)
            return np.round(total, 9)  # sums in any order give the same tree

        trees.append(grow(sums, features, number, p))
        sample.unpersist()
        for old in kept[:-1]:
            old.unpersist()
        kept = kept[-1:]
        if number + 1 < p.trees:
            kept.append(kept[-1].map(_with_tree(trees[-1])).persist(StorageLevel.MEMORY_AND_DISK))
            if (number + 1) % p.write_every == 0:
                kept[-1].checkpoint()
    for old in kept:
        old.unpersist()
    return trees


def tree_table(trees: list[Tree], edges: list[list[float]], features: list[str], spark) -> DataFrame:
    """(tree, path, feature, threshold, gain, weight, value) of every node; ``path`` has an L or R for each step from the root; features and thresholds are null in leaves."""
    rows = []
    for k, t in enumerate(trees):
        paths = {0: ""}
        for n, (j, c, v, g, w) in enumerate(zip(t.feature, t.cut, t.value, t.gain, t.weight)):
            if j >= 0:
                paths |= {t.left[n]: paths[n] + "L", t.right[n]: paths[n] + "R"}
            rows.append((k, paths[n], features[j] if j >= 0 else None, edges[j][c] if j >= 0 else None, g, w, v))
    return spark.createDataFrame(rows, "tree int, path string, feature string, threshold double, gain double, weight double, value double")


class HistogramBoosting(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """``fit_boosted`` as a pipeline stage on a vector column; rows are drawn by the hash of their vector and label, so equal rows are drawn together."""

    settings = Param(Params._dummy(), "settings", "boosting parameters as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", weightCol=None, seed=42, settings="{}"):
        super().__init__()
        self._setDefault(settings="{}", seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> HistogramBoostingModel:
        p = BoostingParams(**{"seed": self.getOrDefault("seed"), **json.loads(self.getOrDefault("settings"))})
        weight = F.col(self.getOrDefault("weightCol")) if self.isSet("weightCol") else F.lit(1.0)
        x = vector_to_array(self.getOrDefault("featuresCol"))
        rows = materialized(dataset.select(x.alias("x"), F.col(self.getOrDefault("labelCol")).cast("double").alias("y"), weight.cast("double").alias("w")))
        d = len(rows.first()["x"])
        columns = [f"x{j}" for j in range(d)]
        edges = bin_edges(rows.select(*[F.col("x")[j].alias(c) for j, c in enumerate(columns)]), columns, p.bins)
        trees = fit_boosted(rows.select(F.xxhash64("x", "y").alias("key"), "y", "w", "x"), edges, p)
        made = HistogramBoostingModel()
        made._set(featuresCol=self.getOrDefault("featuresCol"), trees=json.dumps({"edges": edges, "trees": [asdict(t) for t in trees]}))
        return made


class HistogramBoostingModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` (of labels 0 and 1) and ``prediction``."""

    trees = Param(Params._dummy(), "trees", "cuts and trees as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()

    def _load(self) -> tuple[list[list[float]], list[Tree]]:
        spec = json.loads(self.getOrDefault("trees"))
        return spec["edges"], [Tree(**t) for t in spec["trees"]]

    @property
    def featureImportances(self) -> DenseVector:
        """Gain per feature, as shares."""
        edges, trees = self._load()
        gain = np.zeros(len(edges))
        for t in trees:
            for j, g in zip(t.feature, t.gain):
                if j >= 0:
                    gain[j] += g
        return DenseVector(gain / gain.sum() if gain.sum() else gain)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        packed = self._load()
        column = self.getOrDefault("featuresCol")
        handle = dataset.sparkSession.sparkContext.broadcast(packed)  # bounded by trees * 2 ** depth nodes

        @F.pandas_udf("double")
        def probability(x):
            edges, trees = handle.value
            b = binned(np.array(x.tolist(), float).reshape(len(x), len(edges)), edges)
            margin = np.zeros(len(b))
            for t in trees:
                margin += np.array(t.value)[t.nodes_of(b)]
            return pd.Series(1 / (1 + np.exp(-margin)))

        p = probability(vector_to_array(column))
        return dataset.withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).withColumn("prediction", (F.col("_p") > 0.5).cast("double")).drop("_p")
