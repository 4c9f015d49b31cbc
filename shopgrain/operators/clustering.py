"""K-means segmentation, quality measures, choice of k and stability."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.storagelevel import StorageLevel

from ..config import DEFAULT, Config
from ..functions.expr import one_row, safe_divide
from ..session import checkpointed
from .boosting import unit
from .features import median_fill, scaled_vectors


#: Fits of stability samples that are submitted at the same time; each is a chain of small jobs that leaves most cores idle.
PARALLEL_FITS = 8
#: Rounds in which candidates for the first centres are drawn, points drawn in one, and rounds in which the weighted candidates are moved.
DRAW_ROUNDS, DRAWN, POOL_ROUNDS = 5, 64, 10
TOLERANCE = 1e-4
#: Rows of a block of points, and tasks whose sums the driver adds up itself.
BLOCK_ROWS, DIRECT_SUMS = 16_384, 64


def cluster_vectors(cust: DataFrame, cfg: Config = DEFAULT, method: str = "standard") -> DataFrame:
    """customer_id and the scaled feature vector of every customer."""
    cols = list(cfg.segment.features)
    return scaled_vectors(median_fill(cust.select("customer_id", *cols), cols), cols, method).select("customer_id", "features")


class Centres:
    """Fitted centres: ``transform`` adds the nearest one's number."""

    def __init__(self, points: np.ndarray, cost: float):
        self.points, self.cost = points, cost

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.points)

    def transform(self, vectors: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        centres = F.array(*[F.struct(F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v).alias("d"), F.lit(i).alias("i"))
                            for i, c in enumerate(self.points)])
        return vectors.withColumn("cluster", F.array_min(centres)["i"])


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every centre."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pickled (points, hashes, order) of up to BLOCK_ROWS or some more rows."""
    parts: list[tuple[np.ndarray, ...]] = []

    def packed() -> pa.RecordBatch:
        block = tuple(np.concatenate(c) for c in zip(*parts))
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    for batch in batches:
        if batch.num_rows:
            parts.append((batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1), batch.column("h").to_numpy(), batch.column("o").to_numpy()))
        if sum(len(p[0]) for p in parts) >= BLOCK_ROWS:
            yield packed()
    if parts:
        yield packed()


def _blocks(points: DataFrame, seed: int) -> RDD:
    """Blocks (x, h, o) of the points ``x``: a hash of the coordinates, and that hash's own by the seed. Every round of a fit reads them in one job without a shuffle."""
    keyed = points.select("x", F.xxhash64("x").alias("h")).withColumn("o", F.xxhash64("h", F.lit(seed)))
    return keyed.mapInArrow(_to_blocks, "block binary").rdd.map(lambda r: pickle.loads(r.block)).persist(StorageLevel.MEMORY_AND_DISK)


def _gathered(blocks: RDD, task, join):
    """The tasks' results joined, or None without blocks; executors join first where there are many."""
    found = blocks.mapPartitions(lambda b: [task(b)])
    return found.treeAggregate(None, lambda a, b: join(a, b) if a is not None and b is not None else a if b is None else b,
                               lambda a, b: join(a, b) if a is not None and b is not None else a if b is None else b, 1 if blocks.getNumPartitions() <= DIRECT_SUMS else 2)


def _first(blocks: Iterator[tuple]) -> tuple | None:
    """(order, point) that is least by order, then by coordinates."""
    best = None
    for x, _, o in blocks:
        at = np.flatnonzero(o == o.min())
        best = min((int(o[at[0]]), min(x[at].tolist())), *([best] if best else [(math.inf, [])]))
    return best


def _draw(candidates: np.ndarray, salt: int, take: int):
    """(race, x) of a task's ``take`` winners of a race that a point wins with a chance in proportion to its squared distance to the candidates."""

    def task(blocks: Iterator[tuple]) -> tuple[np.ndarray, np.ndarray]:
        best = np.zeros(0), np.zeros((0, candidates.shape[1]))
        for x, h, _ in blocks:
            far = _nearest(x, candidates).min(1)
            open_ = far > 1e-12 * max(1.0, float((x * x).sum(1).max(initial=0)))
            best = _least(take)(best, (-np.log1p(-unit(h, salt)[open_]) / far[open_], x[open_]))
        return best

    return task


def _least(take: int):
    def join(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        race, x = np.append(a[0], b[0]), np.vstack([a[1], b[1]])
        order = np.argsort(race, kind="stable")[:take]
        return race[order], x[order]

    return join


def _weigh(candidates: np.ndarray):
    def task(blocks: Iterator[tuple]) -> np.ndarray:
        total = np.zeros(len(candidates), np.int64)
        for x, _, _ in blocks:
            total += np.bincount(_nearest(x, candidates).argmin(1), minlength=len(candidates))
        return total

    return task


def candidate_centres(points: DataFrame, seed: int, rounds: int = DRAW_ROUNDS, drawn: int = DRAWN) -> tuple[np.ndarray, np.ndarray]:
    """k-means||: candidates drawn from all points in rounds, far ones more often, and how many points are nearest to each.

    A point's luck in a round hangs on the hash of its coordinates, so files and partitions do not matter. At most 1 + rounds * drawn candidates reach the driver.
    """
    blocks = _blocks(points, seed)
    try:
        return _candidates(blocks, seed, rounds, drawn)
    finally:
        blocks.unpersist()


def _candidates(blocks: RDD, seed: int, rounds: int, drawn: int) -> tuple[np.ndarray, np.ndarray]:
    first = _gathered(blocks, _first, min)
    if first is None:
        raise ValueError("no points to cluster")
    candidates = np.array([first[1]], float)
    for r in range(rounds):
        won = _gathered(blocks, _draw(candidates, seed * 1_000 + r, drawn), _least(drawn))[1]
        if not len(won):  # every point is a candidate
            break
        candidates = np.unique(np.vstack([candidates, won]), axis=0)
    return candidates, _gathered(blocks, _weigh(candidates), np.add).astype(float)


def _start(candidates: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ on the weighted candidates, then some moves of the centres among them."""
    rng = np.random.default_rng(seed)
    out = [candidates[rng.choice(len(candidates), p=weight / weight.sum())]]
    near = ((candidates - out[0]) ** 2).sum(1)
    for _ in range(1, min(k, len(candidates))):
        p = near * weight
        out.append(candidates[rng.choice(len(candidates), p=p / p.sum()) if p.sum() > 0 else rng.integers(len(candidates))])
        near = np.minimum(near, ((candidates - out[-1]) ** 2).sum(1))
    centres = np.array(out)
    for _ in range(POOL_ROUNDS):
        own = _nearest(candidates, centres).argmin(1)
        n = np.bincount(own, weight, len(centres))
        moved = np.column_stack([np.bincount(own, weight * c, len(centres)) for c in candidates.T]) / np.maximum(n, 1e-300)[:, None]
        centres = np.where(n[:, None] > 0, moved, centres)
    return centres


def _sums(fits: dict[int, np.ndarray], dim: int):
    """Per fit an array with number, cost and coordinate sums of a task's points by cluster, for all fits in one reading."""

    def task(blocks: Iterator[tuple]) -> dict[int, np.ndarray]:
        total = {f: np.zeros((len(c), dim + 2)) for f, c in fits.items()}
        for x, _, _ in blocks:
            across, norm = np.ascontiguousarray(x.T), (x * x).sum(1)
            for f, c in fits.items():
                d = (-2 * c) @ across
                d += norm
                d += (c * c).sum(1)[:, None]
                own = d.argmin(0)
                cost = np.maximum(d.min(0), 0)
                mine = (own == np.arange(len(c))[:, None]).astype(float)
                total[f] += np.column_stack([np.bincount(own, minlength=len(c)), mine @ cost, mine @ x])
        return total

    return task


def _added(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    return {f: a[f] + b[f] for f in a}


def kmeans_fits(vectors: DataFrame, wanted: list[tuple[int, int]], max_iter: int) -> list[Centres]:
    """Lloyd's algorithm for many (k, seed) at once: one reading of the points per round serves all fits that still move. Starts are drawn from common candidates, each fit's by its seed."""
    blocks = _blocks(vectors.select(vector_to_array("features").alias("x")), wanted[0][1])
    try:
        candidates, weight = _candidates(blocks, wanted[0][1], DRAW_ROUNDS, max(DRAWN, 4 * max(k for k, _ in wanted)))
        dim = candidates.shape[1]
        centres = {i: _start(candidates, weight, k, seed) for i, (k, seed) in enumerate(wanted)}
        cost, moving = {}, set(centres)
        for step in range(max_iter + 1):
            sums = _gathered(blocks, _sums({i: centres[i] for i in moving}, dim), _added)  # fits times clusters rows
            cost |= {i: float(sums[i][:, 1].sum()) for i in moving}
            if step == max_iter:
                break
            new = {i: np.where(sums[i][:, :1] > 0, sums[i][:, 2:] / np.maximum(sums[i][:, :1], 1), centres[i]) for i in moving}
            still = {i for i in moving if ((new[i] - centres[i]) ** 2).sum(1).max() > TOLERANCE**2}
            centres |= {i: new[i] for i in still}
            moving = still
            if not moving:
                break
    finally:
        blocks.unpersist()
    return [Centres(centres[i], cost[i]) for i in range(len(wanted))]


def best_kmeans(vectors: DataFrame, k: int, cfg: Config = DEFAULT, restarts: int | None = None, seed: int | None = None) -> Centres:
    """The fit with the lowest cost out of several seeded starts."""
    return _best(vectors, [k], cfg, restarts, seed)[0]


def _best(vectors: DataFrame, ks: Iterable[int], cfg: Config, restarts: int | None, seed: int | None = None) -> list[Centres]:
    s = cfg.segment
    first = s.seed if seed is None else seed
    tries = s.restarts if restarts is None else restarts
    wanted = [(k, first + i) for k in ks for i in range(tries)]
    cached = vectors.is_cached
    vectors = vectors if cached else vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fits = kmeans_fits(vectors, wanted, s.max_iter)
    finally:
        if not cached:
            vectors.unpersist()
    return [min(fits[i : i + tries], key=lambda m: m.cost) for i in range(0, len(fits), tries)]


def assign_clusters(vectors: DataFrame, model) -> DataFrame:
    return model.transform(vectors).select("customer_id", "cluster", "features")


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """Size and share per cluster and how uneven the sizes are (largest over smallest)."""
    g = labels.groupBy("cluster").agg(F.count("*").alias("customers"))
    w = Window.partitionBy(F.lit(1))  # k rows
    return g.withColumn("pct", F.col("customers") * 100.0 / F.sum("customers").over(w)).withColumn(
        "imbalance", F.max("customers").over(w) / F.min("customers").over(w))


def cluster_centers(model, names: list[str], spark) -> DataFrame:
    rows = [(i, n, float(v)) for i, c in enumerate(model.clusterCenters()) for n, v in zip(names, c)]
    return spark.createDataFrame(rows, "cluster int, feature string, center double")


def _per_cluster(labels: DataFrame) -> DataFrame:
    """Per cluster: size, coordinate sums and the sum of squared norms, from one aggregate."""
    x = labels.select("cluster", vector_to_array("features").alias("x"))
    d = len(x.first()["x"])
    return x.groupBy("cluster").agg(
        F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(d)]).alias("s"),
        F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("q"),
    )


def separation(labels: DataFrame) -> dict[str, float]:
    """Davies-Bouldin and Calinski-Harabasz. Only k rows of sums reach the driver."""
    rows = _per_cluster(labels).collect()
    k, n = len(rows), sum(r["n"] for r in rows)
    dim = len(rows[0]["s"])
    cent = {r["cluster"]: [v / r["n"] for v in r["s"]] for r in rows}
    grand = [sum(r["s"][i] for r in rows) / n for i in range(dim)]
    dist2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    within = sum(r["q"] - r["n"] * sum(v * v for v in cent[r["cluster"]]) for r in rows)
    between = sum(r["n"] * dist2(cent[r["cluster"]], grand) for r in rows)
    # Mean distance to the centre needs the points; one more aggregate with the centres as literals.
    table = F.create_map(*[e for c, v in cent.items() for e in (F.lit(c), F.array(*[F.lit(float(z)) for z in v]))])
    x = labels.select("cluster", vector_to_array("features").alias("x"))
    gap = F.sqrt(F.aggregate(F.zip_with("x", table[F.col("cluster")], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v))
    spread = {r[0]: r[1] for r in x.groupBy("cluster").agg(F.avg(gap)).collect()}
    db = 0.0
    for i in cent:
        ratios = [(spread[i] + spread[j]) / math.sqrt(dist2(cent[i], cent[j])) for j in cent if j != i and dist2(cent[i], cent[j]) > 0]
        db += max(ratios, default=0.0)
    ch = (between / (k - 1)) / (within / (n - k)) if k > 1 and within > 0 else float("nan")
    return {"davies_bouldin": db / k, "calinski_harabasz": ch, "inertia": within}


def k_sweep(vectors: DataFrame, cfg: Config = DEFAULT, restarts: int | None = None) -> DataFrame:
    """Inertia, silhouette, Davies-Bouldin and Calinski-Harabasz for every k."""
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    try:
        for k, best in zip(cfg.segment.k_values, _best(vectors, cfg.segment.k_values, cfg, restarts)):
            lab = best.transform(vectors)
            s = separation(lab)
            sil = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(lab)
            rows.append((k, s["inertia"], sil, s["davies_bouldin"], s["calinski_harabasz"]))
    finally:
        vectors.unpersist()
    return vectors.sparkSession.createDataFrame(
        rows, "k int, inertia double, silhouette double, davies_bouldin double, calinski_harabasz double")


def elbow(sweep: DataFrame) -> DataFrame:
    """k with the largest distance to the chord of the normalised inertia curve (one row per k)."""
    e = one_row(sweep.agg(
        F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("inertia").alias("i0"), F.max("inertia").alias("i1"),
        F.min_by("inertia", "k").alias("first"), F.max_by("inertia", "k").alias("last")))
    d = sweep.withColumn("_e", e)
    c = F.col
    x = safe_divide(c("k") - c("_e.k0"), c("_e.k1") - c("_e.k0"), 0.0)
    norm = lambda v: safe_divide(v - c("_e.i0"), c("_e.i1") - c("_e.i0"), 0.0)
    slope = norm(c("_e.last")) - norm(c("_e.first"))
    gap = F.abs(norm(c("inertia")) - norm(c("_e.first")) - slope * x) / F.sqrt(1 + slope * slope)
    return d.select("k", gap.alias("distance")).orderBy(F.desc("distance"), "k").limit(1)


def choose_k(sweep: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Four votes (silhouette, Davies-Bouldin, Calinski-Harabasz, elbow); ties go to the larger k.

    A result of 2 becomes max(4, elbow); the result is kept within the configured range.
    """
    s = cfg.segment
    votes = sweep.agg(
        F.max_by("k", "silhouette").alias("silhouette"), F.min_by("k", "davies_bouldin").alias("davies_bouldin"),
        F.max_by("k", "calinski_harabasz").alias("calinski_harabasz"),
    ).withColumn("elbow", elbow(sweep).select("k").scalar())
    names = ["silhouette", "davies_bouldin", "calinski_harabasz", "elbow"]
    long = votes.unpivot([], names, "measure", "k").groupBy("k").agg(F.count("*").alias("votes"))
    top = long.orderBy(F.desc("votes"), F.desc("k")).limit(1).select("k").scalar()
    out = votes.withColumn("winner", top)
    raised = F.when(F.col("winner") == 2, F.greatest(F.lit(s.fallback_k), F.col("elbow"))).otherwise(F.col("winner"))
    return out.withColumn("k", F.least(F.greatest(raised, F.lit(s.min_k)), F.lit(s.max_k)))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency counts."""
    cells = checkpointed(pairs.groupBy(a, b).agg(F.count("*").cast("double").alias("n")))  # read three times; the pairs are read once
    two = lambda c: c * (c - 1) / 2
    g = cells.agg(F.sum(two(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    ra = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("v")).scalar()
    rb = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("v")).scalar()
    g = g.withColumn("_a", ra).withColumn("_b", rb)
    expected = F.col("_a") * F.col("_b") / two(F.col("n"))
    return g.select(F.coalesce(F.try_divide(F.col("ij") - expected, (F.col("_a") + F.col("_b")) / 2 - expected), F.lit(1.0)).alias("ari"))


def stability(vectors: DataFrame, k: int, cfg: Config = DEFAULT, iterations: int | None = None, restarts: int = 1) -> DataFrame:
    """ARI of refits on seeded samples with replacement against the reference labels, per iteration."""
    s = cfg.segment
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ref = best_kmeans(vectors, k, cfg, restarts)
        base = ref.transform(vectors).select("features", F.col("cluster").alias("ref")).persist(StorageLevel.MEMORY_AND_DISK)

        def refit(i: int) -> tuple[int, float]:
            boot = base.sample(True, s.stability_fraction, s.seed + i).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                m = best_kmeans(boot, k, cfg, restarts, seed=s.seed + i)
                return i, adjusted_rand(m.transform(boot), "ref", "cluster").first()[0]
            finally:
                boot.unpersist()

        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            rows = list(pool.map(refit, range(s.stability_iterations if iterations is None else iterations)))
        base.unpersist()
    finally:
        vectors.unpersist()
    return vectors.sparkSession.createDataFrame(rows, "iteration int, ari double")


def silhouette_by_cluster(labels: DataFrame) -> DataFrame:
    """Mean squared-Euclidean silhouette per cluster, in closed form from the k cluster sums.

    For each point the mean squared distance to a cluster is |x|^2 - 2 x.m + q, so no pair of points
    is formed; the k centres travel as a literal.
    """
    stats = _per_cluster(labels).collect()  # k rows
    items = F.array(*[
        F.struct(F.lit(r["cluster"]).alias("c"), F.lit(float(r["n"])).alias("n"),
                 F.array(*[F.lit(v / r["n"]) for v in r["s"]]).alias("m"), F.lit(r["q"] / r["n"]).alias("q"))
        for r in stats
    ])
    x = labels.select("cluster", vector_to_array("features").alias("x")).withColumn("_k", items)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    x = x.withColumn("_xx", dot(F.col("x"), F.col("x")))
    x = x.withColumn("_d", F.transform("_k", lambda k: F.struct(
        k["c"].alias("c"), k["n"].alias("n"), (F.col("_xx") - 2 * dot(F.col("x"), k["m"]) + k["q"]).alias("d"))))
    own = F.filter("_d", lambda e: e["c"] == F.col("cluster"))[0]
    a = own["d"] * own["n"] / F.greatest(own["n"] - 1, F.lit(1.0))
    b = F.array_min(F.transform(F.filter("_d", lambda e: e["c"] != F.col("cluster")), lambda e: e["d"]))
    sil = F.when(own["n"] <= 1, 0.0).otherwise(safe_divide(b - a, F.greatest(a, b), 0.0))
    return x.select("cluster", sil.alias("s")).groupBy("cluster").agg(F.count("*").alias("customers"), F.avg("s").alias("silhouette"))
