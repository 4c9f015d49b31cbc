"""Near-duplicate documents: a chosen-path similarity join on word shingles, links confirmed on the full sets, connected components.

Equal sets are one node of the join from the start, so groups of copies cost one row. Every tree sends each set down the paths named by its
minwise tokens: the root branches on one coordinate per tree, and nodes that stay large branch again, ``branches`` times, by ``PATH`` further steps. Trees are independent,
so a pair of similarity s is met with probability 1 - (1 - s) ** TREES at the roots, and with b branches of p steps at l levels with
1 - (1 - s * (1 - (1 - s ** p) ** b) ** l) ** TREES.

Inside a node the sets are first compared with the node's smallest set; what these links join needs no further comparison. Large nodes
that still hold several components are then compared with their medoid, the set nearest to the most frequent value of each coordinate, which for near copies of one
text is that text. Only nodes that even so hold several components are compared further: those of up to ``LEAF`` sets exhaustively, larger ones after branching. A set y and a star of the pivot, sets that agree with it on
e coordinates, are kept apart where y agrees with the pivot on fewer than e + m - COORDINATES, m being the coordinates a pair must agree on: no such pair can. Nodes that
branching does not split are compared exhaustively too, in blocks: the sets outside the node's main component against all, so no pair of different components is left out.

Pairs never become rows here: a node hands on bundles, the sets that its pairs of enough equal coordinates join, and a task that holds a bundle's texts counts all its intersections and
keeps one row per set, which names what the links join it with. So a group of up to ``LEAF`` sets costs a row per set and tree, and its square only inside a task. Beyond that a set also has a row
per branch, and per block of a node or bundle that has to be cut; the blocks' number grows with the square of what is left together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import text as X
from .common import id_back, keyed, materialized, table
from .components import components

SHINGLE = 5
#: Links have PERCENT * union <= 100 * intersection.
PERCENT = 85
COORDINATES = 64
TREES = 10
#: Coordinates that name a child of a large node, and levels of children; how many children a set has follows from the similarity asked for.
PATH = 3
LEVELS = 3
#: A pair at the threshold is missed below large nodes with at most this probability, or twice that of being missed by all roots.
MISSED = 1e-5
#: Equal coordinates with the pivot from which a set of its component counts as one of its star.
STAR = 48
#: Sets in a node whose minwise values are compared exhaustively in one go.
LEAF = 4096
#: Sets of a large node, about, that its medoid is found by; nodes of no more have none.
DRAWN = 32
#: Hashes, and sets, about, in a part of a bundle; full sets are compared two parts at a time.
PART = 1 << 20
PART_SETS = 1024
#: Hashes in many sets of a block that are compared in one go.
COLUMNS = 1024
#: Standard deviations below the expected number of equal coordinates at the threshold down to which a pair is confirmed on its full sets.
SLACK = 5.0

_MULTIPLIERS = X.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_ADDENDS = X.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def least_equal(percent: int) -> int:
    p = percent / 100
    return int(np.floor(COORDINATES * p - SLACK * np.sqrt(COORDINATES * p * (1 - p))))


def branches(percent: int, trees: int = TREES) -> int:
    """Fewest children of each set at which pairs at the threshold are missed with no more than the probability allowed by ``MISSED``."""
    s, b = percent / 100, 1
    while (1 - s * (1 - (1 - s**PATH) ** b) ** LEVELS) ** trees > max(MISSED, 2 * (1 - s) ** trees):
        b += 1
    return b


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each row's k-word shingles; with fewer words the whole sequence is one, without words none."""
    low = X.LOWER[data]
    start, end, of = X.words(low, offsets)
    prefix = X.prefix_hash(X.span_hash(X.prefix_hash(X.TABLES[0][low]), start, end))
    out = []
    first = np.arange(max(len(start) - k + 1, 0))
    h = X.span_hash(prefix, first, first + k)
    for a, b in zip(of[:-1], of[1:]):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            out.append(X.span_hash(prefix, np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(did, th, n, s1, s2, mh): size, two-lane hash and minwise values of each document's set."""
    for batch in batches:
        data, offsets = X.utf8(batch.column("text"))
        for i, j in X.rounds(offsets):
            sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            mh = np.zeros((j - i, COORDINATES), np.uint32)
            s = np.zeros((2, j - i), np.uint64)
            if len(full):
                flat = np.concatenate([sets[r] for r in full])
                at = np.append(0, np.cumsum(n[full])[:-1])
                s[0, full] = np.add.reduceat(flat, at)
                s[1, full] = np.add.reduceat(X.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
                for c in range(COORDINATES):
                    mh[full, c] = np.minimum.reduceat(flat * _MULTIPLIERS[c] + _ADDENDS[c], at) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("did").slice(i, j - i), batch.column("th").slice(i, j - i), pa.array(n, pa.int64()), pa.array(s[0].view(np.int64)), pa.array(s[1].view(np.int64)), pa.array([m.tobytes() for m in mh], pa.binary())],
                ["did", "th", "n", "s1", "s2", "mh"],
            )


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _signature(mh: np.ndarray) -> pa.Array:
    return pa.array([s.tobytes() for s in mh.astype(np.uint8)], pa.binary())


def _roots(trees: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mh, sid = _matrix(batch.column("mh"), np.uint32, COORDINATES), batch.column("sid")
            sig = _signature(mh)
            for t in range(trees):
                node = X.mix(mh[:, t].astype(np.uint64) | np.uint64((t + 1) << 32))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), sid, sig], ["node", "sid", "sig"])

    return task


def _branches(level: int, count: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mh = _matrix(batch.column("mh"), np.uint32, COORDINATES)
            node = batch.column("node").to_numpy().view(np.uint64)
            sig, every = _signature(mh), np.arange(len(mh))
            for b in range(count):
                child = node
                for step in range(PATH):
                    at = X.mix(node + np.uint64(977 * level + 31 * b + step)) % np.uint64(COORDINATES)  # the node chooses its coordinates
                    child = X.mix(child ^ X.mix(mh[every, at.astype(np.int64)].astype(np.uint64) | ((at + np.uint64(1)) << np.uint64(32))))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("sid"), sig, batch.column("comp")], ["node", "sid", "sig", "comp"])

    return task


def _parted(least: int):
    """Rows of large nodes as two nodes: all but the pivot's star, and the star with what is near enough to the pivot to be linked to it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(c), np.uint8, COORDINATES) for c in ("pivot_sig", "sig"))
            equal = (a == b).sum(1)
            own = batch.column("comp").to_numpy() == batch.column("pivot_comp").to_numpy()
            star = own & (equal >= STAR)
            near = star | (~own & (equal >= STAR + least - COORDINATES))
            node = batch.column("node").to_numpy().view(np.uint64)
            for salt, take in ((1, ~star), (2, near)):
                at = pa.array(np.flatnonzero(take))
                child = pa.array(X.mix(node + np.uint64(salt))[take].view(np.int64))
                yield pa.RecordBatch.from_arrays([child, *[batch.column(c).take(at) for c in ("sid", "sig", "comp")]], ["node", "sid", "sig", "comp"])

    return task


def _with_pivot(least: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(c), np.uint8, COORDINATES) for c in ("pivot_sig", "sig"))
            near = pa.array((a == b).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("pivot").filter(near), batch.column("sid").filter(near)], ["a", "b"])

    return task


def _modes(t: pa.Table) -> pa.Table:
    """The most frequent value of each coordinate among a node's drawn sets."""
    sig = _matrix(t.column("sig").combine_chunks(), np.uint8, COORDINATES)
    mode = np.array([np.bincount(c, minlength=256).argmax() for c in sig.T], np.uint8)
    return pa.table({"node": t.column("node").slice(0, 1), "mode": pa.array([mode.tobytes()], pa.binary())})


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (_matrix(batch.column(c), np.uint8, COORDINATES) for c in ("mode", "sig"))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array((a == b).sum(1).astype(np.int32)), *[batch.column(c) for c in ("sid", "sig", "comp")]], ["node", "equal", "sid", "sig", "comp"])


def _medoids(rows: DataFrame, some: int) -> DataFrame:
    """(node, pivot, pivot_sig, pivot_comp): the set of each large node that agrees most with the modes of about ``some`` of its sets."""
    drawn = rows.where(F.pmod(F.xxhash64("sid"), F.ceil(F.col("size") / some)) == 0)
    modes = drawn.select("node", "sig").groupBy("node").applyInArrow(_modes, "node bigint, mode binary")
    votes = rows.select("node", "sid", "sig", "comp").join(modes, "node").select("node", "sid", "sig", "comp", "mode").mapInArrow(_agreement, "node bigint, equal int, sid bigint, sig binary, comp bigint")
    best = votes.groupBy("node").agg(F.max(F.struct("equal", "sid", "sig", "comp")).alias("best"))
    return best.select("node", F.col("best.sid").alias("pivot"), F.col("best.sig").alias("pivot_sig"), F.col("best.comp").alias("pivot_comp"))


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of rows with one key, and the borders of the runs; the rows come sorted by it."""
    carry: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
        value = t.column(key).to_numpy()
        cut = np.append(0, np.flatnonzero(value[1:] != value[:-1]) + 1)
        if len(cut) > 1:
            yield t.slice(0, cut[-1]).combine_chunks(), cut
        carry = t.slice(cut[-1])
    if carry is not None:
        yield carry.combine_chunks(), np.array([0, len(carry)])


def _joined(linked: np.ndarray) -> np.ndarray:
    """The first row that each row of a symmetric matrix of links reaches."""
    label = np.arange(len(linked), dtype=np.int32)
    while True:
        low = np.minimum(label, np.where(linked, label, np.int32(len(label))).min(1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _bundled(least: int):
    """Bundles of the sets of a node that pairs of different components with enough equal coordinates join; the rows come sorted by node.

    A bundle is named by its sets, so the same one met in several trees is one. Rows grow with the sets, not with the pairs.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in _whole(batches, "node"):
            sid, comp = (t.column(c).to_numpy() for c in ("sid", "comp"))
            sig = _matrix(t.column("sig").combine_chunks(), np.uint8, COORDINATES)
            name = X.mix(sid.view(np.uint64) + np.uint64(1))
            two = cut[:-1][np.diff(cut) == 2]
            two = two[((sig[two] == sig[two + 1]).sum(1) >= least) & (comp[two] != comp[two + 1])]
            bundles, sids = [name[two] + name[two + 1]] * 2, [sid[two], sid[two + 1]]
            for x, y in zip(cut[:-1], cut[1:]):
                if y - x < 3:
                    continue
                near = np.zeros((y - x, y - x), bool)
                for i in range(x, y - 1):
                    near[i - x, i - x + 1 :] = ((sig[i + 1 : y] == sig[i]).sum(1) >= least) & (comp[i + 1 : y] != comp[i])
                near |= near.T
                some = np.flatnonzero(near.any(1))
                if len(some):
                    label = _joined(near[np.ix_(some, some)])
                    total = np.zeros(len(some), np.uint64)
                    np.add.at(total, label, name[x + some])
                    bundles.append(total[label])
                    sids.append(sid[x + some])
            yield pa.RecordBatch.from_arrays([pa.array(X.mix(np.concatenate(bundles)).view(np.int64)), pa.array(np.concatenate(sids))], ["bundle", "sid"])

    return task


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, right above the diagonal: hashes in many sets by matrix products, those in few one pair of places after the other."""
    n = len(sets)
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.append(True, flat[1:] != flat[:-1])
    first, number = np.flatnonzero(new), np.cumsum(new) - 1
    times = np.diff(np.append(first, len(flat)))
    out = np.zeros((n, n), np.float32)
    many = np.flatnonzero((times > 1) & (times >= n / 16))
    for part in np.split(many, range(COLUMNS, len(many), COLUMNS)):
        column = np.full(len(times), -1)
        column[part] = np.arange(len(part))
        at = np.flatnonzero(column[number] >= 0)
        m = np.zeros((n, len(part)), np.float32)
        m[row[at], column[number[at]]] = 1
        out += m @ m.T
    few = np.flatnonzero(((times > 1) & (times < n / 16))[number])
    number, row = number[few], row[few]
    at, lag = np.arange(len(few)), 1
    while len(at := at[at + lag < len(few)]) and len(at := at[number[at + lag] == number[at]]):
        np.add.at(out, (row[at], row[at + lag]), np.float32(1))  # the sort is stable, so the first row is the smaller one
        lag += 1
    return out


def _linked(percent: int):
    """One pair for each set of a block that its links join with a smaller one: links of full shingle sets, of which only who reaches whom is kept."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in _whole(batches, "block"):
            sid = t.column("sid").to_numpy()
            data, offsets = X.utf8(t.column("text"))
            left, right = [], []
            for g, h in X.rounds(offsets[cut]):
                x, y = cut[g], cut[h]
                sets = [s for i, j in X.rounds(offsets[x : y + 1]) for s in shingle_sets(data[offsets[x + i] : offsets[x + j]], offsets[x + i : x + j + 1] - offsets[x + i])]
                for a, b in zip(cut[g:h] - x, cut[g + 1 : h + 1] - x):
                    size, both = np.array([len(s) for s in sets[a:b]]), shared(sets[a:b])
                    good = np.zeros(both.shape, bool)
                    for i, common in enumerate(both):
                        common = common[i + 1 :].astype(np.int64)
                        good[i, i + 1 :] = 100 * common >= percent * (size[i] + size[i + 1 :] - common)
                    label = _joined(good | good.T)
                    left.append(sid[x + a + label])
                    right.append(sid[x + a : x + b])
            l, r = np.concatenate(left), np.concatenate(right)
            l, r = l[l != r], r[l != r]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(l, r)), pa.array(np.maximum(l, r))], ["a", "b"])

    return task


def _confirmed(percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            sides = [X.utf8(batch.column(c)) for c in ("text_a", "text_b")]
            for i, j in X.rounds(sides[0][1] + sides[1][1]):
                sets = [shingle_sets(d[o[i] : o[j]], o[i : j + 1] - o[i]) for d, o in sides]
                for r, (a, b) in enumerate(zip(*sets)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    good[i + r] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], ["a", "b"])

    return task


def _texts(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, text) of the sets ``wanted``."""
    wanted = sets.select("sid", "did", "th").join(wanted.select("sid").distinct(), "sid")
    # Equal rows have equal keys; one of them is enough. The grouping uses the join's partitioning and order.
    texts = docs.join(wanted, ["did", "th"]).groupBy("did", "th").agg(F.first("sid").alias("sid"), F.first("text").alias("text"))
    return materialized(texts.select("sid", "text"))


def _confirm(docs: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. ``pairs`` hold each pair once."""
    texts = _texts(docs, sets, pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))))
    with_b = pairs.join(texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b")), "b")
    full = with_b.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), "a")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(percent), "a bigint, b bigint")


def _connected(docs: DataFrame, sets: DataFrame, bundles: DataFrame, percent: int) -> DataFrame:
    """Pairs that join what links join within each bundle. One with many hashes or sets is cut in parts, every two of which meet in a block of their own."""
    rows = bundles.join(sets.select("sid", "n"), "sid")
    rows = rows.join(rows.groupBy("bundle").agg(F.ceil(F.greatest(F.sum("n") / PART, F.count("*") / PART_SETS / 2)).alias("parts")), "bundle")
    rows = rows.withColumn("p", F.pmod(F.xxhash64("sid"), "parts")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    rows = rows.where("p <> q OR parts = 1").select(F.xxhash64("bundle", F.least("p", "q"), F.greatest("p", "q")).alias("block"), "sid")
    rows = rows.join(_texts(docs, sets, bundles), "sid").select("block", "sid", "text")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(_linked(percent), "a bigint, b bigint")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with comp, the component so far: that of ``labels``, or the set itself."""
    return rows.join(labels.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component")


def _open(rows: DataFrame) -> DataFrame:
    """Rows of nodes that hold more than one component, with the node's size and pivot."""
    nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("sid", "sig", "comp")).alias("pivot")).where("lo < hi")
    return rows.join(nodes.select("node", "size", F.col("pivot.sig").alias("pivot_sig"), F.col("pivot.comp").alias("pivot_comp")), "node")


def _blocks(rows: DataFrame, leaf: int) -> DataFrame:
    """Large nodes as blocks of about 2 * leaf rows that bring every set outside the main component together with every set of the node."""
    counts = rows.groupBy("node", "comp").agg(F.count("*").alias("n"))
    main = counts.groupBy("node").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
    main = main.select("node", F.col("top.comp").alias("main"), F.ceil(F.col("all") / leaf).alias("ja"), F.ceil((F.col("all") - F.col("top.n")) / leaf).alias("jr"))
    rows = rows.join(main, "node")
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    every = rows.withColumn("x", F.pmod(F.xxhash64("sid"), F.col("ja"))).withColumn("y", to(F.col("jr")))
    rest = rows.where("comp <> main").withColumn("y", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("jr"))).withColumn("x", to(F.col("ja")))
    cols = [F.xxhash64("node", "x", "y").alias("node"), "sid", "sig", "comp"]
    return every.select(*cols).unionByName(rest.select(*cols)).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """Per row of ``docs``: did, th, n_shingles, component (the smallest did that links reach) and grp, which names the group of linked sets.

    Rows that share an id can be in several groups; then these have one component, but each its own grp, which is null for an empty set. Null and empty texts, and texts without a word, have an empty set and are linked with nothing. Rows with equal sets are one group. Rows
    with a null doc_id have the largest did. An empty table gives no rows.
    """
    docs = keyed(docs)
    sketches = materialized(docs.mapInArrow(_sketch, "did bigint, th bigint, n bigint, s1 bigint, s2 bigint, mh binary"))
    sets = sketches.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("did", "th")).alias("key"), F.first("mh").alias("mh"))
    sets = materialized(sets.select("s1", "s2", "n", "key.did", "key.th", "mh").withColumn("sid", F.monotonically_increasing_id()))

    least = least_equal(percent)
    rows = sets.select("sid", "mh").mapInArrow(_roots(trees), "node bigint, sid bigint, sig binary")
    nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min(F.struct("sid", "sig")).alias("pivot")).where("size > 1")
    rows = materialized(rows.join(nodes.select("node", F.col("pivot.sid").alias("pivot"), F.col("pivot.sig").alias("pivot_sig")), "node"))
    stars = materialized(rows.where("sid <> pivot").select("pivot", "sid", "pivot_sig", "sig").mapInArrow(_with_pivot(least), "a bigint, b bigint").distinct())
    links = materialized(_confirm(docs, sets, stars, percent))
    labels = components(links)

    row = "node bigint, sid bigint, sig binary, comp bigint"
    open_rows = materialized(_open(_labelled(rows.select("node", "sid", "sig"), labels)))
    large = open_rows.where(F.col("size") > min(leaf, DRAWN)).select("node", "sid", "sig", "comp", "size")
    if not large.isEmpty():
        around = large.join(_medoids(large, DRAWN), "node").where("comp <> pivot_comp").select("pivot", "sid", "pivot_sig", "sig")
        around = around.mapInArrow(_with_pivot(least), "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        around = materialized(around.join(stars, ["a", "b"], "left_anti"))
        links = materialized(links.unionByName(_confirm(docs, sets, around, percent)))
        labels = components(links)
        open_rows = materialized(_open(_labelled(rows.select("node", "sid", "sig"), labels)))
    leaves = []
    for level in range(LEVELS):
        leaves.append(open_rows.where(F.col("size") <= leaf))
        large = open_rows.where(F.col("size") > leaf)
        if large.isEmpty():
            break
        apart = materialized(_open(large.mapInArrow(_parted(least), row)))
        leaves.append(apart.where(F.col("size") <= leaf))
        large = apart.where(F.col("size") > leaf)
        children = large.select("node", "sid", "comp").join(sets.select("sid", "mh"), "sid").mapInArrow(_branches(level, branches(percent, trees)), row)
        open_rows = materialized(_open(children))
    leaves.append(open_rows.where(F.col("size") <= leaf))
    large = open_rows.where(F.col("size") > leaf)
    parts = [r.select("node", "sid", "sig", "comp") for r in leaves] + [_blocks(large, max(1, leaf // 2))]
    met = parts[0]
    for p in parts[1:]:
        met = met.unionByName(p)
    bundles = materialized(met.repartition("node").sortWithinPartitions("node").mapInArrow(_bundled(least), "bundle bigint, sid bigint").distinct())
    if not bundles.isEmpty():
        links = links.unionByName(_connected(docs, sets, bundles, percent))
        labels = components(links)

    own = _labelled(sets.select("sid", "s1", "s2", "n", "did"), labels)
    lowest = own.groupBy("comp").agg(F.min("did").alias("component"))
    by_set = own.join(lowest, "comp").select("s1", "s2", "n", "component", F.col("comp").alias("grp"))
    return sketches.join(by_set, ["s1", "s2", "n"], "left").select("did", "th", F.col("n").alias("n_shingles"), F.coalesce("component", "did").alias("component"), "grp")


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at a similarity of 0.85."""
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    doc_id, component = id_back(F.col("did")), id_back(F.col("component"))
    return out.select(doc_id.alias("doc_id"), "n_shingles", component.alias("component_id"), doc_id.eqNullSafe(component).alias("kept"))
