"""Exact order statistics that never sort a whole column in one task.

``value_ranks`` reduces the input to its distinct values with counts (map-side combined), cuts the value
axis into ranges at literal boundaries, and adds up counts range by range. Every window below
runs inside one range; the only window over a whole group runs over the range totals, whose
number is bounded by the number of boundaries.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from ..session import checkpointed

ROWS_PER_RANGE = 50_000
#: Accuracy of the sketch that brackets asked-for positions: it is off by a share of 1 / ACCURACY of a group's rows at most, and brackets reach MARGIN times as far.
ACCURACY, MARGIN = 10_000, 8
#: Groups whose brackets are sent to all tasks; more are joined by shuffle.
SENT_GROUPS = 10_000


def _boundaries(counts: DataFrame, value: str) -> list[float]:
    """Cut points that split the distinct values evenly: one number per ROWS_PER_RANGE distinct values reaches the driver.

    The cuts only decide how work is spread. They become literals of the plan, so a retried task
    sees the same ranges; the ranks are exact whatever the cuts are.
    """
    ranges = counts.count() // ROWS_PER_RANGE + 1
    if ranges == 1:
        return []
    probs = [i / ranges for i in range(1, ranges)]
    return sorted(set(counts.agg(F.percentile_approx(value, F.lit(probs), F.lit(max(10_000, 10 * ranges)))).first()[0]))


def _cut(counts: DataFrame, value: str, cuts: list[float]) -> DataFrame:
    ranged = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=value, outputCol="_range").transform(counts)
    return ranged.withColumn("_range", F.col("_range").cast("int"))


def by_range(counts: DataFrame, value: str) -> DataFrame:
    """``counts`` with _range, the number of the range of about ROWS_PER_RANGE rows that the value lies in; equal values share one, larger ones are in no lower one."""
    cuts = _boundaries(counts, value)
    return _cut(counts, value, cuts) if cuts else counts.withColumn("_range", F.lit(0))


def _ranged_counts(df: DataFrame, value: str, by: list[str], weight: str | None, sums: list[str]):
    """Distinct values with counts and range number, and per range its totals and what lies before it.

    Up to ROWS_PER_RANGE distinct values there is one range, and None in place of the totals.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = checkpointed(
        df.where(F.col(value).isNotNull())
        .select(*by, F.col(value).cast("double").alias(value), *([weight] if weight else []), *[c for c in sums if c != weight])
        .groupBy(*by, value)
        .agg(n.cast("bigint").alias("n"), *[F.sum(c).alias(c) for c in sums])
    )
    cuts = _boundaries(counts, value)
    if not cuts:
        return counts, None
    ranged = _cut(counts, value, cuts)
    measures = ["n", *sums]
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(m).alias(f"_sum_{m}") for m in measures])
    across = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    totals = totals.select(
        *by, "_range", F.col("_sum_n"),
        *[F.coalesce(F.sum(f"_sum_{m}").over(across), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(f"_sum_{m}").over(whole).alias("total" if m == "n" else f"{m}_total") for m in measures],
    )
    return ranged, totals


def _rank(ranged: DataFrame, totals: DataFrame | None, value: str, by: list[str], sums: list[str]) -> DataFrame:
    if totals is None:
        group = Window.partitionBy(*(by or [F.lit(0)]))
        below = group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        cum = {m: F.coalesce(F.sum(m).over(below), F.lit(0)) for m in ["n", *sums]}
        return ranged.select(
            *by, value, "n", cum["n"].alias("before"), F.sum("n").over(group).alias("total"),
            *[c for m in sums for c in (F.col(m), cum[m].alias(f"{m}_before"), F.sum(m).over(group).alias(f"{m}_total"))],
        )
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(totals, [*by, "_range"])
    before = {m: F.col(f"_off_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in ["n", *sums]}
    return joined.select(
        *by, value, "n", before["n"].alias("before"), "total",
        *[c for m in sums for c in (F.col(m), before[m].alias(f"{m}_before"), F.col(f"{m}_total"))],
    )


def value_ranks(
    df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None, sums: Sequence[str] = ()
) -> DataFrame:
    """Distinct values of ``value`` with tie counts and ranks.

    Returns ``by..., value, n, before, total``: ``n`` rows hold the value, ``before`` rows hold a
    smaller one, ``total`` rows have any value (per group when ``by`` is given). Nulls are left
    out. The value column comes back as DOUBLE. ``weight`` names a count column of an input that
    is already grouped. For each column in ``sums`` the result also has its sum at the value, and
    ``<column>_before`` and ``<column>_total``.
    """
    by, sums = list(by), list(sums)
    ranged, totals = _ranged_counts(df, value, by, weight, sums)
    return _rank(ranged, totals, value, by, sums)


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "avg_rank") -> DataFrame:
    """One row per distinct value with its average (mid) rank."""
    r = value_ranks(df, value, by)
    return r.withColumn(name, F.col("before") + (F.col("n") + 1) / F.lit(2.0))


def _collapsed(df: DataFrame, value: str, probs: Sequence[float], by: list[str]) -> DataFrame:
    """(by..., value, n) with few rows, in which the rows at all positions in question have the values and ranks that they have in ``df``.

    A sketch brackets every position. Values inside a bracket stay, with their counts; all values between two brackets become one row that carries their number and
    the largest of them. Groups of at most ACCURACY rows stay as they are.
    """
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias(value))
    reach = MARGIN / ACCURACY
    ps = sorted(set(float(p) for p in probs))
    sketch = lambda q: F.percentile_approx(value, F.array(*[F.lit(min(1.0, max(0.0, p + q * reach))) for p in ps]), F.lit(ACCURACY))
    cuts = checkpointed(d.groupBy(*by).agg(sketch(-1).alias("_lo"), sketch(1).alias("_hi"), F.count(F.lit(1)).alias("_rows")))
    if by:
        keys = cuts.select(*[F.col(c).alias(f"_key_{c}") for c in by], "_lo", "_hi", "_rows")
        if cuts.count() <= SENT_GROUPS:
            keys = F.broadcast(keys)
        d = d.join(keys, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in by]))
    else:
        row = cuts.first()
        floats = lambda v: F.array(*[F.lit(float(x)) for x in v or []]).cast("array<double>")
        d = d.withColumns({"_lo": floats(row["_lo"]), "_hi": floats(row["_hi"]), "_rows": F.lit(row["_rows"])})
    v = F.col(value)
    # one comparison per position: lambdas over the arrays are not compiled
    ends = [(F.get("_lo", F.lit(i)), F.get("_hi", F.lit(i))) for i in range(len(ps))]
    inside = reduce(lambda x, y: x | y, [(v >= lo) & (v <= hi) for lo, hi in ends], F.col("_rows") <= ACCURACY)
    below = sum(((v > hi).cast("int") for _, hi in ends), F.lit(0))
    return d.groupBy(*by, below.alias("_below"), F.when(inside, v).alias("_inside")).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias(value)).select(*by, value, "n")


def quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles; one row per group, one column per entry of ``probs``.

    Two readings of the rows, and next to nothing written: a sketch brackets the positions, a count between the brackets gives the ranks, and only values inside brackets are
    ranked. With ``weight`` the input is already grouped and is ranked as it is.
    """
    by = list(by)
    if weight is None:
        df, weight = _collapsed(df, value, list(probs.values()), by), "n"
    ranged, totals = _ranged_counts(df, value, by, weight, [])
    if totals is None:
        return quantiles_of_ranks(_rank(ranged, None, value, by, []), value, probs, by)
    ends = [f((F.col("total") - 1) * F.lit(float(p))) for p in probs.values() for f in (F.floor, F.ceil)]
    hit = reduce(lambda a, b: a | b, [(F.col("_off_n") <= e) & (e < F.col("_off_n") + F.col("_sum_n")) for e in ends])
    return quantiles_of_ranks(_rank(ranged, totals.where(hit), value, by, []), value, probs, by)


def quantiles_of_ranks(r: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    def at(pos):
        hit = (F.col("before") <= pos) & (pos < F.col("before") + F.col("n"))
        return F.max(F.when(hit, F.col(value)))

    aggs = []
    for name, p in probs.items():
        pos = (F.col("total") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [at(lo).alias(f"_lo_{name}"), at(hi).alias(f"_hi_{name}"), F.max(pos - lo).alias(f"_w_{name}")]
    out = r.groupBy(*by).agg(*aggs)
    return out.select(
        *by,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in probs
        ],
    )


def top_share(df: DataFrame, value: str, fraction: float) -> DataFrame:
    """Sum of the floor(fraction * N) largest values (at least one), N counting null rows too."""
    size = df.agg(F.greatest(F.floor(F.count(F.lit(1)) * fraction), F.lit(1)).alias("top_n"))
    r = value_ranks(df, value)
    top_n = size.select("top_n").scalar()
    above = F.col("total") - F.col("before") - F.col("n")
    taken = F.greatest(F.least(top_n - above, F.col("n")), F.lit(0))
    units = F.rint(F.col(value) * 10_000.0).cast("bigint").cast("decimal(18,0)")
    return r.agg(
        F.max(top_n).alias("top_n"),
        (F.sum(units * taken.cast("decimal(12,0)")).cast("double") / 10_000.0).alias("top_value"),
        (F.sum(units * F.col("n").cast("decimal(12,0)")).cast("double") / 10_000.0).alias("total_value"),
    )
