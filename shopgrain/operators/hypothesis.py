"""Hypothesis tests as distributed aggregates.

Rank tests start from counts per (value, group): the rows are reduced to distinct values before
anything is ranked. Every function returns one small row per test; p-values are computed on those.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.dist import p_chi2, p_f, p_normal, p_t
from ..functions.expr import count_if, ladder, one_row, safe_divide, to_rows
from ..functions.ranks import average_ranks, by_range, quantiles, value_ranks
from ..session import checkpointed, materialized


def rank_sums(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: n and its exact average-rank sum; per test: N, tie term sum(t^3 - t), groups."""
    by = list(by)
    counts = checkpointed(
        df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias(value), group)
        .agg(F.count("*").alias("m"))
    )
    ranks = value_ranks(counts, value, by, weight="m")
    ties = ranks.groupBy(*by).agg(
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"), F.max("total").alias("total_n")
    )
    double_rank = (2 * F.col("before") + F.col("n") + 1).cast("decimal(19,0)") * F.col("m").cast("decimal(18,0)")
    sums = counts.join(ranks.select(*by, value, "n", "before"), [*by, value]).groupBy(*by, group).agg(
        F.sum("m").alias("n"), (F.sum(double_rank).cast("double") / 2).alias("rank_sum")
    )
    if by:
        return sums.join(ties, by)
    return sums.withColumn("_t", one_row(ties)).select(group, "n", "rank_sum", "_t.ties", "_t.total_n")


def kruskal_wallis(df: DataFrame, value: str, group: str, by: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """H with tie correction, epsilon squared and its band."""
    r = rank_sums(df, value, group, by)
    n = F.col("n_observations").cast("double")
    out = r.groupBy(*by).agg(
        F.count("*").alias("groups"), F.max("total_n").alias("n_observations"), F.max("ties").alias("_t"),
        F.sum(F.pow("rank_sum", F.lit(2.0)) / F.col("n")).alias("_s"),
    )
    h = (12.0 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)) / (1 - F.col("_t") / (F.pow(n, 3) - n))
    out = out.withColumn("statistic", h)
    eps = F.try_divide(F.col("statistic") - F.col("groups") + 1, n - F.col("groups"))
    out = out.withColumn("effect_size", eps).withColumn(
        "effect_strength", F.when(F.col("effect_size") > 0.14, "large").when(F.col("effect_size") > 0.06, "medium").otherwise("small")
    )
    if p_value:
        out = out.withColumn("p_value", p_chi2(F.col("statistic"), F.col("groups") - 1))
    return out.drop("_t", "_s")


def mann_whitney(df: DataFrame, value: str, flag: str, by: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """U of the rows with flag = 1 against flag = 0; normal tail with tie and continuity correction."""
    r = rank_sums(df, value, flag, by)
    one = F.col(flag).cast("int") == 1
    out = r.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(one, F.col("n"))), F.lit(0)).alias("n_1"),
        F.coalesce(F.sum(F.when(~one, F.col("n"))), F.lit(0)).alias("n_0"),
        F.max(F.when(one, F.col("rank_sum"))).alias("_r"), F.max("ties").alias("_t"),
    )
    n1, n0 = F.col("n_1").cast("double"), F.col("n_0").cast("double")
    n = n1 + n0
    out = out.withColumn("u_statistic", F.col("_r") - n1 * (n1 + 1) / 2)
    out = out.withColumn("rank_biserial", 1 - safe_divide(2 * F.col("u_statistic"), n1 * n0))
    sd = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - safe_divide(F.col("_t"), n * (n - 1), 0.0)))
    out = out.withColumn("z", safe_divide(F.abs(F.col("u_statistic") - n1 * n0 / 2) - 0.5, sd))
    if p_value:
        out = out.withColumn("p_value", F.least(p_normal(F.greatest("z", F.lit(0.0))), F.lit(1.0)))
    return out.drop("_r", "_t")


def median_contrast(df: DataFrame, value: str, flag: str) -> DataFrame:
    """Medians of the two groups, their difference and relative difference."""
    q = quantiles(df, value, {"m": 0.5}, by=[flag])
    one = F.col(flag).cast("int") == 1
    out = q.agg(F.max(F.when(one, F.col("m"))).alias("median_1"), F.max(F.when(~one, F.col("m"))).alias("median_0"))
    out = out.withColumn("difference", F.col("median_1") - F.col("median_0"))
    return out.withColumn("pct_difference", F.when(F.col("median_0") > 0, F.col("difference") / F.col("median_0") * 100).otherwise(0.0))


def _within_range(t: pa.Table) -> pa.Table:
    """(x, y, x_over_y, y_over_x, shared): for every two labels that meet in a range of values, twice the wins of each over the other's rows, ties as halves, and
    what their shared values add to the tie terms of both. Rows of one block give its pairs, rows of two blocks the pairs between them.
    """
    t = t.combine_chunks()
    label = t.column("label").combine_chunks().dictionary_encode()
    _, value = np.unique(t.column("value").to_numpy(), return_inverse=True)
    code = label.indices.to_numpy()
    order = np.lexsort((value, code))
    code, value, m, own = code[order], value[order], t.column("m").to_numpy()[order], t.column("own").to_numpy()[order]
    start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    rows = np.add.reduceat(m, start)
    m = m if 2.0 * float(m.sum()) ** 2 < 2.0**62 else m.astype(object)  # exact whatever the counts
    apart = t.column("i")[0] != t.column("j")[0]
    cols = [[], [], [], [], []]
    for x in range(len(start) - 1):
        to = start[x + 1]
        upto = np.append(m[:1] * 0, np.cumsum(m[start[x] : to]))
        below, same = (upto[np.searchsorted(value[start[x] : to], value[to:], side)] for side in ("left", "right"))
        same = same - below
        cut = start[x + 1 :] - to
        over = np.add.reduceat(m[to:] * (2 * below + same), cut)
        mine = m[to:].astype(float)
        shared = np.add.reduceat(3 * mine * same.astype(float) * (mine + same.astype(float)), cut)
        for k in range(len(cut)):
            if not apart or own[start[x]] != own[to + cut[k]]:
                y = x + 1 + k
                for c, v in zip(cols, (x, y, 2 * int(rows[x]) * int(rows[y]) - int(over[k]), int(over[k]), float(shared[k]))):
                    c.append(v)
    x, y = (label.dictionary.take(pa.array(c, pa.int64())) for c in cols[:2])
    wins = [pa.array([Decimal(v) for v in c], pa.decimal128(38, 0)) for c in cols[2:4]]
    return pa.table([x, y, *wins, pa.array(cols[4], pa.float64())], ["x", "y", "x_over_y", "y_over_x", "shared"])


def pairwise_mann_whitney(df: DataFrame, value: str, group: str, alpha: float = 0.05, block: int = 1_000) -> DataFrame:
    """Rank test for every pair of labels with the Bonferroni-adjusted significance.

    The U of labels a and b counts the pairs of rows in which a's value is larger. Rows are counted per (label, value) and dealt into ranges of values once, whatever
    the number of labels up to ``block``: pairs of different ranges follow from the ranges' totals, pairs of one range are counted in its group.
    """
    counts = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("label"), F.col(value).cast("double").alias("value")).agg(F.count("*").alias("m"))
    counts = materialized(counts)
    labels = checkpointed(counts.select("label").distinct())
    pairs = label_pairs(labels, ["label"]).select(F.col("a.label").alias("group_a"), F.col("b.label").alias("group_b"), "pairs")
    blocks = -(-labels.count() // block) or 1
    counts = counts.where(F.col("value").isNotNull())
    ranged = by_range(counts, "value")

    # by label: rows, and the tie term of its values alone
    m = F.col("m").cast("double")
    single = checkpointed(counts.groupBy("label").agg(F.sum("m").alias("n"), F.sum(F.pow(m, F.lit(3.0)) - m).alias("t")))
    # pairs of rows in different ranges
    totals = checkpointed(ranged.groupBy("_range", "label").agg(F.sum("m").alias("m")))
    sides = pairs.select("group_a", "group_b", F.explode(F.array(F.struct(F.col("group_a").alias("label"), F.lit(1).alias("is_a")), F.struct(F.col("group_b").alias("label"), F.lit(0).alias("is_a")))).alias("s"))
    lower = Window.partitionBy("group_a", "group_b").orderBy("_range").rangeBetween(Window.unboundedPreceding, -1)
    spread = totals.join(sides.select("group_a", "group_b", "s.*"), "label").withColumn("below", F.sum(F.when(F.col("is_a") == 0, F.col("m"))).over(lower))
    twice = 2 * F.col("m").cast("decimal(18,0)") * F.coalesce("below", F.lit(0)).cast("decimal(18,0)")
    across = spread.where("is_a = 1").groupBy("group_a", "group_b").agg(F.sum(twice).alias("across"))
    # pairs of rows in one range
    own = F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int")
    met = ranged.select("_range", "label", "value", "m", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    met = met.select("_range", "label", "value", "m", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    kind = counts.schema["label"].dataType.simpleString()
    within = met.groupBy("_range", "i", "j").applyInArrow(_within_range, f"x {kind}, y {kind}, x_over_y decimal(38,0), y_over_x decimal(38,0), shared double")
    within = within.select(
        F.least("x", "y").alias("group_a"), F.greatest("x", "y").alias("group_b"), F.when(F.col("x") < F.col("y"), F.col("x_over_y")).otherwise(F.col("y_over_x")).alias("w"), "shared"
    ).groupBy("group_a", "group_b").agg(F.sum("w").alias("within"), F.sum("shared").alias("shared"))

    by = ["group_a", "group_b"]
    side = lambda p: single.select(F.col("label").alias(f"group_{p}"), F.col("n").alias(f"n_{p}"), F.col("t").alias(f"t_{p}"))
    out = pairs.join(side("a"), "group_a", "left").join(side("b"), "group_b", "left").where("n_a IS NOT NULL OR n_b IS NOT NULL")
    out = out.join(across, by, "left").join(within, by, "left")
    wins = (F.coalesce("across", F.lit(0)) + F.coalesce("within", F.lit(0))).cast("double") / 2
    n1, n0 = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = n1 + n0
    out = out.withColumn("u_statistic", F.when(F.col("n_a").isNotNull(), wins))
    sd = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - (F.col("t_a") + F.col("t_b") + F.coalesce("shared", F.lit(0.0))) / (n * (n - 1))))
    z = (F.abs(F.col("u_statistic") - n1 * n0 / 2) - 0.5) / sd
    out = out.withColumn("p_value", p_normal(F.greatest(z, F.lit(0.0))))
    out = out.withColumn("significant", F.col("p_value") < alpha / F.greatest(F.col("pairs"), F.lit(1)))
    return out.select("group_a", "group_b", "n_a", "n_b", "u_statistic", "p_value", "significant")


def spearman(df: DataFrame, x: str, y: str, p_value: bool = True) -> DataFrame:
    """Rank correlation of two columns with the t-tail p-value and strength label.

    Both rank tables are keyed by distinct value; the rank moments come from counts of (x, y) pairs.
    """
    pairs = checkpointed(
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .agg(F.count("*").alias("m"))
    )
    rx = value_ranks(pairs, "_x", weight="m").select("_x", (2 * F.col("before") + F.col("n") + 1).alias("rx"))
    ry = value_ranks(pairs, "_y", weight="m").select("_y", (2 * F.col("before") + F.col("n") + 1).alias("ry"))
    j = pairs.join(rx, "_x").join(ry, "_y")
    m, a, b = F.col("m").cast("double"), F.col("rx") / 2.0, F.col("ry") / 2.0
    mom = j.agg(
        F.sum("m").alias("n"), F.sum(m * a * b).alias("ab"), F.sum(m * a * a).alias("aa"), F.sum(m * b * b).alias("bb")
    )
    n = F.col("n").cast("double")
    mean2 = F.pow((n + 1) / 2, 2) * n
    out = mom.select("n", safe_divide(F.col("ab") - mean2, F.sqrt((F.col("aa") - mean2) * (F.col("bb") - mean2))).alias("rho"))
    out = out.withColumn("strength", F.when(F.abs("rho") > 0.7, "strong").when(F.abs("rho") > 0.4, "moderate").otherwise("weak"))
    out = out.withColumn("direction", F.when(F.col("rho") > 0, "increasing").otherwise("decreasing"))
    if p_value:
        t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.pow("rho", F.lit(2.0))))
        out = out.withColumn("p_value", p_t(t, F.col("n") - 2))
    return out


def group_moments(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by, group).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"),
    )


def anova_of_moments(m: DataFrame, by: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """F statistic and eta squared from per-group count, mean and variance."""
    n, mean = F.col("n").cast("double"), F.col("mean")
    agg = m.groupBy(*by).agg(
        F.count("*").alias("groups"), F.sum("n").alias("n_observations"), F.sum(n * mean).alias("_s"),
        F.sum(n * mean * mean).alias("_ss"), F.sum((n - 1) * F.coalesce("var", F.lit(0.0))).alias("ss_within"),
    )
    between = F.col("_ss") - F.col("_s") * F.col("_s") / F.col("n_observations")
    out = agg.withColumn("ss_between", between)
    d1, d2 = F.col("groups") - 1, F.col("n_observations") - F.col("groups")
    out = out.withColumn("statistic", safe_divide(F.col("ss_between") / d1, F.col("ss_within") / d2))
    out = out.withColumn("eta_squared", safe_divide(F.col("ss_between"), F.col("ss_between") + F.col("ss_within"), 0.0))
    if p_value:
        out = out.withColumn("p_value", p_f(F.col("statistic"), d1, d2))
    return out.drop("_s", "_ss")


def anova(df: DataFrame, value: str, group: str, by: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    return anova_of_moments(group_moments(df, value, group, by), by, p_value)


def cohens_d(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """Standardised mean difference of two labels with the pooled standard deviation."""
    m = group_moments(df.where(F.col(group).isin(a, b)), value, group)
    pick = lambda lab, c: F.max(F.when(F.col(group) == lab, F.col(c)))
    w = m.agg(*[pick(l, c).alias(f"{c}_{s}") for l, s in ((a, "a"), (b, "b")) for c in ("n", "mean", "var")])
    pooled = F.sqrt(
        ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2)
    )
    return w.withColumn("cohens_d", safe_divide(F.col("mean_a") - F.col("mean_b"), pooled, 0.0))


def levene(df: DataFrame, value: str, group: str, by: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """Median-centred Levene test: ANOVA on absolute deviations from exact group medians.

    Works on counts per (group, value), so the deviations are weighted, not repeated.
    """
    by = list(by)
    keys = [*by, group]
    counts = checkpointed(
        df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias(value)).agg(F.count("*").alias("m"))
    )
    med = quantiles(counts, value, {"med": 0.5}, by=keys, weight="m")
    dev = counts.join(med, keys).withColumn("d", F.abs(F.col(value) - F.col("med")))
    m, d = F.col("m").cast("double"), F.col("d")
    per = dev.groupBy(*keys).agg(F.sum("m").alias("n"), (F.sum(m * d) / F.sum("m")).alias("mean"), F.sum(m * d * d).alias("_dd"))
    n = F.col("n").cast("double")
    per = per.withColumn("var", safe_divide(F.col("_dd") - n * F.col("mean") * F.col("mean"), n - 1))
    out = anova_of_moments(per.select(*keys, "n", "mean", "var"), by, p_value)
    return out.select(
        *by, F.col("statistic").alias("w_statistic"), "groups", "n_observations", *(["p_value"] if p_value else [])
    )


#: Labels of one block; a task pairs two blocks.
LABEL_BLOCK = 128


def label_pairs(rows: DataFrame, columns: Sequence[str], block: int = LABEL_BLOCK) -> DataFrame:
    """Every pair of label rows as structs ``a`` and ``b`` (a before b in column order), and the number of ``pairs``.

    For tables with one row per label. Labels are dealt into blocks by hash; every two blocks meet in a group of their own, so a label is copied once per block and not once per
    label, no group has more than about two blocks, and no join of the table with itself is planned.
    """
    rows = checkpointed(rows.select(*columns))
    n = rows.count()
    blocks = -(-n // block) or 1
    own = F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int")
    copies = rows.select(F.struct(*columns).alias("r"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    met = copies.select("r", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    # a number of tasks of its own: what comes in is small, what comes out is not
    met = met.repartition(min(blocks * (blocks + 1) // 2, 1_000), "i", "j").groupBy("i", "j").agg(F.sort_array(F.collect_list(F.struct("r", "own"))).alias("l"))
    ordered = lambda x, y: F.when(x["r"] < y["r"], F.struct(x["r"].alias("a"), y["r"].alias("b"))).otherwise(F.struct(y["r"].alias("a"), x["r"].alias("b")))
    inside = F.flatten(F.transform("l", lambda x, k: F.transform(F.slice("l", k + 2, F.size("l")), lambda y: ordered(x, y))))
    across = F.flatten(F.transform(F.filter("l", lambda e: e["own"] == F.col("i")), lambda x: F.transform(F.filter("l", lambda e: e["own"] == F.col("j")), lambda y: ordered(x, y))))
    out = met.select(F.explode(F.when(F.col("i") == F.col("j"), inside).otherwise(across)).alias("p"))
    return out.select("p.a", "p.b", F.lit(n * (n - 1) // 2).cast("bigint").alias("pairs"))


def dunn(df: DataFrame, value: str, group: str, p_value: bool = True) -> DataFrame:
    """Dunn's z for every pair of labels, Bonferroni-adjusted."""
    r = rank_sums(df, value, group).withColumn("r", F.col("rank_sum") / F.col("n")).withColumnRenamed(group, "label")
    j = label_pairs(r, ["label", "n", "r", "ties", "total_n"])
    n = F.col("a.total_n").cast("double")
    var = (n * (n + 1) / 12 - F.col("a.ties") / (12 * (n - 1))) * (1 / F.col("a.n") + 1 / F.col("b.n"))
    out = j.select(F.col("a.label").alias("group_a"), F.col("b.label").alias("group_b"), (F.abs(F.col("a.r") - F.col("b.r")) / F.sqrt(var)).alias("z"), "pairs")
    return (out.withColumn("p_value", _bonferroni(F.col("z"), F.col("pairs"))) if p_value else out).drop("pairs")


def _bonferroni(z, pairs):
    """Two-sided normal tail times the number of pairs, at most 1."""
    return F.least(p_normal(z) * pairs, F.lit(1.0))


def chi_square(df: DataFrame, a: str, b: str, yates: bool = False, p_value: bool = True) -> DataFrame:
    """Independence of two label columns, with Cramer's V and its band."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    cells = checkpointed(cells)
    rows = cells.groupBy(a).agg(F.sum("n").alias("_ra"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("_rb"))
    tot = cells.agg(F.sum("n").alias("t")).scalar()
    shape = cells.agg(F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"))
    # sum over cells of (O - E)^2 / E = N * (sum O^2 / (R * C) - 1): empty cells need no row.
    j = cells.join(rows, a).join(cols, b)
    stat = j.agg(
        F.sum(F.col("n") * (F.col("n") / (F.col("_ra") * F.col("_rb").cast("double")))).alias("_q"),
        F.sum("n").alias("n_observations"),
    ).withColumn("_s", one_row(shape))
    out = stat.select(
        "n_observations", (F.col("n_observations") * (F.col("_q") - 1)).alias("chi2"),
        ((F.col("_s.ka") - 1) * (F.col("_s.kb") - 1)).alias("dof"), F.least("_s.ka", "_s.kb").alias("_k"),
    )
    if yates:
        adj = j.withColumn("_e", F.col("_ra") * F.col("_rb").cast("double") / tot)
        c = adj.agg(F.sum(F.pow(F.greatest(F.abs(F.col("n") - F.col("_e")) - 0.5, F.lit(0.0)), 2) / F.col("_e")).alias("c")).scalar()
        out = out.withColumn("chi2", F.when(F.col("dof") == 1, c).otherwise(F.col("chi2")))
    v = F.sqrt(safe_divide(F.col("chi2"), F.col("n_observations") * (F.col("_k") - 1)))
    out = out.withColumn("cramers_v", v).withColumn("association", cramers_v_band(F.col("cramers_v")))
    if p_value:
        out = out.withColumn("p_value", p_chi2(F.col("chi2"), F.col("dof")))
    return out.drop("_k")


def correlation_pairs(df: DataFrame, columns: Sequence[str], threshold: float | None = None) -> DataFrame:
    """Pearson r of every column pair over rows where both are present, by decreasing |r|."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    out = to_rows(wide, [[F.lit(a), F.lit(b), F.col(f"r{i}")] for i, (a, b) in enumerate(pairs)], ["column_a", "column_b", "r"])
    out = out.withColumn("strength", correlation_band(F.col("r")))
    if threshold is not None:
        out = out.where(F.abs("r") > threshold)
    return out.orderBy(F.abs("r").desc(), "column_a", "column_b")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same correlations as a full square table in long form."""
    half = correlation_pairs(df, columns).select("column_a", "column_b", "r")
    flip = half.select(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "r")
    diag = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "column_a string, column_b string, r double")
    return half.unionByName(flip).unionByName(diag)


def distribution_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, std, population skewness and kurtosis, exact quartiles and P90, with labels."""
    cols = list(columns)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column_name", "value")
    m = long.groupBy("column_name").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = quantiles(long, "value", {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}, by=["column_name"])
    out = m.join(q, "column_name")
    return out.withColumns({
        "skew_strength": skew_strength(F.col("skewness")), "skew_direction": skew_direction(F.col("skewness")),
        "concentration": concentration(F.col("median"), F.col("min"), F.col("max")),
        "symmetry": symmetry(F.col("q25"), F.col("median"), F.col("q75"), F.col("min"), F.col("max")),
    })


def distribution_insight_flags(profile: DataFrame) -> DataFrame:
    """Rule rows (column_name, rule_id, fired, metric) on the profile of the four customer measures."""
    c = F.col
    right = (c("skew_direction") == "right")
    heavy = right & c("skew_strength").isin("strong", "extreme")
    ratio = lambda a: F.try_divide(c(a), F.when(c("median") > 0, c("median")))
    rules = [
        ("recency_days", "many_inactive", right & c("skew_strength").isin("moderate", "strong", "extreme"), c("skewness")),
        ("recency_days", "mostly_recent", c("skew_direction") == "left", c("skewness")),
        ("recency_days", "mean_above_median", ratio("mean") > 1.2, ratio("mean")),
        ("recency_days", "mean_below_median", ratio("mean") < 0.8, ratio("mean")),
        ("recency_days", "quarter_beyond_120_days", c("q75") > 120, c("q75")),
        ("frequency", "moderate_concentration", c("skew_strength") == "moderate", c("skewness")),
        ("frequency", "strong_concentration", (c("skew_strength") != "moderate") & heavy, c("skewness")),
        ("frequency", "quarter_with_5_orders", c("q75") >= 5, c("q75")),
        ("frequency", "quarter_with_3_orders", (c("q75") >= 3) & (c("q75") < 5), c("q75")),
        ("frequency", "quarter_with_2_or_fewer", c("q25") <= 2, c("q25")),
        ("monetary", "revenue_concentrated", heavy, c("skewness")),
        ("monetary", "mean_over_3_medians", ratio("mean") > 3, ratio("mean")),
        ("monetary", "top_decile_over_5_medians", ratio("q90") > 5, ratio("q90")),
        ("monetary", "top_quarter_over_2_medians", ratio("q75") > 2, ratio("q75")),
        ("loyalty_score", "strong_core", c("q75") >= 0.7, c("q75")),
        ("loyalty_score", "weak_bottom", c("q25") <= 0.3, c("q25")),
        ("loyalty_score", "weak_baseline", c("median") < 0.4, c("median")),
        ("loyalty_score", "moderate_baseline", (c("median") >= 0.4) & (c("median") < 0.6), c("median")),
        ("loyalty_score", "strong_baseline", c("median") >= 0.6, c("median")),
        ("loyalty_score", "balanced", F.abs(c("skewness")) < 0.5, c("skewness")),
    ]
    items = [F.when(c("column_name") == col, F.struct(F.lit(rule).alias("rule_id"), F.coalesce(f, F.lit(False)).alias("fired"), m.cast("double").alias("metric"))) for col, rule, f, m in rules]
    return profile.select("column_name", F.explode(F.array_compact(F.array(*items))).alias("r")).select("column_name", "r.*")


def jarque_bera(df: DataFrame, columns: Sequence[str], p_value: bool = True) -> DataFrame:
    """Normality screen on all rows from skewness and excess kurtosis."""
    wide = df.agg(*[f for c in columns for f in (
        F.count(c).alias(f"n_{c}"), F.skewness(c).alias(f"s_{c}"), F.kurtosis(c).alias(f"k_{c}"))])
    out = to_rows(wide, [[F.lit(c), F.col(f"n_{c}"), F.col(f"s_{c}"), F.col(f"k_{c}")] for c in columns],
                  ["column_name", "n", "skewness", "kurtosis"])
    out = out.withColumn("jarque_bera", F.col("n") / 6.0 * (F.pow("skewness", F.lit(2.0)) + F.pow("kurtosis", F.lit(2.0)) / 4))
    return out.withColumn("p_value", p_chi2(F.col("jarque_bera"), F.lit(2))) if p_value else out


def flag_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency of two 0/1 flags, observed and chance agreement, Cohen's kappa and its band."""
    x, y = F.col(a) == 1, F.col(b) == 1
    t = df.agg(
        count_if(x & y).alias("both"), count_if(x & ~y).alias("only_a"), count_if(~x & y).alias("only_b"),
        count_if(~x & ~y).alias("neither"), F.count(F.lit(1)).alias("n"),
    )
    n = F.col("n")
    t = t.withColumn("observed", safe_divide(F.col("both") + F.col("neither"), n))
    pa, pb = safe_divide(F.col("both") + F.col("only_a"), n), safe_divide(F.col("both") + F.col("only_b"), n)
    t = t.withColumn("expected", pa * pb + (1 - pa) * (1 - pb))
    t = t.withColumn("kappa", safe_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected"), 0.0))
    return t.withColumn("agreement", kappa_band(F.col("kappa")))


def two_proportion_pairs(rates: DataFrame, label: str, hits: str, n: str, alpha: float = 0.05, p_value: bool = True) -> DataFrame:
    """Two-proportion z-test for every pair of labels. ``rates`` has one row per label."""
    j = label_pairs(rates.select(F.col(label).alias("label"), F.col(hits).alias("k"), F.col(n).alias("n")), ["label", "k", "n"])
    a, b = F.col("a"), F.col("b")
    pool = (a["k"] + b["k"]) / (a["n"] + b["n"])
    se = F.sqrt(pool * (1 - pool) * (1 / a["n"] + 1 / b["n"]))
    diff = a["k"] / a["n"] - b["k"] / b["n"]
    out = j.select(a["label"].alias("label_a"), b["label"].alias("label_b"), diff.alias("difference"), safe_divide(diff, se).alias("z"), "pairs")
    if p_value:
        out = out.withColumn("p_value", _bonferroni(F.col("z"), F.col("pairs"))).withColumn("significant", F.col("p_value") < alpha)
    return out.drop("pairs")


def missingness_mechanism(df: DataFrame, column: str, others: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """MCAR / MAR / POSSIBLY_MNAR label of one column from rank tests against all others.

    All tests run as one grouped job over (other column, value, missing?) counts.
    """
    tested = [c for c in others if c != column]
    flag = F.col(column).isNull().cast("int").alias("is_missing")
    long = df.select(flag, *[F.col(c).cast("double").alias(c) for c in tested]).unpivot(["is_missing"], tested, "other", "value")
    tests = mann_whitney(long, "value", "is_missing", by=["other"])
    valid = tests.where((F.col("n_1") > 5) & (F.col("n_0") > 5))
    res = valid.agg(F.count(F.lit(1)).alias("tests"), count_if(F.col("p_value") < alpha).alias("significant"))
    label = (
        F.when(F.col("missing") == 0, "NO_MISSING")
        .when((F.col("present") > 10) & (F.col("lo") != 0) & (F.col("hi") != 0)
              & ((F.col("q1") > F.col("lo") * 1.5) | (F.col("q3") < F.col("hi") * 0.5)), "POSSIBLY_MNAR")
        .when(F.col("_t.significant") > 0, "MAR").otherwise("MCAR")
    )
    own = df.select(F.col(column).cast("double").alias("v"))
    shape = own.agg(count_if(F.col("v").isNull()).alias("missing"), F.count("v").alias("present"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    shape = shape.withColumn("_q", one_row(quantiles(own, "v", {"q1": 0.25, "q3": 0.75}))).select("*", "_q.q1", "_q.q3")
    shape = shape.withColumn("_t", one_row(res))
    return shape.select(
        F.lit(column).alias("column_name"), "missing", F.col("_t.tests").alias("tests"),
        F.col("_t.significant").alias("significant_tests"), label.alias("mechanism"),
    )


# Label bands.

def skew_strength(s):
    a = F.abs(s)
    return ladder((a < 0.1, "negligible"), (a < 0.5, "slight"), (a < 1.0, "moderate"), (a < 2.0, "strong"), default="extreme")


def skew_direction(s):
    return F.when(F.abs(s) < 0.1, "none").when(s > 0, "right").otherwise("left")


def concentration(median, lo, hi):
    span = hi - lo
    return ladder((span == 0, "middle"), (median < lo + span * 0.33, "lower"), (median > lo + span * 0.67, "upper"), default="middle")


def symmetry(q25, median, q75, lo, hi):
    low, high, iqr = median - q25, q75 - median, q75 - q25
    return ladder(((hi - lo == 0) | (iqr == 0), "symmetric"), (F.abs(low - high) < iqr * 0.2, "symmetric"), (low > high, "lower_heavy"), default="upper_heavy")


def cramers_v_band(v):
    return ladder((v < 0.1, "negligible"), (v < 0.2, "weak"), (v < 0.4, "moderate"), default="strong")


def correlation_band(r):
    a = F.abs(r)
    return ladder((a > 0.9, "Very strong"), (a > 0.7, "Strong"), (a > 0.5, "Moderate"), (a > 0.3, "Weak"), default="Very weak")


def kappa_band(k):
    return ladder((k < 0.2, "slight"), (k < 0.4, "fair"), (k < 0.6, "moderate"), (k < 0.8, "substantial"), default="almost perfect")
