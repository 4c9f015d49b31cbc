"""Acquisition cohorts: retention, revenue, lifetime value, stability and scenarios.

Everything is long format: cohort_month, period_offset, value. Transactions are reduced once to
one row per (customer, order month); every later step reads that table or the cohort grid, whose
size is bounded by months squared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT, Config
from ..functions.expr import (
    MONEY_SCALE, count_if, ladder, money_sum, money_units, month_start, months_between_int, one_row, safe_divide, to_rows,
)

CELL = ("cohort_month", "period_offset")


def first_kept_month(tx: DataFrame) -> DataFrame:
    return tx.where(F.col("returned") == 0).groupBy("customer_id").agg(
        month_start(F.min("order_date")).alias("cohort_month")
    )


def assign_cohorts(tx: DataFrame) -> DataFrame:
    """Transaction rows with cohort_month, order_month and period_offset (never negative).

    Customers without a kept order drop out. The join side is one row per customer.
    """
    out = tx.join(first_kept_month(tx), "customer_id").withColumn("order_month", month_start(F.col("order_date")))
    offset = F.greatest(months_between_int(F.col("order_month"), F.col("cohort_month")), F.lit(0))
    return out.withColumn("period_offset", offset)


def customer_months(tx: DataFrame, extra: tuple[str, ...] = (), cfg: Config = DEFAULT) -> DataFrame:
    """Kept orders before the cutoff, one row per (customer, month), with cohort and offset.

    The per-customer minimum runs as a window over the already reduced rows, so one customer can
    contribute at most one row per calendar month to a task.
    """
    per = tx.where(F.col("returned") == 0).groupBy("customer_id", *extra, month_start(F.col("order_date")).alias("order_month")).agg(
        F.sum(money_units(F.col("total_amount"))).alias("units"), F.count("*").alias("orders")
    )
    cohort = F.min("order_month").over(Window.partitionBy("customer_id"))
    per = per.withColumn("cohort_month", cohort)
    per = per.withColumn("period_offset", months_between_int(F.col("order_month"), F.col("cohort_month")))
    return per


def _before_cutoff(months: DataFrame, cfg: Config) -> DataFrame:
    return months.where(F.col("order_month") < F.trunc(F.lit(cfg.cohort.incomplete_cutoff).cast("date"), "month"))


def cohort_sizes(tx: DataFrame) -> DataFrame:
    return first_kept_month(tx).groupBy("cohort_month").agg(F.count("*").alias("cohort_size"))


def low_n_cohorts(sizes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return sizes.where(F.col("cohort_size") < cfg.cohort.min_cohort_size)


def cohort_cells(tx: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The full grid: active, cohort_size, retention, revenue and cumulative LTV per cell.

    Unobserved cells before the cutoff are 0; cells at or after it are null. Offset 0 is 1.
    Months with no activity anywhere do not create a column, as in a pivot of observed offsets.

    Transactions are read once. The observed cells of a cohort are folded into one map row, and the
    missing ones come from exploding the offsets against that map, so no grid is joined.
    """
    cutoff = F.trunc(F.lit(cfg.cohort.incomplete_cutoff).cast("date"), "month")
    seen = customer_months(tx).groupBy(*CELL).agg(F.count("*").alias("n"), F.sum("units").alias("u"))
    open_cell = F.add_months("cohort_month", F.col("period_offset")) < cutoff
    entry = F.when(open_cell, F.struct("period_offset", F.struct("n", "u")))
    per = seen.groupBy("cohort_month").agg(
        F.sum(F.when(F.col("period_offset") == 0, F.col("n"))).alias("cohort_size"),
        F.map_from_entries(F.collect_list(entry)).alias("m"),
    ).where(F.size("m") > 0)
    everything = Window.partitionBy(F.lit(1))  # one row per cohort month
    offsets = F.array_union(F.array(F.lit(0)), F.flatten(F.collect_list(F.map_keys("m")).over(everything)))
    g = per.withColumn("_o", offsets).select("cohort_month", "cohort_size", "m", F.explode("_o").alias("period_offset"))
    hit = F.try_element_at("m", F.col("period_offset"))
    closed = F.add_months("cohort_month", F.col("period_offset")) >= cutoff
    active = F.coalesce(hit.getField("n"), F.lit(0))
    units = F.when(~closed, F.coalesce(hit.getField("u"), F.lit(0)))
    rate = F.when(F.col("period_offset") == 0, 1.0).when(~closed, F.least(active / F.col("cohort_size"), F.lit(1.0)))
    g = g.select(*CELL, "cohort_size", active.alias("active"), rate.alias("retention"), units.alias("u"))
    run = Window.partitionBy("cohort_month").orderBy("period_offset").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("u").over(run).cast("double") / MONEY_SCALE
    ltv = F.when(F.col("u").isNotNull(), total / F.col("cohort_size"))
    return g.withColumn("ltv", ltv).withColumn("revenue", F.col("u").cast("double") / MONEY_SCALE).select(
        *CELL, "cohort_size", "active", "retention", "revenue", "ltv"
    )


def aggregate_retention(cells: DataFrame) -> DataFrame:
    """Size-weighted retention by offset, number of cohorts and change to the offset before."""
    live = F.col("retention").isNotNull()
    out = cells.groupBy("period_offset").agg(
        safe_divide(F.sum(F.col("retention") * F.col("cohort_size")), F.sum(F.when(live, F.col("cohort_size")))).alias("retention"),
        count_if(live).alias("cohorts"),
    ).where(F.col("cohorts") > 0)
    prev = F.lag("retention").over(Window.orderBy("period_offset"))  # one row per offset
    return out.withColumn("delta", F.col("retention") - prev)


def dropout_rates(agg: DataFrame) -> DataFrame:
    prev = F.lag("retention").over(Window.orderBy("period_offset"))  # one row per offset
    rate = F.greatest(safe_divide(prev - F.col("retention"), prev, 0.0), F.lit(0.0))
    return agg.withColumn("dropout_rate", F.when(prev.isNotNull(), rate)).where(F.col("dropout_rate").isNotNull()).select(
        "period_offset", "dropout_rate"
    )


def revenue_rates(cells: DataFrame) -> DataFrame:
    """Each cell's revenue relative to its cohort's month 0."""
    first = F.max(F.when(F.col("period_offset") == 0, F.col("revenue"))).over(Window.partitionBy("cohort_month"))
    return cells.withColumn("revenue_rate", safe_divide(F.col("revenue"), F.nullif(first, F.lit(0.0))))


def revenue_retention(cells: DataFrame) -> DataFrame:
    r = revenue_rates(cells).where(F.col("revenue_rate").isNotNull())
    return r.groupBy("period_offset").agg(
        safe_divide(F.sum(F.col("revenue_rate") * F.col("cohort_size")), F.sum("cohort_size")).alias("revenue_retention"),
        F.count("*").alias("cohorts"),
    )


def aov_by_period(cells: DataFrame) -> DataFrame:
    return cells.groupBy("period_offset").agg(
        safe_divide(money_sum(F.col("revenue")), F.sum("active")).alias("aov"),
        money_sum(F.col("revenue")).alias("revenue"), F.sum("active").alias("active"),
    ).where(F.col("active") > 0)


def ltv_benchmarks(cells: DataFrame, windows: tuple[int, ...], weighted: bool = False) -> DataFrame:
    """Mean LTV over cohorts at each window, or at the nearest smaller offset when it is absent."""
    v = F.col("ltv")
    mean = F.sum(v * F.col("cohort_size")) / F.sum(F.when(v.isNotNull(), F.col("cohort_size"))) if weighted else F.avg(v)
    per = cells.groupBy("period_offset").agg(mean.alias("ltv")).where(F.col("ltv").isNotNull())
    at = lambda w: F.max_by("ltv", F.when(F.col("period_offset") <= w, F.col("period_offset")))
    wide = per.agg(*[at(w).alias(f"w{w}") for w in windows])
    return to_rows(wide, [[F.lit(w), F.col(f"w{w}")] for w in windows], ["window_months", "ltv"])


def ltv_projection(cells: DataFrame, target: int) -> DataFrame:
    """Line through the last three observed offsets, evaluated at ``target`` and floored at 0."""
    seen = cells.where(F.col("ltv").isNotNull())
    back = F.row_number().over(Window.partitionBy("cohort_month").orderBy(F.desc("period_offset")))
    last = seen.withColumn("_b", back).where(F.col("_b") <= 3)
    fit = last.groupBy("cohort_month").agg(
        F.count("*").alias("n"), F.max("period_offset").alias("last_offset"),
        F.regr_slope("ltv", "period_offset").alias("slope"), F.regr_intercept("ltv", "period_offset").alias("intercept"),
    ).where((F.col("n") == 3) & (F.col("last_offset") < target))
    value = F.round(F.greatest(F.col("intercept") + F.col("slope") * target, F.lit(0.0)), 2)
    return fit.select("cohort_month", "last_offset", value.alias("projected_ltv"))


def first_category(tx: DataFrame) -> DataFrame:
    """Category of each customer's first kept order; ties on the day go to the smaller order id."""
    return tx.where(F.col("returned") == 0).groupBy("customer_id").agg(
        F.min_by("category", F.struct("order_date", "order_id")).alias("first_category")
    )


def attach_segment(df: DataFrame, labels: DataFrame, segment: str) -> DataFrame:
    """Left join of one label per customer; customers without a label keep null."""
    one = labels.groupBy("customer_id").agg(F.min(segment).alias(segment))
    return df.join(one, "customer_id", "left")


def segment_retention(tx: DataFrame, labels: DataFrame, segment: str, cfg: Config = DEFAULT) -> DataFrame:
    """Active customers at each offset relative to the customers acquired, per segment."""
    m = attach_segment(_before_cutoff(customer_months(tx), cfg), labels, segment).where(F.col(segment).isNotNull())
    g = m.groupBy(segment, "period_offset").agg(F.count("*").alias("active"))
    base = F.max(F.when(F.col("period_offset") == 0, F.col("active"))).over(Window.partitionBy(segment))
    g = g.withColumn("acquired", base)
    return g.where(F.col("acquired") > 0).withColumn("retention", F.round(F.col("active") / F.col("acquired"), 6))


def segment_ltv(tx: DataFrame, labels: DataFrame, segment: str, windows: tuple[int, ...], cfg: Config = DEFAULT) -> DataFrame:
    """Cumulative revenue up to each window per acquired customer, one pass over the months."""
    m = attach_segment(_before_cutoff(customer_months(tx), cfg), labels, segment).where(F.col(segment).isNotNull())
    o = F.col("period_offset")
    wide = m.groupBy(segment).agg(
        count_if(o == 0).alias("acquired"),
        *[(F.sum(F.when(o <= w, F.col("units"))).cast("double") / MONEY_SCALE).alias(f"r{w}") for w in windows],
    ).where(F.col("acquired") > 0)
    out = to_rows(wide, [[F.lit(w), F.col(f"r{w}")] for w in windows], ["window_months", "_r"], keep=[segment, "acquired"])
    return out.where(F.col("_r").isNotNull()).select(segment, "acquired", "window_months", F.round(F.col("_r") / F.col("acquired"), 4).alias("ltv"))


def cohort_summary(cells: DataFrame) -> DataFrame:
    """Nine key numbers per cohort."""
    at = lambda col, k: F.max(F.when(F.col("period_offset") == k, F.col(col)))
    return cells.groupBy("cohort_month").agg(
        F.max(F.when(F.col("retention").isNotNull(), F.col("period_offset"))).alias("max_period_observed"),
        at("retention", 1).alias("m1_retention"), at("retention", 3).alias("m3_retention"), at("retention", 6).alias("m6_retention"),
        F.sum("revenue").alias("total_revenue"),
        at("ltv", 3).alias("ltv_3m"), at("ltv", 6).alias("ltv_6m"), at("ltv", 12).alias("ltv_12m"),
    )


def acquisition_stats(sizes: DataFrame) -> DataFrame:
    prev = F.lag("cohort_size").over(Window.orderBy("cohort_month"))  # one row per cohort
    g = sizes.withColumn("g", safe_divide(F.col("cohort_size") - prev, prev))
    out = g.agg(
        F.round(F.avg("g") * 100, 2).alias("monthly_growth_pct"),
        F.round(F.stddev_samp("cohort_size") / F.avg("cohort_size"), 4).alias("cv"),
    )
    return out.withColumn("trend", F.when(F.col("monthly_growth_pct") > 0, "Growth").otherwise("Decline")).withColumn(
        "volume", F.when(F.col("cv") < 0.3, "Stable").otherwise("Volatile")
    )


def retention_stability(cells: DataFrame) -> DataFrame:
    """Sample std of retention across cohorts, for offsets that two or more cohorts reached."""
    return cells.groupBy("period_offset").agg(
        F.stddev_samp("retention").alias("retention_std"), F.count("retention").alias("cohorts")
    ).where(F.col("cohorts") >= 2)


def retention_outliers(cells: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Cohorts whose mean observed retention is far from the other cohorts' mean (three or more cohorts)."""
    per = cells.where(F.col("retention").isNotNull()).groupBy("cohort_month").agg(F.avg("retention").alias("mean_retention"))
    s = one_row(per.agg(
        F.avg("mean_retention").alias("m"), F.stddev_samp("mean_retention").alias("s"), F.count("*").alias("n")
    ))
    z = F.when(F.col("_s.n") >= 3, safe_divide(F.col("mean_retention") - F.col("_s.m"), F.col("_s.s")))
    out = per.withColumn("_s", s).withColumn("z_score", z).where(F.abs("z_score") >= cfg.cohort.outlier_z)
    label = F.when(F.col("z_score") > 0, "Outperformer").otherwise("Underperformer")
    return out.withColumn("direction", label).drop("_s").orderBy(F.abs("z_score").desc(), "cohort_month")


def retention_assessment(cells: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Offset-wise customer and revenue retention with their health and spread labels."""
    c = cfg.cohort
    a = aggregate_retention(cells).select("period_offset", "retention")
    r = revenue_retention(cells).select("period_offset", "revenue_retention")
    j = a.join(r, "period_offset")
    health = ladder((F.col("retention") >= c.healthy_month1, "Healthy"), (F.col("retention") >= c.healthy_month1 * 0.6, "Below benchmark"), default="Critical")
    spread = F.col("revenue_retention") - F.col("retention")
    kind = ladder(
        (spread > 0.02, "High-value customers retained"), (spread < -0.02, "High-value customers churning faster"),
        default="Proportional churn",
    )
    return j.withColumn("assessment", health).withColumn("spread", spread).withColumn("churn_kind", kind)


def uplift_scenarios(cells: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Yearly value of lifting retention: mean cohort size x increment x LTV(period) x 12."""
    c = cfg.cohort
    size = cells.where(F.col("period_offset") == 0).agg(F.avg("cohort_size").alias("s")).scalar()
    ltv = ltv_benchmarks(cells, c.scenario_periods)
    out = ltv.withColumn("increment", F.explode(F.array(*[F.lit(x) for x in c.increments])))
    out = out.withColumn("avg_cohort_size", size)
    return out.select(
        "increment", F.col("window_months").alias("period"), "avg_cohort_size", "ltv",
        (F.col("avg_cohort_size") * F.col("increment") * F.col("ltv") * 12).alias("annual_uplift"),
    )


def month1_counts(cells: DataFrame, offset: int = 1) -> DataFrame:
    """Customers of each cohort that were active, and not, at an offset (observed cohorts only)."""
    return cells.where((F.col("period_offset") == offset) & F.col("retention").isNotNull()).select(
        "cohort_month", "cohort_size", F.col("active").alias("retained")
    )


def cohort_chi_square(cells: DataFrame, offset: int = 1) -> DataFrame:
    """Test of equal retention across cohorts on customer counts (retained or not)."""
    m = month1_counts(cells, offset)
    n, k = F.col("cohort_size").cast("double"), F.col("retained").cast("double")
    out = m.agg(F.count("*").alias("cohorts"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(k * k / n).alias("kk"))
    p = F.col("k") / F.col("n")
    chi = (F.col("kk") - F.col("k") * p) / (p * (1 - p))
    return out.select("cohorts", F.col("n").cast("bigint").alias("customers"), p.alias("pooled_rate"), chi.alias("chi2"), (F.col("cohorts") - 1).alias("dof"))


def cohort_insight_flags(cells: DataFrame, segments: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Rule rows (rule_id, fired, metric, priority) on the aggregate curves.

    ``segments`` is the long segment retention table (first column label, then offset and rate).
    """
    agg = aggregate_retention(cells)
    drops = dropout_rates(agg).where(F.col("period_offset") > 0)
    gap = retention_assessment(cells, cfg).where(F.col("period_offset") > 0)
    bench = ltv_benchmarks(cells, (3, 12))
    base = agg.agg(F.max(F.when(F.col("period_offset") == 1, F.col("retention"))).alias("m1")).withColumns({
        "_d": one_row(drops.agg(
            F.max("dropout_rate").alias("peak"),
            F.max_by("period_offset", F.struct("dropout_rate", (-F.col("period_offset")).alias("k"))).alias("at"),
        )),
        "_s": one_row(gap.agg(F.avg("spread").alias("spread"), F.count("*").alias("n"))),
        "_b": one_row(bench.agg(
            F.max(F.when(F.col("window_months") == 3, F.col("ltv"))).alias("l3"),
            F.max(F.when(F.col("window_months") == 12, F.col("ltv"))).alias("l12"),
        )),
    })
    m1, bm = F.col("m1"), cfg.cohort.healthy_month1
    spread, growth = F.col("_s.spread"), F.try_divide(F.col("_b.l12"), F.col("_b.l3"))
    peak = F.col("_d.peak")
    late = F.col("_d.at") > 1
    rules = [
        ("month1_below_benchmark", m1 - bm < -0.05, m1, F.lit(95)),
        ("month1_meets_benchmark", m1 - bm >= -0.05, m1, F.lit(20)),
        ("late_dropout_peak", late, peak, F.when(peak > 0.4, 85).otherwise(50)),
        ("high_value_churning_faster", spread < -0.05, spread, F.lit(88)),
        ("high_value_retained", spread > 0.05, spread, F.lit(55)),
        ("revenue_churn_proportional", spread.between(-0.05, 0.05), spread, F.lit(22)),
        ("ltv_plateau", growth < 1.5, growth, F.when(growth < 1.2, 80).otherwise(52)),
        ("ltv_growing", growth >= 1.5, growth, F.lit(25)),
    ]
    if segments is not None:
        first = segments.where(F.col("period_offset") == 1).agg(
            (F.max("retention") - F.min("retention")).alias("g"), F.count("*").alias("n")
        )
        base = base.withColumn("_g", one_row(first))
        g = F.col("_g.g")
        rules.append(("segment_retention_gap", F.col("_g.n") >= 2, g, F.when(g > 0.15, 78).otherwise(48)))
    rows = [[F.lit(n), F.coalesce(f, F.lit(False)), m.cast("double"), p.cast("int")] for n, f, m, p in rules]
    return to_rows(base, rows, ["rule_id", "fired", "metric", "priority"]).orderBy(F.desc("priority"))


def wide_matrix(cells: DataFrame, value: str) -> DataFrame:
    """Pivot for the wide files: month and offsets as text, as readers of those files expect."""
    offsets = sorted(r[0] for r in cells.select("period_offset").distinct().collect())  # bounded by months
    out = cells.groupBy(F.date_format("cohort_month", "yyyy-MM").alias("cohort_month")).pivot("period_offset", offsets).agg(F.first(value))
    return out.select("cohort_month", *[F.col(str(o)) for o in offsets]).orderBy("cohort_month")
