"""Revenue over time, by category, region, payment method and discount level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT, Config
from ..functions.expr import MONEY_SCALE, count_if, money_avg, money_sum, money_units, month_start, one_row, safe_divide, week_end
from ..functions.ranks import quantiles
from .hypothesis import mann_whitney


def complete_months(tx: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Drop the trailing partial month: a fixed cutoff if configured, else by the last day seen."""
    s = cfg.sales
    if not s.complete_months_only:
        return tx
    if s.incomplete_month_cutoff:
        return tx.where(F.col("order_date") < F.lit(s.incomplete_month_cutoff).cast("date"))
    last = tx.agg(F.max("order_date").alias("d")).scalar()
    partial = F.dayofmonth(last) < s.incomplete_month_days
    return tx.where(~partial | (F.col("order_date") < F.trunc(last, "month")))


def calendar_columns(tx: DataFrame) -> DataFrame:
    d = F.col("order_date")
    return tx.withColumns({
        "year_month": F.date_format(d, "yyyy-MM"), "year": F.year(d),
        "month_name": F.date_format(d, "MMMM"), "weekday_name": F.date_format(d, "EEEE"),
    })


def monthly_sales(tx: DataFrame) -> DataFrame:
    """Revenue, orders and distinct customers per month.

    Rows are first reduced to one per (month, customer); that replaces a distinct-expansion.
    """
    per = tx.groupBy(month_start(F.col("order_date")).alias("month"), "customer_id").agg(
        F.sum(money_units(F.col("total_amount"))).alias("u"), F.count("*").alias("n")
    )
    return per.groupBy("month").agg(
        (F.sum("u").cast("double") / MONEY_SCALE).alias("total_amount"),
        F.sum("n").alias("num_orders"), F.count("*").alias("customers"),
    )


def dense_months(monthly: DataFrame) -> DataFrame:
    """Add the months that are missing between the first and the last one, with null measures."""
    ends = monthly.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    grid = ends.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return grid.join(monthly, "month", "left")


def yoy_growth(monthly: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Percent change against the same month a year before; null everywhere under 13 months.

    The window runs over one row per calendar month.
    """
    s = cfg.sales
    grid = dense_months(monthly)
    prior = F.lag("total_amount", s.yoy_periods).over(Window.orderBy("month"))
    enough = F.count("total_amount").over(Window.partitionBy(F.lit(1))) >= s.min_months_for_yoy
    growth = F.when(enough, F.round(safe_divide(F.col("total_amount") - prior, prior) * 100, 2))
    return grid.withColumn("yoy_growth", growth).where(F.col("num_orders").isNotNull()).withColumn(
        "year_month", F.date_format("month", "yyyy-MM")
    )


def trend_metrics(yoy: DataFrame) -> DataFrame:
    """One row: months, average and peak revenue, average and latest yearly growth."""
    return yoy.agg(
        F.count("*").alias("total_months"), F.avg("total_amount").alias("avg_monthly_revenue"),
        F.max_by("year_month", "total_amount").alias("peak_month"), F.max("total_amount").alias("peak_revenue"),
        F.avg("yoy_growth").alias("avg_yoy_growth"),
        F.max_by("yoy_growth", F.when(F.col("yoy_growth").isNotNull(), F.col("month"))).alias("latest_yoy_growth"),
    )


def seasonality(tx: DataFrame) -> DataFrame:
    """Mean order value by calendar month name, largest first."""
    out = tx.groupBy(F.date_format("order_date", "MMMM").alias("month_name")).agg(
        money_avg(F.col("total_amount")).alias("avg_order_value")
    )
    return out.orderBy(F.desc("avg_order_value"))


def weekly_sales(tx: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Kept orders per week ending Sunday: revenue, transactions, customers; empty weeks left out."""
    per = tx.where(F.col("returned") == 0).groupBy(*by, week_end(F.col("order_date")).alias("date"), "customer_id").agg(
        F.sum(money_units(F.col("total_amount"))).alias("u"), F.count("*").alias("n")
    )
    out = per.groupBy(*by, "date").agg(
        (F.sum("u").cast("double") / MONEY_SCALE).alias("revenue"),
        F.sum("n").alias("transactions"), F.count("*").alias("customers"),
    )
    return out.where(F.col("revenue") > 0)


def rolling_trend(weekly: DataFrame, weeks: int) -> DataFrame:
    """Mean revenue of the last ``weeks`` weeks against the ones before (or the first, if short)."""
    w = weekly.withColumn("_back", F.row_number().over(Window.orderBy(F.desc("date"))))
    w = w.withColumn("_fore", F.row_number().over(Window.orderBy("date")))
    out = w.agg(
        F.count("*").alias("n_weeks"), F.avg(F.when(F.col("_back") <= weeks, F.col("revenue"))).alias("recent"),
        F.avg(F.when(F.col("_back").between(weeks + 1, 2 * weeks), F.col("revenue"))).alias("_before"),
        F.avg(F.when(F.col("_fore") <= weeks, F.col("revenue"))).alias("_first"),
    )
    rolling = F.col("n_weeks") >= 2 * weeks
    out = out.withColumn("prior", F.when(rolling, F.col("_before")).otherwise(F.col("_first")))
    pct = F.when(F.col("prior") > 0, (F.col("recent") / F.col("prior") - 1) * 100).otherwise(0.0)
    return out.select("n_weeks", "recent", "prior", pct.alias("pct_change"), F.when(rolling, "rolling").otherwise("first_vs_last").alias("basis"))


def chronological_split(weekly: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """First share of the weeks is train, the rest test; missing weeks appear with null revenue."""
    n = weekly.agg(F.count(F.lit(1)).alias("n")).scalar()
    w = weekly.withColumn("_i", F.row_number().over(Window.orderBy("date")))
    w = w.withColumn("part", F.when(F.col("_i") <= F.floor(n * cfg.sales.train_ratio), "train").otherwise("test")).drop("_i")
    ends = w.groupBy("part").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    grid = ends.select("part", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 7 DAY"))).alias("date"))
    return grid.join(w, ["part", "date"], "left")


def category_performance(tx: DataFrame) -> DataFrame:
    out = tx.groupBy("category").agg(
        F.round(money_sum(F.col("total_amount")), 2).alias("revenue"), F.count("order_id").alias("orders"),
        F.sum("quantity").alias("quantity"), F.round(F.avg("returned"), 2).alias("return_rate"),
        F.round(money_avg(F.col("profit_margin")), 2).alias("avg_profit_margin"),
    )
    return out.orderBy(F.desc("revenue"))


def category_mix(tx: DataFrame) -> DataFrame:
    """Revenue, mean value, orders, return rate and share of the total per category."""
    g = tx.groupBy("category").agg(
        money_sum(F.col("total_amount")).alias("revenue"), money_avg(F.col("total_amount")).alias("avg_order_value"),
        F.count("*").alias("orders"), (F.avg("returned") * 100).alias("return_rate"),
    )
    total = F.sum("revenue").over(Window.partitionBy(F.lit(1)))  # one row per category
    return g.withColumn("revenue_share_pct", safe_divide(F.col("revenue") * 100, total, 0.0))


def category_pareto(tx: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Categories by revenue with the running share and how many reach the threshold."""
    g = tx.groupBy("category").agg(money_sum(F.col("total_amount")).alias("revenue"))
    order = Window.orderBy(F.desc("revenue"), "category")  # one row per category
    whole = Window.partitionBy(F.lit(1))
    running = F.sum("revenue").over(order.rowsBetween(Window.unboundedPreceding, 0))
    g = g.withColumn("rank", F.row_number().over(order)).withColumn(
        "cumulative_pct", safe_divide(running, F.sum("revenue").over(whole)) * 100
    )
    reach = F.min(F.when(F.col("cumulative_pct") >= threshold, F.col("rank"))).over(whole)
    return g.withColumn("categories_for_threshold", reach)


def region_performance(tx: DataFrame) -> DataFrame:
    """Revenue, return rate, customers, orders, order value and revenue per customer by region."""
    per = tx.groupBy("region", "customer_id").agg(
        F.sum(money_units(F.col("total_amount"))).alias("u"), F.count("*").alias("n"), F.sum("returned").alias("back")
    )
    g = per.groupBy("region").agg(
        (F.sum("u").cast("double") / MONEY_SCALE).alias("_rev"), F.sum("back").alias("_back"),
        F.count("*").alias("customers"), F.sum("n").alias("orders"),
    )
    return g.select(
        "region", F.round("_rev", 2).alias("revenue"), F.round(F.col("_back") / F.col("orders"), 2).alias("return_rate"),
        "customers", "orders", F.round(safe_divide(F.col("_rev"), F.col("orders"), 0.0), 2).alias("aov"),
        F.round(safe_divide(F.col("_rev"), F.col("customers"), 0.0), 2).alias("revenue_per_customer"),
    ).orderBy(F.desc("revenue"))


def payment_performance(tx: DataFrame) -> DataFrame:
    g = tx.groupBy("payment_method").agg(
        money_sum(F.col("total_amount")).alias("_rev"), F.count("order_id").alias("orders"), F.avg("returned").alias("_rate")
    )
    total = F.sum("_rev").over(Window.partitionBy(F.lit(1)))  # one row per method
    return g.select(
        "payment_method", F.round("_rev", 2).alias("revenue"), "orders", F.round("_rate", 2).alias("return_rate"),
        F.round(safe_divide(F.col("_rev"), total, 0.0) * 100, 2).alias("pct_of_total"),
    ).orderBy(F.desc("revenue"))


def discount_tiers(tx: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Listed discount percentages in their order; unlisted levels drop out."""
    pct = F.rint(F.col("discount") * 100).cast("int")
    g = tx.withColumn("tier_order", pct).where(F.col("tier_order").isin(*cfg.sales.discount_levels)).groupBy("tier_order").agg(
        F.round(money_sum(F.col("total_amount")), 2).alias("revenue"), F.count("order_id").alias("orders"),
        F.sum("quantity").alias("quantity"), F.round(money_avg(F.col("profit_margin")), 2).alias("avg_profit_margin"),
    )
    return g.withColumn("discount_tier", F.concat(F.col("tier_order").cast("string"), F.lit("%"))).orderBy("tier_order")


def discount_customers(tx: DataFrame, p_value: bool = True) -> DataFrame:
    """Customers who ever used a discount against those who never did: counts, orders, revenue, rank test."""
    per = tx.groupBy("customer_id").agg(
        F.bool_or(F.col("discount") > 0).cast("int").alias("ever_discounted"), F.count("*").alias("order_count"),
        money_sum(F.col("total_amount")).alias("total_revenue"),
    )
    g = per.groupBy("ever_discounted").agg(
        F.count("*").alias("n"), F.avg("order_count").alias("o"), money_avg(F.col("total_revenue")).alias("r")
    )
    q = quantiles(per, "order_count", {"m": 0.5}, by=["ever_discounted"])
    at = lambda flag, c: F.max(F.when(F.col("ever_discounted") == flag, F.col(c)))
    out = g.join(q, "ever_discounted", "left").agg(
        F.coalesce(at(1, "n"), F.lit(0)).alias("n_discount_customers"), F.coalesce(at(0, "n"), F.lit(0)).alias("n_no_discount_customers"),
        at(1, "o").alias("avg_orders_discount"), at(0, "o").alias("avg_orders_no_discount"),
        at(1, "m").alias("median_orders_discount"), at(0, "m").alias("median_orders_no_discount"),
        at(1, "r").alias("avg_revenue_discount_customer"), at(0, "r").alias("avg_revenue_no_discount_customer"),
    )
    lift = lambda a, b: F.when(F.col(b) > 0, (F.col(a) / F.col(b) - 1) * 100).otherwise(0.0)
    out = out.withColumn("frequency_lift_pct", lift("median_orders_discount", "median_orders_no_discount"))
    out = out.withColumn("revenue_per_customer_lift_pct", lift("avg_revenue_discount_customer", "avg_revenue_no_discount_customer"))
    t = one_row(mann_whitney(per, "order_count", "ever_discounted", p_value=p_value))
    return out.withColumn("_t", t).select("*", "_t.u_statistic", *(["_t.p_value"] if p_value else [])).drop("_t")


def discount_summary(tx: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row: revenue with and without discount over the listed levels, and the discounted share."""
    t = discount_tiers(tx, cfg)
    zero = F.col("tier_order") == 0
    out = t.agg(
        F.count("*").alias("total_levels"), F.coalesce(F.sum(F.when(zero, F.col("revenue"))), F.lit(0.0)).alias("no_discount_revenue"),
        F.coalesce(F.sum(F.when(~zero, F.col("revenue"))), F.lit(0.0)).alias("discounted_revenue"),
        F.coalesce(F.max(F.when(zero, F.col("avg_profit_margin"))), F.lit(0.0)).alias("avg_margin_no_discount"),
    )
    total = F.col("no_discount_revenue") + F.col("discounted_revenue")
    return out.withColumn("total_revenue", total).withColumn(
        "discount_pct_of_total", safe_divide(F.col("discounted_revenue") * 100, F.col("total_revenue"), 0.0)
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per value of several text columns in one pass."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "value")
    return long.groupBy("column_name", "value").agg(F.count("*").alias("rows"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last bin is closed."""
    v = F.col(column).cast("double")
    r = one_row(df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")))
    d = df.where(v.isNotNull()).select(v.alias("v")).withColumn("_r", r)
    width = (F.col("_r.hi") - F.col("_r.lo")) / bins
    b = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("_r.lo"), width)), F.lit(bins - 1)), F.lit(0))
    return d.select(b.alias("bin"), (F.col("_r.lo") + b * width).alias("bin_start"), (F.col("_r.lo") + (b + 1) * width).alias("bin_end")).groupBy(
        "bin", "bin_start", "bin_end"
    ).agg(F.count("*").alias("rows"))


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Five-number summary per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column_name", "value")
    return quantiles(long, "value", {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}, by=["column_name"])


def describe(df: DataFrame, columns: list[str], target: str | None = None) -> DataFrame:
    """Mean, std, min, max, missing and, if given, correlation with the target, per column."""
    def stats(c):
        v = F.col(c).cast("double")
        out = [F.avg(v), F.stddev_samp(v), F.min(v), F.max(v), count_if(v.isNull())]
        return out + ([F.corr(v, F.col(target).cast("double"))] if target else [])

    names = ["mean", "std", "min", "max", "missing"] + (["target_correlation"] if target else [])
    wide = df.agg(*[s.alias(f"{n}__{c}") for c in columns for n, s in zip(names, stats(c))])
    items = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{n}__{c}").alias(n) for n in names]) for c in columns]
    return wide.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def performance_matrix(tx: DataFrame) -> DataFrame:
    """Category and region revenue in one labelled table, from one grouping-sets pass."""
    g = tx.groupingSets([["category"], ["region"]], "category", "region").agg(
        F.round(money_sum(F.col("total_amount")), 2).alias("revenue"), F.grouping("region").alias("_g")
    )
    return g.select(
        F.when(F.col("_g") == 1, "category").otherwise("region").alias("dimension"),
        F.when(F.col("_g") == 1, F.col("category")).otherwise(F.col("region")).alias("label"), "revenue",
    )


def kpi_rollup(sections: dict[str, DataFrame]) -> DataFrame:
    """One-row frames of several sections as (section, metric, value) rows."""
    out = None
    for name, df in sections.items():
        cols = df.columns
        part = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "metric", "value")
        part = part.select(F.lit(name).alias("section"), "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out
