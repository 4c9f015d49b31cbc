"""Per-customer risk features, rule scores, tiers, typologies and exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT, Config
from ..functions.expr import (
    MONEY_SCALE, clip01, count_if, day_number, ladder, money_units, one_row, safe_divide, share,
)
from ..functions.ranks import quantiles
from ..session import materialized

# Rules as (name, feature, threshold field, weight field, floor).
RULES = (
    ("return_abuse", "return_rate", "return_rate_high", "weight_return_abuse", 0.0),
    ("discount_exploitation", "max_discount_rate", "discount_rate_high", "weight_discount_exploitation", 0.0),
    ("high_discount_returns", "high_discount_return_rate", "return_rate_high", "weight_high_discount_returns", 0.0),
    ("velocity_anomaly", "max_orders_7d", "velocity_order_count", "weight_velocity_anomaly", 1.0),
    ("margin_exploitation", "negative_margin_rate", "negative_margin_rate_high", "weight_margin_exploitation", 0.0),
    ("order_value_anomaly", "high_value_rate_p99", "high_value_p99_rate", "weight_order_value_anomaly", 0.0),
    ("category_concentration", "category_hhi", "category_hhi_threshold", "weight_category_concentration", 0.0),
)

# Typology flags in label order.
TYPOLOGIES = (
    ("type_return_abuser", "Return Abuse"), ("type_discount_exploiter", "Discount Exploitation"),
    ("type_velocity", "Velocity Anomaly"), ("type_margin_exploiter", "Margin Exploitation"),
    ("type_high_value", "High-Value Anomaly"),
)


def _daily(tx: DataFrame) -> DataFrame:
    return tx.groupBy("customer_id", day_number(F.col("order_date")).alias("day")).agg(F.count("*").alias("n"))


def _velocity_columns(df: DataFrame) -> DataFrame:
    """Adds window counts and gaps to rows (customer_id, day, n); several rows may share a day."""
    by_day = Window.partitionBy("customer_id").orderBy("day")
    return df.withColumns({
        "_w7": F.sum("n").over(by_day.rangeBetween(0, 7)), "_w30": F.sum("n").over(by_day.rangeBetween(0, 30)),
        "_gap": F.col("day") - F.lag("day").over(by_day),
    })


def _velocity_aggregates(cfg: Config) -> list:
    """Gap statistics over all consecutive orders; orders on one day have gap 0 between them."""
    gaps = (F.sum("n") - 1).cast("double")
    total, squares = F.sum("_gap").cast("double"), F.sum(F.col("_gap").cast("bigint") * F.col("_gap")).cast("double")
    mean = F.try_divide(total, gaps)
    spread = F.sqrt(F.greatest(F.try_divide(squares - total * total / gaps, gaps - 1), F.lit(0.0)))
    cv = F.when((F.sum("n") > 2) & (total > 0), spread / mean).otherwise(0.0)
    least = F.when(F.max("n") > 1, 0).otherwise(F.coalesce(F.min("_gap"), F.lit(0)))
    return [
        F.max("_w7").alias("max_orders_7d"), F.max("_w30").alias("max_orders_30d"), cv.alias("gap_cv"),
        least.alias("min_order_gap_days"), (F.max("_w7") >= cfg.fraud.burst_orders).cast("int").alias("velocity_burst_flag"),
    ]


def velocity(tx: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Largest number of orders in 7 and 30 days after an order, gap variation and smallest gap.

    Orders are counted per (customer, day) first: a customer brings at most one row per calendar
    day to the window, however many orders there are.
    """
    return _velocity_columns(_daily(tx)).groupBy("customer_id").agg(*_velocity_aggregates(cfg))


def concentration(tx: DataFrame) -> DataFrame:
    """Category HHI, number of payment methods and share of the top one, per customer.

    The counts of (customer, category, payment) are dealt out by customer once; both label tables and the result are aggregates there, nothing is sorted.
    """
    n = F.col("n").cast("double")
    cells = tx.groupBy("customer_id", "category", "payment_method").agg(F.count("*").alias("n")).repartition("customer_id")
    cat = cells.groupBy("customer_id", "category").agg(F.sum("n").alias("n")).groupBy("customer_id").agg((F.sum(n * n) / (F.sum(n) * F.sum(n))).alias("category_hhi"))
    pay = cells.groupBy("customer_id", "payment_method").agg(F.sum("n").alias("n")).groupBy("customer_id").agg(
        F.count("payment_method").alias("n_payment_methods"), (F.max(n) / F.sum(n)).alias("payment_concentration"),
    )
    return _by_customer(cat, pay)


def _by_customer(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two tables with one row per customer each, side by side; a null customer is one, too."""
    key = right["customer_id"]
    return left.join(right, left["customer_id"].eqNullSafe(key)).drop(key)


def amount_thresholds(tx: DataFrame) -> DataFrame:
    """Exact P95 and P99 of the order amount over all orders."""
    return quantiles(tx, "total_amount", {"p95": 0.95, "p99": 0.99})


def fraud_features(tx: DataFrame, cust: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per customer with every risk feature.

    The wide measures are one aggregate by customer with fixed-size partial states. Windows run over narrow counts only: (customer, day) for the velocity; a customer's rows
    there are bounded by the calendar, and by the label sets for the concentration. The transactions are read five times: twice for the two cut values, and once for each part.
    """
    f = cfg.fraud
    c = F.col
    t = one_row(amount_thresholds(tx))
    amount, units = c("total_amount"), money_units(c("total_amount"))
    high = c("discount") >= f.high_discount
    day = day_number(c("order_date"))
    n = F.count("*").cast("double")
    s, ss = F.sum(units).cast("double"), F.sum(units.cast("decimal(19,0)") * units).cast("double")
    spread = F.sqrt(F.greatest(F.try_divide(ss - s * s / n, n - 1), F.lit(0.0)))
    per = tx.groupBy("customer_id").agg(
        F.count("*").alias("order_count"), (s / MONEY_SCALE / n).alias("avg_order_value"), F.max(amount).alias("max_order_value"),
        F.min(amount).alias("min_order_value"), (s / MONEY_SCALE).alias("total_revenue"), (F.sum("quantity") / n).alias("avg_quantity"),
        F.max("quantity").alias("max_quantity"), F.greatest(F.max(day) - F.min(day), F.lit(1)).alias("tenure_days"),
        F.coalesce(F.try_divide(spread, s / n), F.lit(0.0)).alias("order_value_cv"), (F.sum("returned") / n).alias("return_rate"),
        F.coalesce(F.sum(F.when(c("returned") == 1, units)).cast("double") / MONEY_SCALE, F.lit(0.0)).alias("returned_value"),
        F.coalesce(F.try_divide(F.sum(F.when(high, c("returned"))).cast("double"), count_if(high).cast("double")), F.lit(0.0)).alias("high_discount_return_rate"),
        (count_if(c("discount") > 0) / n).alias("discount_usage_rate"), (count_if(c("discount") >= f.max_discount) / n).alias("max_discount_rate"),
        (F.sum(money_units(c("discount"))).cast("double") / MONEY_SCALE / n).alias("avg_discount"), F.max("discount").alias("max_discount"),
        count_if(amount >= t.getField("p99")).alias("high_value_orders_p99"),
        (count_if(amount >= t.getField("p95")) / n).alias("high_value_rate_p95"), (count_if(amount >= t.getField("p99")) / n).alias("high_value_rate_p99"),
        (count_if(c("profit_margin") < 0) / n).alias("negative_margin_rate"),
        (F.sum(money_units(c("profit_margin"))).cast("double") / MONEY_SCALE / n).alias("avg_profit_margin"), F.min("profit_margin").alias("min_profit_margin"),
    )
    # orders without a date are on no common day: they stay apart by their labels
    undated = F.when(c("order_date").isNull(), F.struct("category", "payment_method"))
    days = tx.groupBy("customer_id", day.alias("day"), undated.alias("_undated")).agg(F.count("*").alias("n"))
    speed = _velocity_columns(days).groupBy("customer_id").agg(*_velocity_aggregates(cfg))
    per = _by_customer(_by_customer(per, speed), concentration(tx)).withColumns({
        "order_rate_per_day": c("order_count") / c("tenure_days"),
        "always_max_discount": (c("max_discount_rate") >= f.always_max_share).cast("int"),
        "all_negative_margins": (c("negative_margin_rate") >= 1.0).cast("int"),
    })
    per = materialized(per)  # read twice: for the mean and deviation over customers, and for the result
    z = one_row(per.agg(F.avg("avg_order_value").alias("m"), F.stddev_pop("avg_order_value").alias("s")))
    per = per.withColumn("_z", z).withColumn("aov_zscore", safe_divide(c("avg_order_value") - c("_z.m"), c("_z.s"), 0.0)).drop("_z")
    extra = ["recency_days", "frequency", "monetary", "loyalty_score"]
    out = per.join(cust.select("customer_id", *extra), "customer_id", "left")
    return out.withColumns({x: F.coalesce(c(x), F.lit(0).cast(cust.schema[x].dataType)) for x in extra})


def rule_scores(features: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Seven weighted rule scores, their sum and the sum relative to the population maximum."""
    f = cfg.fraud
    cols = {}
    for name, feature, thr, weight, floor in RULES:
        limit = getattr(f, thr)
        span = limit - floor
        x = F.col(feature)
        part = clip01((x - floor) / span) if span > 0 else F.least(x / limit, F.lit(1.0))
        cols[f"score_{name}"] = part * getattr(f, weight)
    df = features.withColumns(cols)
    df = df.withColumn("rule_fraud_score", sum((F.col(c) for c in cols), F.lit(0.0)))
    return scale_by_max(df, "rule_fraud_score", "rule_fraud_score_norm")


def scale_by_max(df: DataFrame, column: str, name: str) -> DataFrame:
    top = df.agg(F.max(column).alias("m")).scalar()
    return df.withColumn(name, F.when(top > 0, F.col(column) / top).otherwise(F.col(column)))


def min_max(df: DataFrame, columns: list[str], invert: bool = False, suffix: str = "_scaled") -> DataFrame:
    """(x - min) / (max - min) per column over the whole frame, zeros for a constant column."""
    s = one_row(df.agg(*[g(c).alias(f"{p}_{c}") for c in columns for p, g in (("lo", F.min), ("hi", F.max))]))
    d = df.withColumn("_s", s)
    def scaled(c):
        lo, hi = F.col(f"_s.lo_{c}"), F.col(f"_s.hi_{c}")
        part = safe_divide(F.col(c) - lo, hi - lo)
        return F.when(F.col(c).isNull(), None).otherwise(F.coalesce(1 - part if invert else part, F.lit(0.0)))
    return d.withColumns({c + suffix: scaled(c) for c in columns}).drop("_s")


def rule_contributions(scored: DataFrame) -> DataFrame:
    names = [f"score_{r[0]}" for r in RULES]
    wide = scored.agg(*[F.avg(c).alias(c) for c in names])
    return wide.unpivot([], names, "rule", "mean_score")


def score_histogram(scored: DataFrame, column: str = "rule_fraud_score_norm", bins: int = 5) -> DataFrame:
    b = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.count("*").alias("customers"))


def risk_tier(score, cfg: Config = DEFAULT):
    f = cfg.fraud
    return ladder((score >= f.tier_critical, "Critical"), (score >= f.tier_high, "High"), (score >= f.tier_medium, "Medium"), default="Low")


def tier_order(tier):
    """Sort key of the tiers in business order; totals come last."""
    return F.array_position(F.array(*[F.lit(t) for t in ("Critical", "High", "Medium", "Low", "All")]), tier)


def assign_risk_tiers(df: DataFrame, cfg: Config = DEFAULT, score: str = "composite_fraud_score") -> DataFrame:
    return df.withColumn("risk_tier", risk_tier(F.col(score), cfg))


def composite_score(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Blend of rule, isolation and neighbour scores relative to its maximum, with tiers."""
    f = cfg.fraud
    blend = (
        f.blend_rule * F.col("rule_fraud_score_norm") + f.blend_isolation * F.col("iso_anomaly_score") + f.blend_lof * F.col("lof_anomaly_score")
    )
    return assign_risk_tiers(scale_by_max(df.withColumn("_blend", blend), "_blend", "composite_fraud_score").drop("_blend"), cfg)


def typology(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    f, c = cfg.fraud, F.col
    flags = {
        "type_return_abuser": c("return_rate") >= f.return_rate_high,
        "type_discount_exploiter": (c("max_discount_rate") >= f.discount_rate_high) & (c("avg_discount") > f.avg_discount_floor),
        "type_velocity": c("velocity_burst_flag") == 1,
        "type_margin_exploiter": c("negative_margin_rate") >= f.negative_margin_rate_high,
        "type_high_value": c("high_value_rate_p99") > f.high_value_p99_rate,
    }
    d = df.withColumns({k: v.cast("int") for k, v in flags.items()})
    d = d.withColumn("typology_count", sum((c(k) for k in flags), F.lit(0)))
    d = d.withColumn("type_combined", (c("typology_count") >= 3).cast("int"))
    first = ladder((c("type_combined") == 1, "Combined Attack"), *[(c(k) == 1, label) for k, label in TYPOLOGIES], default="Unclassified")
    return d.withColumn("primary_typology", first)


def high_risk_transactions(tx: DataFrame, profile: DataFrame) -> DataFrame:
    return tx.join(profile.where(F.col("risk_tier").isin("Critical", "High")).select("customer_id"), "customer_id", "left_semi")


def exposure(tx: DataFrame, profile: DataFrame) -> DataFrame:
    """One row: each order in exactly one bucket, for high-risk customers and for all, in one pass.

    The orders are summed per customer before the tier is joined on.
    """
    c = F.col
    back, disc, neg = c("returned") == 1, c("discount") > 0, c("profit_margin") < 0
    per = tx.groupBy("customer_id").agg(
        F.sum(F.when(back, money_units(c("total_amount")))).alias("ret"),
        F.sum(F.when(~back & disc, money_units(c("price") * c("quantity") * c("discount")))).alias("dis"),
        F.sum(F.when(~back & (c("discount") == 0) & neg, money_units(-c("profit_margin")))).alias("mar"),
        F.sum(money_units(c("total_amount"))).alias("rev"),
        count_if(back & disc).alias("o1"), count_if(back & neg).alias("o2"), count_if(~back & disc & neg).alias("o3"),
    )
    p = profile.select("customer_id", F.col("risk_tier").isin("Critical", "High").cast("int").alias("hot"))
    j = per.join(p, "customer_id", "left")
    hot = c("hot") == 1
    money = lambda x, cond=None: F.coalesce(F.sum(x if cond is None else F.when(cond, x)).cast("double") / MONEY_SCALE, F.lit(0.0))
    out = j.agg(
        count_if(hot).alias("high_risk_customers"), F.count("hot").alias("_n"), money(c("rev"), hot).alias("revenue_high_risk"), money(c("rev")).alias("_rev"),
        money(c("ret"), hot).alias("return_exposure_high_risk"), money(c("dis"), hot).alias("discount_exposure_high_risk"), money(c("mar"), hot).alias("neg_margin_exposure_high_risk"),
        money(c("ret")).alias("return_exposure_all"), money(c("dis")).alias("discount_exposure_all"), money(c("mar")).alias("neg_margin_exposure_all"),
        *[F.coalesce(F.sum(F.when(hot, c(o))), F.lit(0)).alias(n) for o, n in (("o1", "overlap_return_discount"), ("o2", "overlap_return_negmargin"), ("o3", "overlap_discount_negmargin"))],
    )
    out = out.withColumns({
        "high_risk_pct": safe_divide(c("high_risk_customers") * 100.0, c("_n"), 0.0),
        "revenue_high_risk_pct": safe_divide(c("revenue_high_risk") * 100.0, c("_rev"), 0.0),
        "total_exposure_high_risk": c("return_exposure_high_risk") + c("discount_exposure_high_risk") + c("neg_margin_exposure_high_risk"),
        "total_exposure_all": c("return_exposure_all") + c("discount_exposure_all") + c("neg_margin_exposure_all"),
        "total_overlap_orders": c("overlap_return_discount") + c("overlap_return_negmargin") + c("overlap_discount_negmargin"),
    })
    return out.drop("_n", "_rev")


def crosstab(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """Counts of two labels with row, column and grand totals ('All'), and the row percentage."""
    g = df.cube(rows, cols).agg(F.count("*").alias("customers"), F.grouping(rows).alias("_a"), F.grouping(cols).alias("_b"))
    g = g.select(
        F.when(F.col("_a") == 1, "All").otherwise(F.col(rows)).alias(rows), F.when(F.col("_b") == 1, "All").otherwise(F.col(cols)).alias(cols), "customers"
    )
    total = F.max(F.when(F.col(cols) == "All", F.col("customers"))).over(Window.partitionBy(rows))
    g = g.withColumn("row_pct", F.col("customers") * 100.0 / total)
    return g.orderBy(rows, tier_order(F.col(cols)), cols)


def join_risk_labels(profile: DataFrame, segments: DataFrame, churn: DataFrame | None = None) -> DataFrame:
    """Risk profile with segment name ('Unknown' when absent) and churn prediction, one row per customer."""
    s = segments.groupBy("customer_id").agg(F.min("segment_name").alias("segment_name"))
    j = profile.select("customer_id", "composite_fraud_score", "risk_tier", "primary_typology").join(s, "customer_id", "left")
    j = j.withColumn("segment_name", F.coalesce("segment_name", F.lit("Unknown")))
    if churn is None:
        return j.withColumn("churn_probability", F.lit(None).cast("double")).withColumn("churn_risk_level", F.lit(None).cast("string"))
    c = churn.groupBy("customer_id").agg(F.max("churn_probability").alias("churn_probability"), F.min("risk_level").alias("churn_risk_level"))
    return j.join(c, "customer_id", "left")


def segment_fraud(merged: DataFrame) -> DataFrame:
    """Per segment: customers, mean score, share of High and Critical, mean churn probability, double risk."""
    top = F.col("risk_tier").isin("Critical", "High")
    return merged.groupBy("segment_name").agg(
        F.count("*").alias("customers"), F.round(F.avg("composite_fraud_score"), 4).alias("avg_fraud_score"),
        F.round(share(top) * 100, 4).alias("high_critical_pct"), F.round(F.avg("churn_probability"), 4).alias("avg_churn_prob"),
        count_if(top & (F.col("churn_risk_level") == "High")).alias("double_risk_count"),
    ).orderBy(F.desc("avg_fraud_score"))


def tier_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """Per tier: customers, share, feature means and each mean relative to the largest tier mean."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    g = df.groupBy("risk_tier").agg(F.count("*").alias("customers"), *[F.avg(f).alias(f"avg_{f}") for f in features])
    every = Window.partitionBy(F.lit(1))  # four tiers
    g = g.withColumn("pct", F.col("customers") * 100.0 / n)
    return g.withColumns({f"radar_{f}": safe_divide(F.col(f"avg_{f}"), F.max(f"avg_{f}").over(every), 0.0) for f in features})


def feature_summary(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean, median, std, population skewness and P95 per feature; quantiles are exact."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot([], features, "feature", "value")
    m = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.skewness("value").alias("skewness"))
    return m.join(quantiles(long, "value", {"median": 0.5, "p95": 0.95}, by=["feature"]), "feature")


def top_risk_customers(df: DataFrame, features: list[str], n: int = 50, score: str = "composite_fraud_score") -> DataFrame:
    """The n largest scores (a top-n report) with features scaled over the selection."""
    top = df.orderBy(F.desc(score), "customer_id").limit(n).select("customer_id", score, *features)
    w = Window.partitionBy(F.lit(1))  # n rows
    scaled = {f: safe_divide(F.col(f) - F.min(f).over(w), F.max(f).over(w) - F.min(f).over(w), 0.0) for f in features}
    return top.select("customer_id", score, *[v.alias(f) for f, v in scaled.items()])


# Columns of the stored risk profile, in order.
PROFILE_COLUMNS = (
    "customer_id", "composite_fraud_score", "rule_fraud_score_norm", "iso_anomaly_score", "lof_anomaly_score",
    "ensemble_anomaly_score", "risk_tier", "primary_typology", "return_rate", "max_discount_rate",
    "negative_margin_rate", "velocity_burst_flag", "max_orders_7d", "high_value_rate_p95", "category_hhi",
    "order_value_cv", "type_return_abuser", "type_discount_exploiter", "type_velocity", "type_margin_exploiter",
    "type_high_value", "type_combined", "typology_count", "iso_anomaly_flag", "lof_anomaly_flag", "both_models_flag",
)


# Action and review time by tier.
INTERVENTIONS = (("Critical", "manual_verification", 24), ("High", "priority_review", 72), ("Medium", "enhanced_monitoring", 168))


def interventions(profile: DataFrame) -> DataFrame:
    """Customers per tier and typology with the tier's action, for tiers that call for one."""
    dim = profile.sparkSession.createDataFrame(list(INTERVENTIONS), "risk_tier string, action string, review_hours int")
    g = profile.groupBy("risk_tier", "primary_typology").agg(F.count("*").alias("customers"), F.avg("composite_fraud_score").alias("avg_score"))
    return g.join(dim, "risk_tier")
