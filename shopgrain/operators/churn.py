"""Point-in-time churn datasets, risk levels and campaign numbers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, Config
from ..functions.expr import MONEY_SCALE, count_if, money_sum, money_units, one_row, safe_divide
from ..functions.ranks import quantiles, value_ranks
from ..session import materialized

# Feature sets by strategy (recency_days always comes first).
FEATURE_SETS = {
    "base": ("frequency", "monetary", "tenure_days", "category_diversity", "last_order_was_return", "return_rate", "discount_usage_rate"),
    "composite": ("loyalty_score", "tenure_days", "category_diversity", "last_order_was_return", "return_rate", "discount_usage_rate"),
    "all": ("frequency", "monetary", "net_monetary", "avg_order_value", "tenure_days", "loyalty_score",
            "discount_usage_rate", "category_diversity", "return_rate", "last_order_was_return"),
}


def feature_columns(strategy: str, available: list[str] | None = None) -> list[str]:
    if strategy not in FEATURE_SETS:
        raise ValueError(f"unknown feature strategy {strategy!r}; one of {sorted(FEATURE_SETS)}")
    cols = ["recency_days", *FEATURE_SETS[strategy]]
    return cols if available is None else [c for c in cols if c in available]


def resolve_cutoff(tx: DataFrame, cfg: Config = DEFAULT) -> dt.date:
    """The configured cutoff, else the latest order date minus the observation window.

    One date reaches the driver, so that every later filter is a literal the scan can use.
    """
    if cfg.churn.cutoff_date:
        return dt.date.fromisoformat(cfg.churn.cutoff_date)
    last = tx.agg(F.max("order_date")).first()[0]
    return last - dt.timedelta(days=cfg.churn.observation_days)


def pre_cutoff(tx: DataFrame, cutoff: dt.date, lookback_days: int | None = None) -> DataFrame:
    out = tx.where(F.col("order_date") <= F.lit(cutoff))
    if lookback_days is not None:
        out = out.where(F.col("order_date") >= F.lit(cutoff - dt.timedelta(days=lookback_days)))
    return out


def observation_window(tx: DataFrame, cutoff: dt.date) -> DataFrame:
    return tx.where(F.col("order_date") > F.lit(cutoff))


def recency_at_cutoff(tx: DataFrame, cutoff: dt.date) -> DataFrame:
    return pre_cutoff(tx, cutoff).groupBy("customer_id").agg(
        F.datediff(F.lit(cutoff), F.max("order_date")).alias("recency_days")
    )


def with_history(customers: DataFrame, tx: DataFrame, cutoff: dt.date, min_orders: int = 1) -> DataFrame:
    """Customers with at least ``min_orders`` orders up to the cutoff."""
    enough = pre_cutoff(tx, cutoff).groupBy("customer_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_orders)
    return customers.join(enough, "customer_id", "left_semi")


def churn_labels(customers: DataFrame, tx: DataFrame, cutoff: dt.date) -> DataFrame:
    """1 for customers without an order after the cutoff, else 0."""
    active = observation_window(tx, cutoff).select("customer_id").distinct().withColumn("_on", F.lit(1))
    return customers.select("customer_id").join(active, "customer_id", "left").select(
        "customer_id", F.when(F.col("_on").isNull(), 1).otherwise(0).alias("churn")
    )


def cutoff_features(tx: DataFrame, cutoff: dt.date, cfg: Config = DEFAULT, amount: str = "total_amount") -> DataFrame:
    """Features known at the cutoff plus the label, in one aggregate over all orders.

    Frequency and monetary count every order, returned or not, in the lookback; tenure and recency
    use the whole history. The label comes from the same pass, so there is no join.
    """
    c, d = F.col, F.col("order_date")
    before = d <= F.lit(cutoff)
    back = cfg.churn.lookback_days
    seen = before if back is None else before & (d >= F.lit(cutoff - dt.timedelta(days=back)))
    units = money_units(c(amount))
    g = tx.groupBy("customer_id").agg(
        count_if(before).alias("_history"), count_if(seen).alias("frequency"),
        F.datediff(F.lit(cutoff), F.min(F.when(before, d))).alias("tenure_days"),
        F.datediff(F.lit(cutoff), F.max(F.when(before, d))).alias("recency_days"),
        F.datediff(F.lit(cutoff), F.max(F.when(seen, d))).alias("_recent"),
        F.coalesce(F.sum(F.when(seen, units)).cast("double") / MONEY_SCALE, F.lit(0.0)).alias("monetary"),
        F.coalesce(F.sum(F.when(seen & (c("returned") == 1), units)).cast("double") / MONEY_SCALE, F.lit(0.0)).alias("_back"),
        F.size(F.collect_set(F.when(seen, c("category")))).cast("bigint").alias("category_diversity"),
        F.coalesce(F.avg(F.when(seen, c("returned"))), F.lit(0.0)).alias("return_rate"),
        F.coalesce(F.max_by("returned", F.when(seen, F.struct("order_date", "order_id"))), F.lit(0)).alias("last_order_was_return"),
        F.coalesce(F.avg(F.when(seen, (c("discount") > 0).cast("int"))), F.lit(0.0)).alias("discount_usage_rate"),
        (1 - F.max((d > F.lit(cutoff)).cast("int"))).alias("churn"),
    ).where(c("_history") >= cfg.churn.min_orders)
    return g.withColumn("net_monetary", c("monetary") - c("_back")).withColumn(
        "avg_order_value", F.try_divide("monetary", c("frequency").cast("double"))
    ).drop("_history", "_back")


def min_max_loyalty(df: DataFrame, fit_on: DataFrame, recency: str = "recency_days", name: str = "loyalty_score") -> DataFrame:
    """Mean of min-max scaled 1/(recency+1), frequency and monetary, scaled by ``fit_on`` only."""
    inv = lambda: 1.0 / (F.coalesce(F.col(recency), F.lit(999)) + 1)
    parts = {"r": inv(), "f": F.col("frequency").cast("double"), "m": F.coalesce("monetary", F.lit(0.0))}
    s = one_row(fit_on.agg(*[g(v).alias(f"{p}{k}") for k, v in parts.items() for p, g in (("lo", F.min), ("hi", F.max))]))
    d = df.withColumn("_s", s)
    scaled = [safe_divide(v - F.col(f"_s.lo{k}"), F.col(f"_s.hi{k}") - F.col(f"_s.lo{k}"), 0.0) for k, v in parts.items()]
    return d.withColumn(name, sum(scaled[1:], scaled[0]) / 3).drop("_s")


def split_hash(key: Column, seed: int) -> Column:
    """48 bits of the MD5 of "key:seed": a number that other engines can compute too, and that a double holds exactly."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 12), 16, 10).cast("bigint")


def stratified_split(df: DataFrame, label: str = "churn", cfg: Config = DEFAULT) -> DataFrame:
    """Adds is_train: per label, the floor(test share * n) smallest key hashes are the test rows.

    The cut per label is an exact order statistic of the hash, found without sorting a label's rows
    in one task; the split is the same in every run.
    """
    h = df.withColumn("_h", split_hash(F.col("customer_id"), cfg.churn.seed))
    r = value_ranks(h.select(label, "_h"), "_h", by=[label])
    k = F.floor(F.col("total") * cfg.churn.test_size)
    cuts = r.groupBy(label).agg(F.max(F.when(F.col("before") + F.col("n") <= k, F.col("_h"))).alias("_cut"))
    pick = one_row(cuts.agg(*[F.max(F.when(F.col(label) == v, F.col("_cut"))).alias(f"c{v}") for v in (0, 1)]))
    h = h.withColumn("_p", pick)
    cut = F.when(F.col(label) == 0, F.col("_p.c0")).otherwise(F.col("_p.c1"))
    return h.withColumn("is_train", ~F.coalesce(F.col("_h") <= cut, F.lit(False))).drop("_h", "_p")


def churn_dataset(tx: DataFrame, cfg: Config = DEFAULT, strategy: str = "base") -> DataFrame:
    """customer_id, churn, is_train, the strategy's features and monetary as context.

    The features are written once: the split, the scaling and the result all read them.
    """
    cutoff = resolve_cutoff(tx, cfg)
    data = stratified_split(materialized(cutoff_features(tx, cutoff, cfg)), cfg=cfg)
    data = min_max_loyalty(data, data.where("is_train"))
    cols = feature_columns(strategy)
    context = [c for c in ("monetary",) if c not in cols]
    return data.select("customer_id", "churn", "is_train", *cols, *context)


def risk_levels(pred: DataFrame, cfg: Config = DEFAULT, method: str = "quantile", score: str = "churn_probability") -> DataFrame:
    """Low / Medium / High by right-closed cuts; equal cuts are nudged apart."""
    c = cfg.churn
    if method == "quantile":
        q = quantiles(pred, score, {"lo": c.quantile_low, "hi": c.quantile_high})
    else:
        q = pred.sparkSession.range(1).select(F.lit(c.threshold_low).alias("lo"), F.lit(c.threshold_high).alias("hi"))
    mid = (F.col("lo") + F.col("hi")) / 2
    eps = F.greatest(F.lit(1e-6), mid * 1e-4)
    flat = F.col("lo") >= F.col("hi")
    q = q.select(F.when(flat, mid - eps).otherwise(F.col("lo")).alias("lo"), F.when(flat, mid + eps).otherwise(F.col("hi")).alias("hi"))
    d = pred.withColumn("_q", one_row(q))
    v = F.col(score)
    return d.withColumn("risk_level", F.when(v <= F.col("_q.lo"), "Low").when(v <= F.col("_q.hi"), "Medium").when(v.isNotNull(), "High")).drop("_q")


def risk_summary(risk: DataFrame, score: str = "churn_probability") -> DataFrame:
    return risk.groupBy("risk_level").agg(
        F.count("*").alias("customers"), F.avg(score).alias("avg_probability"), F.avg("churn").alias("actual_churn"),
        money_sum(F.col("monetary")).alias("revenue"),
    )


def campaign_sizing(risk: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per level: customers, revenue at risk, mean revenue, expected saved revenue, cost and their difference."""
    c = cfg.churn
    keep = F.when(F.col("risk_level") == "High", c.retention_high).when(F.col("risk_level") == "Medium", c.retention_medium).otherwise(c.retention_low)
    g = risk.groupBy("risk_level").agg(F.count("*").alias("customers"), money_sum(F.col("monetary")).alias("revenue_at_risk"))
    g = g.withColumn("avg_revenue", safe_divide(F.col("revenue_at_risk"), F.col("customers"), 0.0))
    return g.withColumns({
        "expected_saved": F.col("revenue_at_risk") * keep, "campaign_cost": F.col("revenue_at_risk") * c.campaign_cost_pct,
        "net_benefit": F.col("revenue_at_risk") * keep - F.col("revenue_at_risk") * c.campaign_cost_pct,
    })


def campaign_mix(risk: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments within each level with their share."""
    s = segments.groupBy("customer_id").agg(F.min("segment_name").alias("segment_name"))
    g = risk.join(s, "customer_id", "left").groupBy("risk_level", F.coalesce("segment_name", F.lit("Unknown")).alias("segment_name")).agg(F.count("*").alias("customers"))
    return g.withColumn("pct", F.col("customers") * 100.0 / F.sum("customers").over(Window.partitionBy("risk_level")))


def segment_churn(labels: DataFrame, segments: DataFrame, segment: str = "segment_name") -> DataFrame:
    """Actual churn rate per segment, largest first."""
    s = segments.groupBy("customer_id").agg(F.min(segment).alias(segment))
    g = labels.join(s, "customer_id").groupBy(segment).agg(F.count("*").alias("customers"), F.avg("churn").alias("churn_rate"))
    return g.orderBy(F.desc("churn_rate"))


def pick_strategy(results: DataFrame) -> DataFrame:
    """The best F1 among strategies that pass the VIF check, else the best F1. A one-row choice."""
    return results.orderBy(F.desc(F.col("vif_pass").cast("int")), F.desc("f1"), "strategy").limit(1)
