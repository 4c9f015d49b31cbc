"""RFM scores, rule segments, risk bands, loyalty tiers and cluster profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT, Config
from ..functions.expr import count_if, ladder, money_sum, one_row, safe_divide, to_rows
from ..functions.ranks import quantiles, quantiles_of_ranks, value_ranks

SCORES = ("recency_score", "frequency_score", "monetary_score")


# Metric, score column, whether larger is better.
_METRICS = (("recency_days", "recency_score", False), ("frequency", "frequency_score", True), ("monetary", "monetary_score", True))


def score_cuts(cust: DataFrame) -> DataFrame:
    """One row with the value cuts between the scores of each metric and the score of a null.

    Scores come from average-tie percentile ranks after nulls take the median. Ranks are monotone in
    the value, so four cuts per metric say everything: no rank has to be joined back to a customer.
    """
    names = [m for m, _, _ in _METRICS]
    v = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c).cast("double"))
    long = cust.select(*[v(c).alias(c) for c in names]).unpivot([], names, "_m", "_v")
    r = value_ranks(long, "_v", by=["_m"])
    med = quantiles_of_ranks(r, "_v", {"med": 0.5}, by=["_m"])
    nulls = long.groupBy("_m").agg(count_if(F.col("_v").isNull()).alias("_nulls"))
    j = r.join(med.join(nulls, "_m"), "_m")
    up = F.col("_m") != "recency_days"
    c = F.col
    n = c("n") + F.when(c("_v") == c("med"), c("_nulls")).otherwise(0)
    before = c("before") + F.when(c("_v") > c("med"), c("_nulls")).otherwise(0)
    size = c("total") + c("_nulls")

    def score(before, n):
        mid = before + (n + 1) / F.lit(2.0)
        return F.least(F.greatest(F.ceil(F.when(up, mid).otherwise(size + 1 - mid) / size * 5), F.lit(1)), F.lit(5)).cast("int")

    j = j.withColumn("_s", score(before, n))
    edge = lambda k: F.when(F.first("_up"), F.max(F.when(c("_s") <= k, c("_v")))).otherwise(F.min(F.when(c("_s") <= k, c("_v"))))
    per = j.withColumn("_up", up).groupBy("_m", "med", "_nulls", "total").agg(
        F.array(*[edge(k) for k in (1, 2, 3, 4)]).alias("cuts"),
        F.coalesce(F.sum(F.when(c("_v") < c("med"), c("n"))), F.lit(0)).alias("_b"),
        F.coalesce(F.max(F.when(c("_v") == c("med"), c("n"))), F.lit(0)).alias("_n"),
    ).withColumn("null_score", score(c("_b"), c("_n") + c("_nulls")))
    pick = lambda m, x: F.max(F.when(c("_m") == m, c(x)))
    return per.agg(*[pick(m, x).alias(f"{x}_{m}") for m in names for x in ("cuts", "null_score")])


def rfm_scores(cust: DataFrame) -> DataFrame:
    """Adds recency, frequency and monetary scores (1..5, 5 is best)."""
    df = cust.withColumn("_c", one_row(score_cuts(cust)))
    out = {}
    for metric, name, up in _METRICS:
        v, cuts = F.col(metric).cast("double"), F.col(f"_c.cuts_{metric}")
        steps = [F.coalesce((v > cuts[k]) if up else (v < cuts[k]), F.lit(True)).cast("int") for k in range(4)]
        finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        out[name] = F.when(finite, sum(steps, F.lit(1))).otherwise(F.col(f"_c.null_score_{metric}"))
    return df.withColumns(out).drop("_c")


def ensure_rfm_scores(cust: DataFrame) -> DataFrame:
    return cust if all(s in cust.columns for s in SCORES) else rfm_scores(cust)


def rfm_segments(scored: DataFrame) -> DataFrame:
    """Rule segment by first match; two labels of the ladder are shadowed by earlier branches."""
    r, f, m = (F.col(s) for s in SCORES)
    label = ladder(
        ((r == 5) & (f == 5) & (m == 5), "Champions"),
        ((f >= 4) & (m >= 4), "Loyal Customers"),
        ((r >= 4) & (f >= 3), "Potential Loyalists"),
        ((r == 5) & (f <= 2), "New Customers"),
        ((r <= 2) & ((f >= 3) | (m >= 3)), "At Risk"),
        ((r <= 2) & (f >= 4) & (m >= 4), "Can't Lose Them"),
        ((r <= 2) & (f <= 2) & (m <= 2), "Hibernating"),
        ((r == 1) & (f == 1) & (m == 1), "Lost"),
        default="Others",
    )
    return scored.withColumn("rfm_string", F.concat(*[F.col(s).cast("string") for s in SCORES])).withColumn("rfm_segment", label)


def segment_profile(df: DataFrame, segment: str = "rfm_segment") -> DataFrame:
    return df.groupBy(segment).agg(
        F.round(F.avg("recency_days"), 2).alias("avg_recency"), F.round(F.avg("frequency"), 2).alias("avg_frequency"),
        F.round(F.avg("monetary"), 2).alias("avg_monetary"), F.round(F.avg("loyalty_score"), 2).alias("avg_loyalty"),
        F.count("customer_id").alias("customers"),
    ).orderBy(F.desc("customers"))


def score_distribution(scored: DataFrame) -> DataFrame:
    """Customers and share per score value of the three scores."""
    long = scored.select(*SCORES).unpivot([], list(SCORES), "score_name", "score")
    n = scored.agg(F.count(F.lit(1)).alias("n")).scalar()
    return long.groupBy("score_name", "score").agg(F.count("*").alias("customers")).withColumn(
        "pct", F.col("customers") * 100.0 / n
    )


def churn_risk_band(recency, cfg: Config = DEFAULT):
    s = cfg.segment
    return ladder((recency <= s.risk_active, "Active"), (recency <= s.risk_at_risk, "At Risk"), (recency <= s.risk_inactive, "Inactive"), default="Churned")


def with_churn_risk(cust: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return cust.withColumn("churn_risk", churn_risk_band(F.col("recency_days"), cfg))


def churn_risk_distribution(df: DataFrame, segment: str, cfg: Config = DEFAULT) -> DataFrame:
    """Counts and shares of risk bands per segment, with the dominant band (ties by name)."""
    g = with_churn_risk(df, cfg).groupBy(segment, "churn_risk").agg(F.count("*").alias("customers"))
    w = Window.partitionBy(segment)  # at most four bands per segment
    top = F.first("churn_risk").over(w.orderBy(F.desc("customers"), "churn_risk"))
    return g.withColumn("pct", F.col("customers") * 100.0 / F.sum("customers").over(w)).withColumn("dominant_risk", top)


def loyalty_tiers(cust: DataFrame, cfg: Config = DEFAULT, score: str = "loyalty_score") -> DataFrame:
    """Equal-frequency tiers from exact quantile edges; equal edges collapse and drop the top labels."""
    labels = cfg.segment.loyalty_labels
    k = len(labels)
    q = quantiles(cust, score, {f"e{i}": i / k for i in range(k + 1)})
    edges = one_row(q.select(F.array_sort(F.array_distinct(F.array(*[F.col(f"e{i}") for i in range(k + 1)]))).alias("e")))
    d = cust.withColumn("_e", edges.getField("e"))
    # Right-closed bins, the lowest edge included: the bin is the number of inner edges below the value.
    below = F.size(F.filter("_e", lambda e: e < F.col(score)))
    bin_no = F.greatest(below, F.lit(1))
    names = F.array(*[F.lit(x) for x in labels])
    return d.withColumn("loyalty_tier", F.when(F.col(score).isNotNull(), F.get(names, bin_no - 1))).drop("_e")


def attach_labels(cust: DataFrame, labels: DataFrame, column: str = "cluster") -> DataFrame:
    """Inner join of cluster labels; a stale label column is dropped first."""
    return cust.drop(column).join(labels.select("customer_id", column), "customer_id")


def cluster_profiles(df: DataFrame, segment: str = "cluster", cfg: Config = DEFAULT) -> DataFrame:
    """One row per cluster: size, mean and exact median R/F/M, revenue, mean scores, risk shares."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    band = lambda b: F.avg((churn_risk_band(F.col("recency_days"), cfg) == b).cast("int")) * 100
    g = df.groupBy(segment).agg(
        F.count("*").alias("customers"), F.avg("recency_days").alias("avg_recency"), F.avg("frequency").alias("avg_frequency"),
        F.avg("monetary").alias("avg_monetary"), money_sum(F.col("monetary")).alias("total_revenue"),
        *[F.avg(s).alias(f"avg_{s}") for s in SCORES],
        F.avg("loyalty_score").alias("avg_loyalty"), F.avg("avg_order_value").alias("avg_order_value"),
        (F.avg("return_rate") * 100).alias("avg_return_rate"), (F.avg("discount_usage_rate") * 100).alias("avg_discount_usage"),
        band("Active").alias("active_pct"), band("At Risk").alias("at_risk_pct"),
        band("Inactive").alias("inactive_pct"), band("Churned").alias("churned_pct"),
    ).withColumn("share_pct", F.col("customers") * 100.0 / n)
    names = ["recency_days", "frequency", "monetary"]
    long = df.select(segment, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([segment], names, "_c", "_v")
    med = quantiles(long, "_v", {"m": 0.5}, by=[segment, "_c"]).groupBy(segment).agg(
        *[F.max(F.when(F.col("_c") == c, F.col("m"))).alias(f"median_{c}") for c in names]
    )
    out = g.join(med, segment)
    top = F.greatest("active_pct", "at_risk_pct", "inactive_pct", "churned_pct")
    dominant = ladder(
        (F.col("active_pct") == top, "Active"), (F.col("at_risk_pct") == top, "At Risk"),
        (F.col("churned_pct") == top, "Churned"), default="Inactive",
    )
    return out.withColumn("dominant_risk", dominant)


def segment_names(profiles: DataFrame, segment: str = "cluster") -> DataFrame:
    """Names by rule order on the profile rows; a repeated name gets a qualifier, then a counter."""
    c = F.col
    r, f, m = c("avg_recency_score"), c("avg_frequency_score"), c("avg_monetary_score")
    inactive = c("dominant_risk").isin("Inactive", "Churned") | (c("inactive_pct") + c("churned_pct") > 50)
    gone = (c("dominant_risk") == "Churned") | (c("churned_pct") > 50)
    name = ladder(
        ((m >= 4.5) & ((c("churned_pct") > 25) | (c("at_risk_pct") > 35) | (inactive & (m >= 4.8))), "High-Value at Risk"),
        ((r >= 4) & (f >= 4) & (m >= 4) & ~inactive, "Champions"),
        ((f >= 3.5) & (m >= 2.5) & (r >= 3) & ~inactive, "Loyal Customers"),
        ((m >= 3) & (m < 4.5) & (r <= 2.5) & inactive, "At-Risk"),
        ((r >= 4) & (f >= 2.5) & (f < 4), "Potential Loyalists"),
        ((r >= 4.5) & (f <= 2), "New Customers"),
        ((r <= 2) & (f <= 2) & (m <= 2) & gone, "Lost Customers"),
        ((r <= 2.5) & (f <= 2.5) & inactive, "Hibernating"),
        ((r <= 3) & (r > 2) & inactive, "About to Sleep"),
        ((r >= 3.5) & (m >= 2.5), "Promising"),
        ((r >= 2.5) & (f >= 2), "Needs Engagement"),
        default="Regular Customers",
    )
    qualifier = ladder((m >= 4.5, "Premium"), (f >= 4, "Frequent"), (r >= 4, "Recent"), (r <= 2, "Dormant"), default="Standard")
    priority = c("avg_monetary") * 0.4 + c("avg_frequency") * 200 + (5 - c("avg_recency") / 100) * 100
    p = profiles.withColumns({"_name": name, "_q": qualifier, "priority": priority})
    # One row per cluster: these windows see a handful of rows.
    p = p.withColumn("_k", F.row_number().over(Window.partitionBy("_name").orderBy(F.desc("priority"), segment)))
    again = (F.col("_k") > 1).cast("int")
    p = p.withColumn("_a", again).withColumn("_j", F.row_number().over(Window.partitionBy("_name", "_a", "_q").orderBy(F.desc("priority"), segment)))
    tail = F.when(c("_j") == 1, F.concat(F.lit(" ("), "_q", F.lit(")"))).otherwise(
        F.concat(F.lit(" ("), "_q", F.lit(" "), c("_j").cast("string"), F.lit(")")))
    full = F.when(c("_k") == 1, c("_name")).otherwise(F.concat("_name", tail))
    return p.withColumn("segment_name", full).drop("_name", "_q", "_k", "_a", "_j")


def segment_insight_flags(named: DataFrame) -> DataFrame:
    """Rule rows per segment (rule_id, fired, priority) on the profile metrics."""
    c = F.col
    r, f, m = c("avg_recency_score"), c("avg_frequency_score"), c("avg_monetary_score")
    gone = (c("dominant_risk") == "Churned") | (c("churned_pct") > 50)
    risk = (c("at_risk_pct") + c("churned_pct")) > 50
    total = F.sum("total_revenue").over(Window.partitionBy(F.lit(1)))  # one row per segment
    d = named.withColumn("revenue_pct", safe_divide(c("total_revenue") * 100, total, 0.0))
    lead = (m >= 3.5) & (gone | (c("churned_pct") > 30))
    best = ((r + f + m) / 3 >= 4) & (c("active_pct") > 60)
    fresh = (r >= 4.5) & (f <= 2)
    base = (r >= 4) & (f >= 3) & (c("active_pct") > 50)
    rules = [
        ("high_value_at_risk", lead, 10), ("revenue_disengaging", ~lead & risk & (c("revenue_pct") > 15), 9),
        ("best_customers", best, 8), ("new_customers", ~best & fresh, 7), ("reliable_base", ~best & ~fresh & base, 6),
        ("worth_recovering", ~best & ~fresh & ~base & gone & (m >= 3), 5), ("frequency_potential", (f < 3) & (m >= 3), 4),
        ("low_recovery_value", gone & (m < 3), 3),
    ]
    rows = [[F.lit(n), F.coalesce(x, F.lit(False)), F.lit(p)] for n, x, p in rules]
    return to_rows(d, rows, ["rule_id", "fired", "priority"], keep=["segment_name", "revenue_pct"])


def segment_comparison(tx: DataFrame, labels: DataFrame, segment: str) -> DataFrame:
    """Customers, revenue, mean order value and orders per segment over transactions.

    Transactions are reduced per customer before the label join, so the join carries one row per
    customer and no segment's rows meet in one task unaggregated.
    """
    per = tx.groupBy("customer_id").agg(
        F.sum(F.rint(F.col("total_amount") * 10_000.0).cast("decimal(28,0)")).alias("u"), F.count("*").alias("n")
    )
    one = labels.groupBy("customer_id").agg(F.min(segment).alias(segment))
    g = per.join(one, "customer_id", "left").groupBy(segment).agg(
        F.count("*").alias("customers"), (F.sum("u").cast("double") / 10_000.0).alias("revenue"), F.sum("n").alias("orders")
    )
    return g.withColumn("avg_order_value", F.try_divide("revenue", F.col("orders").cast("double")))


def segment_rfm_means(df: DataFrame, segment: str) -> DataFrame:
    return df.groupBy(segment).agg(
        F.count("*").alias("customers"), F.avg("recency_days").alias("avg_recency"), F.avg("frequency").alias("avg_frequency"),
        F.avg("monetary").alias("avg_monetary"), F.avg("loyalty_score").alias("avg_loyalty"),
    )


# Action and priority per segment name.
SEGMENT_ACTIONS = (
    ("Champions", "reward", 1), ("Loyal Customers", "upsell", 2), ("High-Value at Risk", "win_back", 1),
    ("At-Risk", "reactivate", 2), ("Potential Loyalists", "nurture", 3), ("New Customers", "onboard", 3),
    ("Promising", "nurture", 4), ("Needs Engagement", "engage", 4), ("About to Sleep", "reactivate", 4),
    ("Hibernating", "low_cost_reactivation", 5), ("Lost Customers", "low_cost_reactivation", 5),
)


def segment_actions(named: DataFrame) -> DataFrame:
    """Action attributes per named segment, from a fixed dimension of eleven rows."""
    dim = named.sparkSession.createDataFrame(list(SEGMENT_ACTIONS), "base_name string, action string, action_priority int")
    base = F.regexp_replace("segment_name", r" \(.*\)$", "")
    return named.withColumn("base_name", base).join(dim, "base_name", "left").select(
        "segment_name", "customers", "total_revenue", "action", "action_priority"
    )
