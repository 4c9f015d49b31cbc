"""Data-quality gates: every suite is one wide aggregate per table, turned into check rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..config import DEFAULT, Config
from ..functions.expr import any_of, count_if, money_sum, one_row, safe_divide, to_rows
from ..functions.ranks import quantiles_of_ranks, value_ranks

CHECK_COLUMNS = ["check_name", "status", "severity", "observed", "detail"]

# Columns that the quality suites require.
SALES_COLUMNS = (
    "order_id", "customer_id", "product_id", "category", "price", "discount", "quantity",
    "payment_method", "order_date", "delivery_time_days", "region", "returned", "total_amount", "profit_margin",
)
COHORT_COLUMNS = ("customer_id", "order_id", "order_date", "total_amount", "returned", "category")


class ContractError(ValueError):
    """A frame does not meet its contract."""


def missing_columns(df: DataFrame, required) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required, name: str = "frame") -> DataFrame:
    gone = missing_columns(df, required)
    if gone:
        raise ContractError(f"{name}: missing columns {gone}")
    return df


def check_kinds(df: DataFrame, required: dict[str, str]) -> list[str]:
    """Problems with presence or type family ('numeric', 'datetime', 'any') of columns."""
    problems = []
    for c, kind in required.items():
        if c not in df.columns:
            problems.append(f"{c}: missing")
            continue
        t = df.schema[c].dataType
        if kind == "numeric" and not isinstance(t, T.NumericType):
            problems.append(f"{c}: not numeric")
        if kind == "datetime" and not isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            problems.append(f"{c}: not a date")
    return problems


def _rules() -> list[tuple[str, str, object]]:
    c = F.col
    return [
        ("price", "ge_0", c("price") < 0),
        ("discount", "ge_0", c("discount") < 0),
        ("discount", "le_1", c("discount") > 1),
        ("quantity", "ge_1", c("quantity") < 1),
        ("total_amount", "ge_0", c("total_amount") < 0),
        ("shipping_cost", "ge_0", c("shipping_cost") < 0),
        ("customer_age", "ge_18", c("customer_age") < 18),
        ("delivery_time_days", "ge_0", c("delivery_time_days") < 0),
    ]


def schema_violations(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows (column_name, rule, violations) of the declared nullability and range rules."""
    items = [(f.name, "not_null", F.col(f.name).isNull()) for f in schema.fields if not f.nullable and f.name in df.columns]
    items += [r for r in _rules() if r[0] in df.columns]
    wide = df.agg(*[count_if(cond).alias(f"v{i}") for i, (_, _, cond) in enumerate(items)])
    return to_rows(
        wide, [[F.lit(col), F.lit(rule), F.col(f"v{i}")] for i, (col, rule, _) in enumerate(items)],
        ["column_name", "rule", "violations"],
    )


def enforce_schema(df: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Raise on a column or value violation; returns ``df`` when all rules hold."""
    want, have = set(schema.fieldNames()), set(df.columns)
    if want - have or (strict and have - want):
        raise ContractError(f"columns: missing {sorted(want - have)}, unexpected {sorted(have - want)}")
    bad = schema_violations(df, schema).where("violations > 0").collect()
    if bad:
        raise ContractError("; ".join(f"{r.column_name} {r.rule}: {r.violations} rows" for r in bad))
    return df


def _check_rows(wide: DataFrame, checks: list[tuple[str, str, object, object]]) -> DataFrame:
    """checks: (name, severity, observed, passed) over the one-row frame ``wide``."""
    rows = []
    for name, severity, observed, passed in checks:
        ok = F.coalesce(passed, F.lit(False))
        rows.append([
            F.lit(name), F.when(ok, "PASS").otherwise("FAIL" if severity == "error" else "WARN"),
            F.lit(severity), observed.cast("double"),
        ])
    return to_rows(wide, rows, ["check_name", "status", "severity", "observed"])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """One row: rows beyond the first of each key. Counting per key keeps it a two-step aggregate."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count("*").alias("keys"),
    )


def sanity_checks(tx: DataFrame, cust: DataFrame | None = None, expected: dict | None = None) -> DataFrame:
    """The transaction (and customer) suite as check rows. ``expected``: rows, customers, start, end."""
    exp = expected or {}
    c = F.col
    off = F.abs(c("total_amount") - c("price") * c("quantity") * (1 - c("discount"))) > 0.01
    columns_with_nulls = sum((F.max(c(x).isNull().cast("int")) for x in tx.columns), F.lit(0))
    wide = tx.agg(
        F.count(F.lit(1)).alias("rows"), columns_with_nulls.alias("null_columns"),
        count_if(c("price") <= 0).alias("price"), count_if((c("discount") < 0) | (c("discount") > 1)).alias("discount"),
        count_if(c("quantity") <= 0).alias("quantity"), count_if(c("total_amount") <= 0).alias("amount"),
        count_if(~c("returned").isin(0, 1) | c("returned").isNull()).alias("returned"),
        count_if((c("customer_age") < 18) | (c("customer_age") > 120)).alias("age"),
        F.min("order_date").alias("start"), F.max("order_date").alias("end"),
        count_if(off).alias("off"), count_if(c("profit_margin") > c("total_amount") * 10).alias("margin"),
        count_if(c("shipping_cost") > c("total_amount")).alias("shipping"),
    )
    wide = wide.withColumn("_o", one_row(duplicate_keys(tx, "order_id")))
    wide = wide.withColumn("_k", one_row(duplicate_keys(tx, "customer_id")))
    checks = [
        ("null_columns", "warning", c("null_columns"), c("null_columns") == 0),
        ("positive_price", "error", c("price"), c("price") == 0),
        ("discount_range", "error", c("discount"), c("discount") == 0),
        ("positive_quantity", "error", c("quantity"), c("quantity") == 0),
        ("positive_amount", "warning", c("amount"), c("amount") == 0),
        ("binary_returned", "error", c("returned"), c("returned") == 0),
        ("age_range", "warning", c("age"), c("age") == 0),
        ("amount_formula", "warning", c("off"), c("off") == 0),
        ("extreme_margin", "warning", c("margin"), c("margin") == 0),
        ("shipping_above_amount", "warning", c("shipping"), c("shipping") * 100.0 <= c("rows") * 2.0),
        ("unique_order_id", "error", c("_o.duplicates"), c("_o.duplicates") == 0),
    ]
    if "rows" in exp:
        checks.append(("row_count", "warning", c("rows"), c("rows") == exp["rows"]))
    if "customers" in exp:
        checks.append(("customer_count", "warning", c("_k.keys"), c("_k.keys") == exp["customers"]))
    if "start" in exp and "end" in exp:
        gap = F.abs(F.datediff(c("start"), F.lit(exp["start"]).cast("date"))) + F.abs(
            F.datediff(c("end"), F.lit(exp["end"]).cast("date"))
        )
        checks.append(("date_range", "warning", gap, gap == 0))
    if cust is not None:
        age = c("preferred_age")
        wide = wide.withColumn("_c", one_row(cust.agg(
            F.count(F.lit(1)).alias("customers"), count_if(c("recency_days") < 0).alias("recency"),
            count_if(c("frequency") <= 0).alias("frequency"), count_if(c("monetary") < 0).alias("monetary"),
            count_if((c("loyalty_score") < 0) | (c("loyalty_score") > 1)).alias("loyalty"),
            count_if(c("net_monetary") > c("monetary")).alias("net"),
            count_if(~c("last_order_was_return").isin(0, 1)).alias("last_return"),
            count_if((age < -1) | (age > 120) | ((age > 0) & (age < 18))).alias("age"),
        ))).withColumn("_d", one_row(duplicate_keys(cust, "customer_id")))
        checks += [
            ("recency_not_negative", "error", c("_c.recency"), c("_c.recency") == 0),
            ("frequency_positive", "error", c("_c.frequency"), c("_c.frequency") == 0),
            ("monetary_not_negative", "error", c("_c.monetary"), c("_c.monetary") == 0),
            ("loyalty_in_unit_range", "error", c("_c.loyalty"), c("_c.loyalty") == 0),
            ("customer_tables_agree", "error", c("_c.customers"), c("_c.customers") == c("_k.keys")),
            ("net_not_above_gross", "error", c("_c.net"), c("_c.net") == 0),
            ("binary_last_return", "error", c("_c.last_return"), c("_c.last_return") == 0),
            ("preferred_age_range", "warning", c("_c.age"), c("_c.age") == 0),
            ("unique_customer_id", "error", c("_d.duplicates"), c("_d.duplicates") == 0),
        ]
    return _check_rows(wide, checks)


def key_overlap(tx: DataFrame, cust: DataFrame, key: str = "customer_id") -> DataFrame:
    """One row: distinct keys on each side, shared keys, leftovers. One full join, one pass."""
    a = tx.select(key).distinct().withColumn("_a", F.lit(1))
    b = cust.select(key).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, key, "full")
    return j.agg(
        F.count("_a").alias("left_keys"), F.count("_b").alias("right_keys"),
        count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"),
        count_if(F.col("_b").isNull()).alias("left_only"), count_if(F.col("_a").isNull()).alias("right_only"),
    ).withColumn("overlap_pct", safe_divide(F.col("shared") * 100.0, F.col("left_keys"), 0.0))


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def leftover_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def fraud_input_checks(tx: DataFrame, cust: DataFrame) -> DataFrame:
    c = F.col
    key_nulls = any_of([c(x).isNull() for x in ("order_id", "customer_id", "order_date", "total_amount")])
    wide = tx.agg(
        count_if(key_nulls).alias("nulls"), count_if(~c("returned").isin(0, 1)).alias("flag"),
        count_if((c("discount") < 0) | (c("discount") > 1)).alias("discount"),
        count_if(c("total_amount") <= 0).alias("amount"),
    )
    wide = wide.withColumn("_j", one_row(key_overlap(tx, cust))).withColumn("_o", one_row(duplicate_keys(tx, "order_id")))
    return _check_rows(wide, [
        ("customer_overlap", "error", c("_j.overlap_pct"), c("_j.overlap_pct") >= 95),
        ("key_nulls", "error", c("nulls"), c("nulls") == 0),
        ("binary_returned", "error", c("flag"), c("flag") == 0),
        ("discount_range", "error", c("discount"), c("discount") == 0),
        ("positive_amount", "error", c("amount"), c("amount") == 0),
        ("unique_order_id", "error", c("_o.duplicates"), c("_o.duplicates") == 0),
    ])


def cohort_input_checks(
    tx: DataFrame, cust: DataFrame, cfg: Config = DEFAULT, expected_customers: int | None = None,
    window: tuple[str, str] | None = None, today: str | None = None,
) -> DataFrame:
    c = F.col
    ref = F.lit(today).cast("date") if today else F.current_date()
    wide = tx.agg(
        F.min("order_date").alias("lo"), F.max("order_date").alias("hi"),
        count_if(c("order_date") > ref).alias("future"),
        count_if(~c("returned").isin(0, 1)).alias("flag"),
        count_if(c("customer_id").isNull()).alias("null_ids"), count_if(c("total_amount") < 0).alias("negative"),
    ).withColumn("_j", one_row(key_overlap(tx, cust)))
    keys = c("_j.left_keys")
    want = F.lit(expected_customers) if expected_customers else c("_j.right_keys")
    checks = [
        ("customer_count", "error", keys, F.abs(keys - want) <= want * cfg.cohort.count_tolerance),
        ("customers_known", "error", c("_j.right_only"), c("_j.right_only") == 0),
        ("no_future_dates", "error", c("future"), c("future") == 0),
        ("binary_returned", "error", c("flag"), c("flag") == 0),
        ("no_null_customers", "error", c("null_ids"), c("null_ids") == 0),
        ("no_negative_amounts", "warning", c("negative"), c("negative") == 0),
    ]
    if window:
        lo, hi = (F.lit(x).cast("date") for x in window)
        out = (c("lo") < lo).cast("int") + (c("hi") > hi).cast("int")
        checks.append(("date_window", "warning", out, out == 0))
    return _check_rows(wide, checks)


def cohort_output_checks(cells: DataFrame, cfg: Config = DEFAULT, expected_customers: int | None = None) -> DataFrame:
    """``cells``: cohort_month, period_offset, cohort_size, active, retention, revenue, ltv."""
    c = F.col
    wide = cells.agg(
        count_if(c("cohort_month").isNull() | c("period_offset").isNull()).alias("nulls"),
        count_if(c("period_offset") < 0).alias("negative_offset"),
        count_if((c("period_offset") == 0) & (F.coalesce(c("retention"), F.lit(0.0)) != 1)).alias("m0"),
        count_if((c("retention") < 0) | (c("retention") > 1)).alias("range"),
        count_if(c("revenue") < 0).alias("revenue"), count_if(c("ltv") < 0).alias("ltv"),
        count_if(c("cohort_size").isNull() | (c("cohort_size") <= 0)).alias("sizes"),
        F.sum(F.when(c("period_offset") == 0, c("cohort_size"))).alias("customers"),
        count_if((c("period_offset") == 0)).alias("cohorts"),
    )
    checks = [
        ("keys_present", "error", c("nulls"), c("nulls") == 0),
        ("offsets_not_negative", "error", c("negative_offset"), c("negative_offset") == 0),
        ("month0_retention_is_1", "error", c("m0"), c("m0") == 0),
        ("retention_in_unit_range", "error", c("range"), c("range") == 0),
        ("revenue_not_negative", "error", c("revenue"), c("revenue") == 0),
        ("ltv_not_negative", "error", c("ltv"), c("ltv") == 0),
        ("cohort_sizes_present", "error", c("sizes"), c("sizes") == 0),
        ("cohorts_present", "error", c("cohorts"), c("cohorts") > 0),
    ]
    if expected_customers:
        slack = expected_customers * cfg.cohort.count_tolerance
        checks.append(("customer_count", "error", c("customers"), F.abs(c("customers") - expected_customers) <= slack))
    return _check_rows(wide, checks)


def fraud_output_checks(scored: DataFrame, cfg: Config = DEFAULT, score: str = "composite_fraud_score") -> DataFrame:
    c = F.col
    top = c("risk_tier").isin("Critical", "High")
    wide = scored.agg(
        count_if((c(score) < 0) | (c(score) > 1) | c(score).isNull()).alias("range"),
        count_if(c("risk_tier").isNull()).alias("tiers"),
        (F.try_divide(count_if(top) * 100.0, F.count(F.lit(1)))).alias("top_pct"),
        count_if(c("iso_anomaly_flag") == 1).alias("iso"), count_if(c("lof_anomaly_flag") == 1).alias("lof"),
        count_if(top & c("primary_typology").isNull()).alias("typology"),
        count_if(c("rule_fraud_score").isNull()).alias("rules"),
    ).withColumn("_d", one_row(duplicate_keys(scored, "customer_id")))
    limit = cfg.fraud.max_high_critical_pct
    return _check_rows(wide, [
        ("score_range", "error", c("range"), c("range") == 0),
        ("tiers_complete", "error", c("tiers"), c("tiers") == 0),
        ("high_critical_share", "warning", c("top_pct"), c("top_pct") < limit),
        ("isolation_found_anomalies", "error", c("iso"), c("iso") > 0),
        ("lof_found_anomalies", "error", c("lof"), c("lof") > 0),
        ("unique_customer_id", "error", c("_d.duplicates"), c("_d.duplicates") == 0),
        ("typology_complete", "error", c("typology"), c("typology") == 0),
        ("rule_scores_complete", "error", c("rules"), c("rules") == 0),
    ])


def temporal_split_checks(data: DataFrame, n_features: int, window_days: int, cfg: Config = DEFAULT) -> DataFrame:
    """``data``: churn label and is_train. Passes when at least four of the five checks pass."""
    c = F.col
    features = [x for x in data.columns if x not in ("customer_id", "churn", "is_train")]
    wide = data.agg(
        count_if(any_of([c(x).isNull() for x in features])).alias("nulls"),
        F.avg("churn").alias("rate"), F.avg(F.when(c("is_train"), c("churn"))).alias("train"),
        F.avg(F.when(~c("is_train"), c("churn"))).alias("test"),
    )
    gap = F.abs(c("train") - c("test"))
    out = _check_rows(wide, [
        ("no_nulls", "warning", c("nulls"), c("nulls") == 0),
        ("churn_share", "warning", c("rate"), (c("rate") >= 0.05) & (c("rate") <= 0.5)),
        ("split_gap", "warning", gap, gap < 0.02),
        ("window_length", "warning", F.lit(window_days), F.lit(window_days == cfg.churn.observation_days)),
        ("feature_count", "warning", F.lit(n_features), F.lit(n_features >= 5)),
    ])
    passed = F.sum((c("status") == "PASS").cast("int")).over(Window.partitionBy(F.lit(1)))  # five rows
    return out.withColumn("split_valid", passed >= 4)


def segmentation_input_checks(scored: DataFrame) -> DataFrame:
    c = F.col
    cols = [x for x in ("recency_score", "frequency_score", "monetary_score") if x in scored.columns]
    wide = scored.agg(*[count_if(c(x).isNull() | (c(x) < 1) | (c(x) > 5)).alias(x) for x in cols])
    return _check_rows(wide, [(f"{x}_in_1_5", "error", c(x), c(x) == 0) for x in cols])


def fingerprint(df: DataFrame, amount: str = "total_amount", digits: int = 8) -> DataFrame:
    """One row: md5 of count, sum, min and max, cut to ``digits``, plus the order-insensitive row digest."""
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"), money_sum(F.col(amount)).alias("s"),
        F.min(amount).alias("lo"), F.max(amount).alias("hi"),
        F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("row_digest"),
    )
    text = F.concat_ws("_", F.col("rows"), *[F.format_string("%.2f", x) for x in ("s", "lo", "hi")])
    return stats.select("rows", F.substring(F.md5(text), 1, digits).alias("fingerprint"), "row_digest")


def quality_score(df: DataFrame, initial_rows: int | DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Weighted score of completeness, rule compliance and row retention."""
    q, c = cfg.quality, F.col
    nulls = sum((count_if(c(x).isNull()) for x in df.columns), F.lit(0))
    bad = count_if(c("price") < 0) + count_if((c("discount") < 0) | (c("discount") > 1)) + count_if(c("quantity") <= 0)
    out = df.agg(F.count(F.lit(1)).alias("final_rows"), nulls.alias("_nulls"), bad.alias("violations"))
    if isinstance(initial_rows, DataFrame):
        start = initial_rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    else:
        start = F.lit(initial_rows).cast("bigint") if initial_rows else c("final_rows")
    out = out.withColumn("initial_rows", start)
    pct = lambda a, b: (1 - safe_divide(a, b, 0.0)) * 100
    out = out.withColumns({
        "completeness": pct(c("_nulls"), c("final_rows") * len(df.columns)),
        "compliance_rate": pct(c("violations"), c("final_rows")),
        "retention_rate": safe_divide(c("final_rows"), c("initial_rows"), 1.0) * 100,
        "rows_removed": c("initial_rows") - c("final_rows"),
    })
    score = (
        c("completeness") / 100 * q.completeness_weight + c("compliance_rate") / 100 * q.compliance_weight
        + c("retention_rate") / 100 * q.retention_weight
    )
    return out.withColumn("quality_score", score).drop("_nulls")


def data_quality_report(df: DataFrame) -> DataFrame:
    """One row: size, nulls, duplicate rows, span, distinct keys, revenue, score = 100 - 10 per issue."""
    c = F.col
    nulls = sum((count_if(c(x).isNull()) for x in df.columns), F.lit(0))
    out = df.agg(
        F.count(F.lit(1)).alias("rows"), nulls.alias("null_cells"),
        F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"),
        money_sum(c("total_amount")).alias("total_revenue"), (F.avg("returned") * 100).alias("return_rate"),
    )
    dup = df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(c("n") - 1), F.lit(0)).alias("d"))
    out = out.withColumn("duplicate_rows", dup.scalar()).withColumn("columns", F.lit(len(df.columns)))
    for key, name in (("customer_id", "customers"), ("product_id", "products")):
        out = out.withColumn(name, df.select(key).distinct().agg(F.count(key).alias("n")).scalar())
    out = out.withColumn("span_days", F.datediff("last_date", "first_date"))
    issues = (c("null_cells") > 0).cast("int") + (c("duplicate_rows") > 0).cast("int")
    return out.withColumn("score", 100 - 10 * issues)


def missing_patterns(df: DataFrame, top: int = 10) -> DataFrame:
    """Most common combinations of null columns (a top-k report; ties by pattern)."""
    flags = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in df.columns])
    pat = df.select(flags.alias("pattern")).groupBy("pattern").agg(F.count("*").alias("rows"))
    pat = pat.withColumn("null_columns", F.when(F.col("pattern") == "", 0).otherwise(F.size(F.split("pattern", ","))))
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return pat.withColumn("pct", F.col("rows") * 100.0 / n).orderBy(F.desc("rows"), "pattern").limit(top)


def missingness_profile(df: DataFrame) -> DataFrame:
    """Null count and share per column, with the share of complete rows and cells on each line."""
    cols = df.columns
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"), *[count_if(F.col(c).isNull()).alias(f"n_{c}") for c in cols],
        count_if(any_of([F.col(c).isNull() for c in cols])).alias("_any"),
    )
    cells = sum((F.col(f"n_{c}") for c in cols), F.lit(0))
    wide = wide.withColumn("complete_rows_pct", 100 - safe_divide(F.col("_any") * 100.0, F.col("rows"), 0.0))
    wide = wide.withColumn("complete_cells_pct", 100 - safe_divide(cells * 100.0, F.col("rows") * len(cols), 0.0))
    out = to_rows(wide, [[F.lit(c), F.col(f"n_{c}")] for c in cols], ["column_name", "missing"],
                  keep=["rows", "complete_rows_pct", "complete_cells_pct"])
    return out.withColumn("missing_pct", safe_divide(F.col("missing") * 100.0, F.col("rows"), 0.0))


def imputation_plan(profile: DataFrame, numeric: set[str], mechanisms: DataFrame | None = None,
                    cfg: Config = DEFAULT) -> DataFrame:
    """Fill strategy per column with missing values, by share, mechanism and type."""
    c, q = F.col, cfg.quality
    df = profile.where("missing > 0").withColumn("is_numeric", c("column_name").isin(*numeric) if numeric else F.lit(False))
    if mechanisms is not None:
        df = df.join(mechanisms.select("column_name", "mechanism"), "column_name", "left")
    else:
        df = df.withColumn("mechanism", F.lit(None).cast("string"))
    mech = F.coalesce(c("mechanism"), F.lit("UNKNOWN"))
    few = c("missing_pct") < q.missing_low_pct
    strategy = (
        F.when(c("missing_pct") > q.missing_critical_pct, "DROP_COLUMN")
        .when(few & (mech == "MCAR"), F.when(c("is_numeric"), "MEDIAN_IMPUTATION").otherwise("MODE_IMPUTATION"))
        .when(few, "PREDICTIVE_IMPUTATION")
        .when(mech == "MCAR", "MULTIPLE_IMPUTATION")
        .when(mech == "MAR", "PREDICTIVE_IMPUTATION")
        .otherwise("INDICATOR_VARIABLE")
    )
    return df.withColumn("strategy", strategy)


def missing_impact(df: DataFrame, critical: tuple[str, ...] = ("customer_id", "order_id", "total_amount")) -> DataFrame:
    """One row: critical columns with nulls, share of rows touched, priority label."""
    crit = [x for x in critical if x in df.columns]
    hit = sum((F.max(F.col(x).isNull().cast("int")) for x in crit), F.lit(0))
    rows = count_if(any_of([F.col(x).isNull() for x in df.columns]))
    out = df.agg(hit.alias("critical_columns_affected"), (safe_divide(rows * 100.0, F.count(F.lit(1)), 0.0)).alias("potential_data_loss_pct"))
    pct = F.col("potential_data_loss_pct")
    label = F.when(F.col("critical_columns_affected") > 0, "CRITICAL").when(pct > 20, "HIGH").when(pct > 5, "MEDIUM").otherwise("LOW")
    return out.withColumn("priority", label)


def iqr_outliers(df: DataFrame, columns, cfg: Config = DEFAULT) -> DataFrame:
    """Per column: quartile fences and the count, share and range of values outside them.

    Works on the ranked distinct values: the fences and the counts come from the same small table.
    """
    cols = list(columns)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column_name", "value")
    ranks = value_ranks(long, "value", by=["column_name"])
    q = quantiles_of_ranks(ranks, "value", {"q1": 0.25, "q3": 0.75}, by=["column_name"])
    k = cfg.quality.iqr_multiplier
    q = q.withColumn("lower", F.col("q1") - k * (F.col("q3") - F.col("q1"))).withColumn(
        "upper", F.col("q3") + k * (F.col("q3") - F.col("q1"))
    )
    out = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return ranks.join(q, "column_name").groupBy("column_name", "q1", "q3", "lower", "upper").agg(
        F.coalesce(F.sum(F.when(out, F.col("n"))), F.lit(0)).alias("outliers"),
        (F.coalesce(F.sum(F.when(out, F.col("n"))), F.lit(0)) * 100.0 / F.sum("n")).alias("outlier_pct"),
        F.min(F.when(out, F.col("value"))).alias("outlier_min"), F.max(F.when(out, F.col("value"))).alias("outlier_max"),
    )
