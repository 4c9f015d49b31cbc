"""Standardisation of raw transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT, Config
from ..functions.expr import count_if, one_row
from ..functions.ranks import quantiles
from ..session import materialized

CATEGORY_COLUMNS = ("category", "region", "payment_method", "customer_gender")
NUMERIC_COLUMNS = (
    "price", "discount", "quantity", "total_amount", "shipping_cost", "profit_margin",
    "customer_age", "delivery_time_days",
)
MONEY_COLUMNS = ("total_amount", "price", "shipping_cost")

# Spellings of the returned flag.
TRUE_WORDS = ("yes", "y", "true", "1")


def dedup_keep_first(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in ``order``, which must be total to make the result unique.

    The minimum is found with a partial aggregate, so copies of one key are reduced before the
    shuffle; a window would bring every copy into one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c not in keys]
    tail = [c for c in rest if c not in lead]
    row = F.struct(*lead, *tail)
    return df.groupBy(*keys).agg(F.min(row).alias("_r")).select(
        *[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns]
    )


def parse_dates(df: DataFrame, column: str = "order_date") -> DataFrame:
    """Cast to DATE (time of day dropped) and remove rows whose date does not parse."""
    return df.withColumn(column, F.col(column).try_cast("date")).where(F.col(column).isNotNull())


def normalize_category(c, cfg: Config = DEFAULT):
    text = F.initcap(F.lower(F.trim(c.cast("string"))))
    return F.when(text.isNull() | text.isin(*cfg.cleaning.empty_values), cfg.cleaning.unknown_value).otherwise(text)


def normalize_categories(df: DataFrame, columns=CATEGORY_COLUMNS, cfg: Config = DEFAULT) -> DataFrame:
    return df.withColumns({c: normalize_category(F.col(c), cfg) for c in columns if c in df.columns})


def decode_flag(df: DataFrame, column: str = "returned") -> DataFrame:
    """Yes/No spellings to 1/0; anything else is 0."""
    word = F.lower(F.trim(F.col(column).cast("string")))
    return df.withColumn(column, F.when(word.isin(*TRUE_WORDS), 1).otherwise(0))


def numeric_fill_values(df: DataFrame, columns, strategy: str = "median") -> DataFrame:
    """One row with the fill value of each numeric column."""
    cols = [c for c in columns if c in df.columns]
    if strategy == "zero":
        return df.sparkSession.range(1).select(*[F.lit(0.0).alias(c) for c in cols])
    if strategy == "mean":
        return df.agg(*[F.avg(c).alias(c) for c in cols])
    # Exact medians of all columns in one distributed pass: (column, value) pairs, then ranks.
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "_column", "_value")
    med = quantiles(long, "_value", {"m": 0.5}, by=["_column"])
    return med.agg(*[F.max(F.when(F.col("_column") == c, F.col("m"))).alias(c) for c in cols])


def categorical_fill_values(df: DataFrame, columns, strategy: str = "mode", unknown: str = "Unknown") -> DataFrame:
    """One row with the fill value of each text column (most frequent, smallest on ties)."""
    cols = [c for c in columns if c in df.columns]
    if strategy != "mode":
        return df.sparkSession.range(1).select(*[F.lit(unknown).alias(c) for c in cols])
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "_column", "_value")
    counts = long.where(F.col("_value").isNotNull()).groupBy("_column", "_value").agg(F.count("*").alias("n"))
    best = counts.groupBy("_column").agg(F.max("n").alias("n")).join(counts, ["_column", "n"])
    best = best.groupBy("_column").agg(F.min("_value").alias("v"))
    return best.agg(
        *[F.coalesce(F.max(F.when(F.col("_column") == c, F.col("v"))), F.lit(unknown)).alias(c) for c in cols]
    )


def columns_with_nulls(df: DataFrame, columns) -> list[str]:
    """Names of the columns that hold a null: one aggregate, one row to the driver."""
    cols = list(columns)
    if not cols:
        return []
    row = df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def impute(df: DataFrame, numeric=NUMERIC_COLUMNS, categorical=CATEGORY_COLUMNS, cfg: Config = DEFAULT) -> DataFrame:
    """Fill nulls from column statistics of the frame itself. Integer columns stay integer.

    Statistics are computed only for columns that have nulls.
    """
    c = cfg.cleaning
    holes = columns_with_nulls(df, [x for x in (*numeric, *categorical) if x in df.columns])
    nums, cats = [x for x in numeric if x in holes], [x for x in categorical if x in holes]
    source = df
    if nums:
        df = df.withColumn("_num", one_row(numeric_fill_values(source, nums, c.numeric_imputation)))
    if cats:
        df = df.withColumn("_cat", one_row(categorical_fill_values(source, cats, c.categorical_imputation, c.unknown_value)))
    types = {f.name: f.dataType for f in df.schema.fields}
    fills = {x: F.coalesce(F.col(x), F.col(f"_num.{x}").cast(types[x])) for x in nums}
    fills |= {x: F.coalesce(F.col(x), F.col(f"_cat.{x}")) for x in cats}
    return df.withColumns(fills).drop("_num", "_cat") if fills else df


def impute_stats(df: DataFrame, numeric=NUMERIC_COLUMNS, categorical=CATEGORY_COLUMNS) -> DataFrame:
    """Long table of fill values: column, statistic, value, nulls."""
    nums = [x for x in numeric if x in df.columns]
    cats = [x for x in categorical if x in df.columns]
    nulls = df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in nums + cats]).unpivot(
        [], nums + cats, "column_name", "nulls"
    )
    med = numeric_fill_values(df, nums).select(*[F.col(c).cast("string").alias(c) for c in nums])
    mode = categorical_fill_values(df, cats)
    fills = med.unpivot([], nums, "column_name", "fill_value").withColumn("statistic", F.lit("median")).unionByName(
        mode.unpivot([], cats, "column_name", "fill_value").withColumn("statistic", F.lit("mode"))
    )
    return fills.join(nulls, "column_name")


class NegativeAmountError(ValueError):
    """Raised when negative money is found and fixing it is switched off."""


def clip_negative_money(df: DataFrame, auto_fix: bool = True, columns=MONEY_COLUMNS) -> DataFrame:
    """Set negative money to 0, or fail the job on the first negative row."""
    out = {}
    for c in (x for x in columns if x in df.columns):
        if auto_fix:
            out[c] = F.when(F.col(c) < 0, F.lit(0).cast(df.schema[c].dataType)).otherwise(F.col(c))
        else:
            msg = F.concat(F.lit(f"negative {c}: "), F.col(c).cast("string"))
            out[c] = F.when(F.col(c) < 0, F.raise_error(msg).cast(df.schema[c].dataType)).otherwise(F.col(c))
    return df.withColumns(out)


def negative_money_counts(df: DataFrame, columns=MONEY_COLUMNS) -> DataFrame:
    cols = [c for c in columns if c in df.columns]
    wide = df.agg(*[count_if(F.col(c) < 0).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "negatives")


def require_rows(df: DataFrame) -> DataFrame:
    """Refuse an empty frame, as the feature build does."""
    if df.isEmpty():
        raise ValueError("input has no rows")
    return df


def clean_transactions(df: DataFrame, cfg: Config = DEFAULT, order: list[str] | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Dedup, dates, categories, return flag, imputation, negative money, in that order.

    ``order`` decides which copy of an order id is the first one; default: all columns in order. ``within`` names further columns that an order id determines and by which a join may
    have dealt out the rows: copies are looked for there, without a shuffle of whole rows by order id. They are not in the result.
    The deduplicated rows are written once to the shared folder, because the fill statistics and the
    result both read them; the reads then see only the columns they need.
    """
    df = dedup_keep_first(df, [*within, "order_id"], order or list(df.columns)).drop(*within)
    df = parse_dates(df)
    df = normalize_categories(df, cfg=cfg)
    df = materialized(decode_flag(df))
    df = impute(df, cfg=cfg)
    return clip_negative_money(df, cfg.cleaning.auto_fix_negatives)


def row_loss(before: DataFrame, after: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Rows lost by cleaning and whether that is more than allowed."""
    n = before.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = after.agg(F.count(F.lit(1)).alias("rows_after")).withColumn("rows_before", n)
    pct = F.try_divide((F.col("rows_before") - F.col("rows_after")) * 100.0, F.col("rows_before"))
    return out.withColumn("loss_pct", pct).withColumn("too_much", F.col("loss_pct") > cfg.cleaning.max_loss_pct)
