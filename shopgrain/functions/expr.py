"""Column expressions shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Money is summed in integer ten-thousandths. Integer addition does not depend on the order in
# which partitions arrive, so a retried task gives the same total to the last digit.
MONEY_SCALE = 10_000.0


def safe_divide(num: Column, den: Column, fallback: float | None = None) -> Column:
    """num / den, or ``fallback`` when the quotient is undefined."""
    q = F.try_divide(num.cast("double"), den.cast("double"))
    q = F.when(F.isnan(q) | (F.abs(q) == float("inf")), F.lit(None)).otherwise(q)
    return q if fallback is None else F.coalesce(q, F.lit(float(fallback)))


def money_units(amount: Column) -> Column:
    return F.rint(amount * MONEY_SCALE).cast("bigint").cast("decimal(18,0)")


def money_sum(amount: Column) -> Column:
    """Exact, order-independent sum of a money column, as DOUBLE."""
    return F.sum(money_units(amount)).cast("double") / MONEY_SCALE


def money_avg(amount: Column) -> Column:
    return F.try_divide(F.sum(money_units(amount)).cast("double") / MONEY_SCALE, F.count(amount).cast("double"))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def share(cond: Column) -> Column:
    """Share of all rows for which ``cond`` holds (null counts as false)."""
    return F.try_divide(count_if(cond).cast("double"), F.count(F.lit(1)).cast("double"))


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def week_end(d: Column) -> Column:
    """The Sunday that ends the week of ``d``."""
    return F.date_add(F.date_trunc("week", d).cast("date"), 6)


def day_number(d: Column) -> Column:
    """Days since 1970-01-01 as an integer (usable in range frames)."""
    return F.datediff(d, F.lit("1970-01-01").cast("date"))


def months_between_int(later: Column, earlier: Column) -> Column:
    return (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))


def ladder(*branches: tuple[Column, str], default) -> Column:
    """First matching branch wins."""
    out = None
    for cond, value in branches:
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(default))


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def one_row(stats: DataFrame) -> Column:
    """The single row of ``stats`` as a struct-valued scalar subquery.

    Catalyst runs it once and inlines the row, so there is neither a driver round trip nor a join.
    Spark runs subqueries on a small thread pool and a nested one waits inside its parent, so a plan
    should hold a handful of them: many statistics go into one row, and inputs that carry
    subqueries of their own are materialized first.
    """
    return stats.select(F.struct(*[F.col(c) for c in stats.columns]).alias("s")).scalar()


def unpivot(df: DataFrame, ids: list[str], values: list[str], key: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, key, value)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def to_rows(df: DataFrame, rows: list[list[Column]], names: list[str], keep: list[str] | None = None) -> DataFrame:
    """Turn each input row into one row per entry of ``rows`` (a lateral explode of structs)."""
    items = [F.struct(*[c.alias(n) for c, n in zip(r, names)]) for r in rows]
    return df.select(*(keep or []), F.explode(F.array(*items)).alias("r")).select(*(keep or []), "r.*")


# Redaction patterns in the order they apply, and their tokens.
REDACTIONS = (
    (r"C\d{5}", "[REDACTED_CUSTOMER_ID]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[REDACTED_PHONE]"),
    (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "[REDACTED_CC]"),
)


def redact(text: Column) -> Column:
    """Replace customer ids, e-mail addresses, phone numbers and card numbers by tokens."""
    return reduce(lambda c, rule: F.regexp_replace(c, F.lit(rule[0]), F.lit(rule[1])), REDACTIONS, text)
