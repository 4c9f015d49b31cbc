"""Tail probabilities of test statistics, for tables with one row per test."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1.0 - front * total
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        num = -i * (i - a)
        b += 2
        d = 1.0 / (num * d + b or 1e-300)
        c = b + num / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            return front * h
    raise ArithmeticError(f"incomplete gamma function of {a}, {x} did not converge")


def chi2_tail(x: float, df: float) -> float:
    return _gamma_upper(df / 2.0, x / 2.0)


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            return h
    raise ArithmeticError(f"incomplete beta function of {a}, {b}, {x} did not converge")


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


#: Degrees of freedom above which the F and t tails are those of their limits; these differ by less than 1e-7 there.
LIMIT_DF = 1e8


def f_tail(f: float, d1: float, d2: float) -> float:
    if d2 > LIMIT_DF:
        return chi2_tail(d1 * f, d1)
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_two_sided(t: float, df: float) -> float:
    if df > LIMIT_DF:
        return normal_two_sided(t)
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def _column(fn, *args: Column) -> Column:
    @F.pandas_udf("double")
    def tail(*cols: pd.Series) -> pd.Series:
        rows = zip(*cols)
        return pd.Series([None if any(pd.isna(v) for v in r) else fn(*map(float, r)) for r in rows], dtype="float64")

    return tail(*[a.cast("double") for a in args])


def p_normal(z: Column) -> Column:
    return _column(lambda z: normal_two_sided(z), z)


def p_chi2(x: Column, df: Column) -> Column:
    return _column(lambda x, k: chi2_tail(x, k), x, df)


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return _column(lambda f, a, b: f_tail(f, a, b), f, d1, d2)


def p_t(t: Column, df: Column) -> Column:
    return _column(lambda t, k: t_two_sided(t, k), t, df)
