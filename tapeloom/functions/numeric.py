"""Numeric expressions with the null rules of the data model.

NULL is the only missing value.  NaN and the infinities are turned into NULL on
entry and no expression here can produce them again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Fixed value: added to a denominator that is known to be non-negative.
EPSILON = 1e-10


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: str | Column) -> Column:
    """``x`` as double with NaN and +-Infinity replaced by NULL."""
    v = col(x).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, NULL where the denominator is zero."""
    return num / F.nullif(den, F.lit(0.0))


def eps_ratio(num: Column, den: Column) -> Column:
    """``num / (den + epsilon)``."""
    return num / F.nullif(den + F.lit(EPSILON), F.lit(0.0))


def clip(x: Column, low: Column | float | None, high: Column | float | None) -> Column:
    """Bounded ``x``; NULL stays NULL although least/greatest skip NULLs."""
    out = x
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(x.isNotNull(), out)


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def product(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, columns)


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness (Spark's ``skewness`` is the population form)."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(x).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6.0) * (n - 1) / ((n - 2) * (n - 3)))
