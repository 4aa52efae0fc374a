"""Column helpers with one notion of a missing value.

NaN is turned into null at the scan (`sources.io.load`); these helpers keep null
in, null out, and never raise on a division by zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMERIC)


def double(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def finite(x: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def clip(x: Column, lo: Column | float | None, hi: Column | float | None) -> Column:
    """Null stays null, which greatest() and least() alone would not keep."""
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(lo) if not isinstance(lo, Column) else lo)
    if hi is not None:
        out = F.least(out, F.lit(hi) if not isinstance(hi, Column) else hi)
    return F.when(x.isNotNull(), out)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def quantile(x: Column, p: float | list[float], accuracy: int | None = None) -> Column:
    """Linear interpolation, exact; with `accuracy`, an approximate one of bounded memory for very large groups."""
    share = F.array(*[F.lit(v) for v in p]) if isinstance(p, list) else F.lit(p)
    return F.percentile(x, share) if accuracy is None else F.percentile_approx(x, p, accuracy)


def skewness(x: Column) -> Column:
    """Adjusted Fisher-Pearson; null below three values or without spread."""
    n = F.count(x).cast("double")
    return F.when((n > 2) & (F.var_pop(x) > 0), F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x))


def kurtosis(x: Column) -> Column:
    """Adjusted excess; null below four values or without spread."""
    n = F.count(x).cast("double")
    return F.when((n > 3) & (F.var_pop(x) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def correlation(x: Column, y: Column) -> Column:
    """Pearson over the rows that hold both; null without spread, where corr() would raise."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def entropy(p: Column) -> Column:
    """Summand of the entropy in bits of a share p."""
    return -p * F.log2(p + 1e-12)
