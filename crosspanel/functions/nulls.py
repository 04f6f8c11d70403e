"""Null algebra of the engine: a missing value is NULL, never NaN; infinities are values until an operator drops them.

Nothing here depends on ``spark.sql.ansi.enabled``: every division is guarded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def no_nan(x: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """NaN and infinities to NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(INF)), x)


def ieee_div(a: Column, b: Column) -> Column:
    """a / b as floating point does it: x / 0 is an infinity of x's sign, 0 / 0 and inf / inf are missing."""
    zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return no_nan(F.when(b == 0, zero).otherwise(a / F.when(b != 0, b)))


def safe_div(a: Column, b: Column, least: float = 1e-15) -> Column:
    """a / b where abs(b) exceeds ``least``, else NULL."""
    return a / F.when(F.abs(b) > least, b)


def least_or_null(a: Column, b: Column) -> Column:
    """Smaller of two values; NULL if either is (Spark's ``least`` skips NULL)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def greatest_or_null(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within [low, high]; NULL stays."""
    out = x
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out
