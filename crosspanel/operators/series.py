"""Operators of the formula language as Spark columns: row-wise, along time (by symbol), across symbols (by date)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .ranges import day_range, numbered_over
from ..functions.nulls import INF, clip, finite, greatest_or_null, ieee_div, least_or_null, no_nan, safe_div

DATE, SYMBOL = "date", "symbol"
#: What rows of a time window have in common: the symbol, or the symbol and a block of its time.
_along: ContextVar[tuple[str, ...]] = ContextVar("_along", default=(SYMBOL,))


@contextmanager
def along(*by: str) -> Iterator[None]:
    """Time windows that are built inside of the block are partitioned by ``by``."""
    token = _along.set(by)
    try:
        yield
    finally:
        _along.reset(token)


def along_names() -> tuple[str, ...]:
    return _along.get()


def ordered() -> WindowSpec:
    return Window.partitionBy(*_along.get()).orderBy(DATE)


def trailing(days: int) -> WindowSpec:
    """The last ``days`` rows of a symbol, today included."""
    return ordered().rowsBetween(1 - days, 0)


def history() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def day() -> WindowSpec:
    return Window.partitionBy(DATE)


# ---- row-wise ---------------------------------------------------------------------------------------------------------


def _bool(c: Column) -> Column:
    return c.cast("double")


ROWWISE = {
    "add": lambda a, b: no_nan(a + b),
    "sub": lambda a, b: no_nan(a - b),
    "mul": lambda a, b: no_nan(a * b),
    "div": ieee_div,
    "neg": lambda a: -a,
    "lt": lambda a, b: _bool(a < b),
    "gt": lambda a, b: _bool(a > b),
    "le": lambda a, b: _bool(a <= b),
    "ge": lambda a, b: _bool(a >= b),
    "where": lambda c, a, b: F.when(c > 0.5, a).when(c <= 0.5, b),
    "emin": least_or_null,
    "emax": greatest_or_null,
    "power": lambda x, y: no_nan(F.signum(x) * F.pow(F.abs(x), y)),
    "signedpower": lambda x, y: no_nan(F.signum(x) * F.pow(F.abs(x), y)),
    "log": lambda x: F.ln(F.when(x > 0, x)),
    "sign": F.signum,
    "abs": F.abs,
    "sqrt": lambda x: F.sqrt(F.when(x >= 0, x)),
    "log1p": lambda x: F.log1p(F.when(x > -1, x)),
    "expm1": F.expm1,
    "tanh": F.tanh,
    "fill": lambda x, v: F.coalesce(x, F.lit(float(v))),
    "clip": lambda x, low, high: clip(x, low, high),
    "isfinite": finite,
    "rowmax": lambda a, b, c: F.greatest(a, b, c),  # missing ones are skipped
    "safediv": safe_div,
    "before": lambda days: (F.datediff(F.col(DATE), F.lit("1970-01-01").cast("date")) < days).cast("double"),  # the row's date, in days since 1970
    "only": lambda c, x: F.when(c > 0.5, x),  # a missing condition is false
    "pick": lambda c, a, b: F.when(c > 0.5, a).otherwise(b),
}


# ---- along time -------------------------------------------------------------------------------------------------------


def _full(agg, x: Column, d: int, least: int | None = None) -> Column:
    """An aggregate of the last d rows if at least ``least`` (all, by default) of them are finite."""
    v, w = finite(x), trailing(d)
    return F.when(F.count(v).over(w) >= (d if least is None else least), agg(v).over(w))


def steady(x: Column, unit: Column | float = 1.0) -> Column:
    """Twelve decimals, in units of ``unit``: what the order of summation leaves behind must not break ties of later ranks."""
    return F.rint(x / unit * 1e12) / 1e12 * unit


def _pair(x: Column, y: Column, d: int):
    both = finite(x).isNotNull() & finite(y).isNotNull()
    return F.when(both, x), F.when(both, y), trailing(d)


def _turn(x: Column) -> Column:
    """Sign of today's change; NULL for one so small that the order of summation could have made it."""
    before = F.lag(x).over(ordered())
    return F.when(F.abs(x - before) > F.greatest(F.abs(x), F.abs(before)) * 1e-12, F.signum(x - before))


def correlation(x: Column, y: Column, d: int) -> Column:
    """Over two days it is 1 or -1 by the signs of both changes: moments would leave it a little off, and its ranks without ties."""
    a, b, w = _pair(x, y, d)
    if d == 2:
        return _turn(a) * _turn(b)
    spread = F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w)
    return F.when(F.count(a).over(w) >= d, steady(F.covar_samp(a, b).over(w) / F.when(spread != 0, spread)))


def covariance(x: Column, y: Column, d: int) -> Column:
    """In units of the power of two next below the spread, so that small series are rounded no more than large ones."""
    a, b, w = _pair(x, y, d)
    spread = F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w)
    unit = F.when(spread > 0, F.pow(F.lit(2.0), F.floor(F.log2(F.when(spread > 0, spread))))).otherwise(1.0)
    return F.when(F.count(a).over(w) >= d, steady(F.covar_samp(a, b).over(w), unit))


def decay_linear(x: Column, d: int) -> Column:
    """Mean of the last d rows with weights d, d - 1, ..., 1 from the newest; NULL if one is missing."""
    w = ordered()
    terms = [F.lag(x, k).over(w) * float(d - k) if k else x * float(d) for k in range(d)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return no_nan(total / (d * (d + 1) / 2))


#: Longest window whose ranks are compared row by row, as window columns; longer ones are slid over by tasks in Python.
SHORT = 5


def short_rank(x: Column, d: int) -> Column:
    """Average rank of today's value among the last d rows, over d; NULL unless all d are finite. The sum of the signs of its
    differences is the number of lesser ones less that of greater ones, so that a window costs d - 1 comparisons a row."""
    v, w = finite(x), ordered()
    signs = sum((F.signum(v - F.lag(v, k).over(w)) for k in range(1, d)), F.signum(v - v))
    return (signs + (d + 1)) / 2 / d


#: Operators that are window columns; sliding order statistics and exponential means are tables' work (``sliding``, ``history``).
ALONG_TIME = {
    "delay": lambda x, d: F.lag(x, d).over(ordered()),
    "lead": lambda x, d: F.lead(x, d).over(ordered()),
    "delta": lambda x, d: no_nan(x - F.lag(x, d).over(ordered())),
    "pct_change": lambda x, d: no_nan(ieee_div(x, F.lag(x, d).over(ordered())) - 1),
    "ts_sum": lambda x, d: _full(F.sum, x, d),
    "ts_mean": lambda x, d: _full(F.avg, x, d),
    "stddev": lambda x, d: _full(F.stddev_samp, x, d),
    "stddev_pop": lambda x, d: _full(F.stddev_pop, x, d),
    "ts_var": lambda x, d: _full(F.var_samp, x, d),
    "ts_min": lambda x, d: _full(F.min, x, d),
    "ts_max": lambda x, d: _full(F.max, x, d),
    "product": lambda x, d: _full(F.product, x, d),
    "ts_count": lambda x, d: F.count(finite(x)).over(trailing(d)).cast("double"),
    "mean_min": lambda x, d, m: _full(F.avg, x, d, m),
    "std_min": lambda x, d, m: _full(F.stddev_samp, x, d, m),
    "stdp_min": lambda x, d, m: _full(F.stddev_pop, x, d, m),
    "var_min": lambda x, d, m: _full(F.var_samp, x, d, m),
    "sum_min": lambda x, d, m: _full(F.sum, x, d, m),
    "max_min": lambda x, d, m: _full(F.max, x, d, m),
    "correlation": correlation,
    "covariance": covariance,
    "decay_linear": decay_linear,
    "cumprod": lambda x: F.product(x).over(history()),
    "cummax": lambda x: F.max(x).over(history()),
    "cumcount": lambda x: F.count(finite(x)).over(history()).cast("double"),
}


# ---- across symbols ---------------------------------------------------------------------------------------------------


def average_rank(x: Column, by: list[str] | None = None) -> Column:
    """Rank from 1 within a date, ties averaged, NULL for NULL: the least rank and half of the number of its equals beyond it.

    Both windows share one partitioning and one order, so a date's ranks cost one exchange and one sort.
    """
    order = Window.partitionBy(*(by or [DATE])).orderBy(x.asc_nulls_last())
    return F.when(x.isNotNull(), F.rank().over(order) + (F.count(x).over(order.rangeBetween(0, 0)) - 1) / 2)


def _n(x: Column) -> Column:
    return F.count(x).over(day())


def _z(x: Column, spread: Column) -> Column:
    return (x - F.avg(x).over(day())) / spread


def _std(x: Column) -> Column:
    return F.stddev_samp(x).over(day())


def scale(x: Column, a: float) -> Column:
    gross = F.sum(F.abs(x)).over(day())
    return no_nan(x * float(a) / F.when(gross != 0, gross))


def zscore_zero(x: Column, eps: float) -> Column:
    """z-score; 0 where the spread is tiny or there are fewer than two names; NULL where the value is missing."""
    s = _std(x)
    return F.when(x.isNotNull(), F.when((_n(x) >= 2) & (s > eps), _z(x, F.when(s > eps, s))).otherwise(0.0))


ACROSS = {
    "rank": lambda x: average_rank(x) / _n(x),
    "avgrank": average_rank,
    "rank_centered": lambda x, least: F.when(_n(x) >= least, 2 * (average_rank(x) - 1) / F.when(_n(x) > 1, _n(x) - 1) - 1),
    "midrank": lambda x: (average_rank(x) - 0.5) / _n(x),
    "scale": scale,
    "demean": lambda x: no_nan(x - F.avg(x).over(day())),
    "zscore": lambda x: _z(x, F.when(_std(x) != 0, _std(x))),
    "zscore_eps": lambda x, eps: _z(x, _std(x) + eps),
    "zscore_zero": zscore_zero,
    "zscore_fill": lambda x: F.coalesce(_z(x, F.when(_std(x) != 0, _std(x))), F.lit(0.0)),
    "zscore_pop": lambda x, least, eps: F.when(_n(x) >= least, _z(x, F.when(F.stddev_pop(x).over(day()) > eps, F.stddev_pop(x).over(day())))),
    "xmean": lambda x, least: F.when(_n(x) >= least, F.avg(x).over(day())),
    "xcount": lambda x: _n(x).cast("double"),
    "xstd": _std,
    "least_names": lambda x, least: F.when(_n(x) >= least, x),
    "unit": lambda x: scale(x, 1.0),
}


def market_sum(df: DataFrame, x: Column, d: int, name: str) -> DataFrame:
    """Adds ``name``: the sum of a market series (one value a date) over the last d market dates, NULL if one is missing.

    The series has a row for each date, some ten thousand. Its dates are numbered over ranges and summed in blocks, each with the
    d - 1 dates before it; the sums go back to the panel by date.
    """
    series = df.groupBy(DATE).agg(F.max(finite(x)).alias("_v")).withColumn("_range", day_range(DATE))
    placed = numbered_over(series, "_range", [F.col(DATE)], "_n")
    length = max(256, d)
    block = F.floor((F.col("_n") - 1) / length)
    after = F.when((F.col("_n") - 1) % length >= length - (d - 1), block + 1)
    spread = placed.withColumn("_home", block).withColumn("_block", F.explode(F.filter(F.array(block, after), lambda b: b.isNotNull())))
    last = Window.partitionBy("_block").orderBy("_n").rowsBetween(1 - d, 0)
    v = F.col("_v")
    rolled = spread.withColumn(name, F.when(F.count(v).over(last) >= d, F.sum(v).over(last))).filter("_home = _block").select(F.col(DATE).alias("_date"), name)
    return df.join(F.broadcast(rolled), F.col(DATE) == F.col("_date"), "left").drop("_date")
