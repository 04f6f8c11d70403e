"""Orders over a whole table without a task that holds it: rows are cut into ranges of a key, each range works alone, and what
earlier or later ranges hand over is a table with a row for each range.

The range of a row must follow from its key alone, rise with it, and be equal for equal keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a range of dates, and ranges that values are cut into.
DAYS, PARTS = 64, 32


def day_range(date: str) -> Column:
    return F.floor(F.datediff(F.col(date), F.lit("1970-01-01").cast("date")) / DAYS).cast("int")


def value_range(df: DataFrame, column: str, parts: int = PARTS) -> Column:
    """Ranges with about as many rows each; at most ``parts`` bounds come to the driver."""
    bounds = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10_000).alias("b")).first()["b"] or []
    return F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b <= F.col(column))) if bounds else F.lit(0)


def handed(df: DataFrame, by: str, earlier: dict[str, Column] | None = None, later: dict[str, Column] | None = None) -> DataFrame:
    """Adds aggregates over all rows of earlier, or of later, ranges (column ``by``); NULL where there are none.

    Each range is one row in the table that meets itself; ranges are some hundred.
    """
    earlier, later = earlier or {}, later or {}
    parts = df.groupBy(by).agg(*(v.alias(k) for k, v in (earlier | later).items()))
    sums = {"sum": F.sum, "min": F.min, "max": F.max}
    other = parts.select(F.col(by).alias("_other"), *(F.col(k).alias(f"_o_{k}") for k in (earlier | later)))
    met = parts.select(by).join(F.broadcast(other), F.lit(True))
    kind = lambda k: sums[k.rsplit("_", 1)[1]]  # noqa: E731  the name's end says how ranges are put together
    given = met.groupBy(by).agg(*(kind(k)(F.when(F.col("_other") < F.col(by), F.col(f"_o_{k}"))).alias(k) for k in earlier), *(kind(k)(F.when(F.col("_other") > F.col(by), F.col(f"_o_{k}"))).alias(k) for k in later))
    return df.join(F.broadcast(given), by)


def numbered_over(df: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """Adds each row's place from 1 in the order of the whole table; ``order`` must agree with the ranges in ``by``."""
    rows = handed(df, by, earlier={"_before_sum": F.count(F.lit(1))})
    own = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn(name, F.coalesce("_before_sum", F.lit(0)) + own).drop("_before_sum")
