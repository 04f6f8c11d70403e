"""Readers and writers of the tables between stages: rank-correlation panels, screening results, jump tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.evaluate import SURVIVED
from .sheets import read_sheet


def first_existing(*folders: str) -> str:
    """The first of several local folders that exists."""
    for f in folders:
        if os.path.isdir(f):
            return f
    raise FileNotFoundError(f"none of {folders} exists")


def read_ic_csv(spark: SparkSession, path: str, keep_first: bool = False) -> DataFrame:
    """``alpha_id, date, ic`` from a CSV with a date column and a column for each signal; what isn't a number is missing.

    ``keep_first``: of repeated dates the first row counts. Signals without any value are left out.
    """
    wide = spark.read.csv(path, header=True)
    key, names = wide.columns[0], wide.columns[1:]
    # the place of a row in its file: file, block, and order within the block
    wide = wide.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    wide = wide.withColumn("_date", F.try_to_date(F.col(key))) if hasattr(F, "try_to_date") else wide.withColumn("_date", F.expr(f"try_cast(`{key}` as date)"))
    wide = wide.filter("_date is not null")
    if keep_first:
        order = Window.partitionBy("_date").orderBy("_file", "_start", "_row")
        wide = wide.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    long = wide.select(F.col("_date").alias("date"), *names).unpivot("date", names, "alpha_id", "ic")
    return long.select("alpha_id", "date", F.expr("try_cast(ic as double)").alias("ic")).filter("ic is not null and not isnan(ic)")


def write_ic_csv(ic: DataFrame, path: str) -> None:
    """A rank-correlation panel as CSV with a column for each signal. The signals are some hundred; dates some ten thousand."""
    ic.groupBy("date").pivot("alpha_id").agg(F.first("ic")).orderBy("date").write.mode("overwrite").csv(path, header=True)


def read_survivors(spark: SparkSession, path: str) -> DataFrame:
    """``alpha_id`` of the signals that a screening table calls survivors. A table without any is most likely the wrong one: it fails."""
    found = spark.read.csv(path, header=True, multiLine=True, escape='"').filter(F.col("status") == SURVIVED).select("alpha_id").distinct()
    if not found.limit(1).count():
        raise ValueError(f"no row of {path} has status {SURVIVED}")
    return found


def write_table(rows: DataFrame, path: str, order: list[str] | None = None, digits: dict[str, int] | None = None) -> None:
    """A results table (screening, votes, events, event results, verdicts) as CSV in one sorted file.

    Such tables have a row for each signal, event or pair of them. Doubles in ``digits`` are rounded; lists are joined by ``|``.
    """
    kinds = dict(rows.dtypes)
    cells = [F.round(c, digits[c]).alias(c) if digits and c in digits else F.array_join(c, "|").alias(c) if kinds[c].startswith("array") else F.col(c) for c in rows.columns]
    out = rows.select(*cells)
    out = out.coalesce(1).sortWithinPartitions(*order) if order else out.coalesce(1)
    out.write.mode("overwrite").csv(path, header=True, escape='"')


def read_constituents(spark: SparkSession, path: str) -> DataFrame:
    """A constituents table without its market_cap and weight, if it has them."""
    return spark.read.csv(path, header=True).drop("market_cap", "weight")


def _raw(spark: SparkSession, path: str, sheet: str | int) -> DataFrame:
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_sheet(spark, path, sheet) if path.endswith(".xlsx") else spark.read.csv(path, header=True, inferSchema=False)


def read_jumps(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A jump table from a workbook's sheet, CSV or Parquet. Column names lose outer white space; what isn't a number or a date is missing."""
    raw = _raw(spark, path, sheet)
    named = raw.toDF(*(c.strip() for c in raw.columns))
    numbers = [c for c in named.columns if c not in ("date", "description")]
    return named.withColumns({"date": F.expr("try_cast(date as date)")} | {c: F.expr(f"try_cast(`{c}` as double)") for c in numbers})


def read_passages(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """``date, description`` of a passages table, by default the first sheet; several rows of a date stay."""
    raw = _raw(spark, path, sheet)
    named = raw.toDF(*(c.strip() for c in raw.columns))
    return named.select(F.expr("try_cast(date as date)").alias("date"), F.col("description").cast("string").alias("description"))


def restrict(ic: DataFrame, ids: DataFrame) -> DataFrame:
    """Rank correlations of the listed signals. An id is matched exactly, else without regard to case. Fails if one has none, or if none is listed.

    Of two names that differ in case alone, an id that equals one doesn't take the other.
    """
    wanted = ids.select(F.col("alpha_id").alias("_id")).distinct()
    if not wanted.limit(1).count():
        raise ValueError("no ids to restrict to")
    names = ic.select("alpha_id").distinct()
    exact = wanted.join(names, F.col("_id") == F.col("alpha_id"), "left_semi")
    loose = wanted.join(exact, "_id", "left_anti")
    met = exact.select("_id", F.col("_id").alias("alpha_id")).unionByName(loose.join(names, F.lower("_id") == F.lower("alpha_id")))
    lost = wanted.join(met, "_id", "left_anti")
    if missing := [r["_id"] for r in lost.orderBy("_id").limit(5).collect()]:
        raise ValueError(f"no rank correlations for {missing}")
    return ic.join(F.broadcast(met.select("alpha_id").distinct()), "alpha_id", "left_semi")
