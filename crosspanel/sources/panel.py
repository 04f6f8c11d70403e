"""Panels: long tables (date, symbol, open, high, low, close, volume, returns), and their calendar.

Two time axes: a *sparse* panel counts a symbol's own rows, a *dense* one counts market dates. Densifying fills a symbol's
missing dates between its first and last one; formulas of the control catalogue run on the dense panel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import finite, ieee_div, no_nan
from ..operators.ranges import day_range, numbered_over
from .cache import kept

PRICES = ("open", "high", "low", "close", "volume")
SCHEMA = T.StructType([T.StructField("date", T.DateType()), T.StructField("symbol", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in PRICES)])


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Daily prices from Parquet: only the needed columns are read, dates cast, rows without a close dropped, returns added."""
    return clean(spark.read.parquet(path))


def clean(raw: DataFrame) -> DataFrame:
    """Typed columns, NaN to NULL, null closes dropped, and ``returns``: close over the symbol's row before, less 1."""
    typed = raw.select(F.to_date("date").alias("date"), F.col("symbol").cast("string").alias("symbol"), *(no_nan(F.col(c).cast("double")).alias(c) for c in PRICES))
    own = Window.partitionBy("symbol").orderBy("date")
    return typed.na.drop(subset=["close"]).withColumn("returns", finite(ieee_div(F.col("close"), F.lag("close").over(own)) - 1))


def calendar(panel: DataFrame) -> DataFrame:
    """``date, tpos``: the distinct dates, numbered from 0 over ranges of days."""
    days = numbered_over(panel.select("date").distinct().withColumn("_range", day_range("date")), "_range", [F.col("date")], "tpos")
    return days.select("date", (F.col("tpos") - 1).cast("int").alias("tpos"))


def densify(panel: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The panel with a row for every market date between a symbol's first and last one; ``observed`` marks the old rows.

    Each row is followed by the dates up to its symbol's next row: rows go by symbol once, as windows along time need them, and meet
    nothing but the calendar. Rows without a symbol aren't observed. Columns in ``more`` are carried along like prices.
    """
    days = calendar(panel)
    after = F.lead("tpos").over(Window.partitionBy("symbol").orderBy("tpos"))
    placed = panel.join(F.broadcast(days), "date").withColumn("_last", F.greatest("tpos", F.coalesce(after - 1, "tpos")))
    full = placed.drop("date").withColumn("_at", F.explode(F.sequence("tpos", "_last")))
    full = full.withColumn("observed", (F.col("_at") == F.col("tpos")) & F.col("symbol").isNotNull())
    full = full.withColumns({c: F.when(F.col("observed"), F.col(c)) for c in (*PRICES, "returns", *more)}).withColumn("tpos", F.col("_at"))
    return full.join(F.broadcast(days), "tpos").select("date", "symbol", *PRICES, "returns", *more, "tpos", "observed")


def trade_panel(spark: SparkSession, sf_dir: str, period: str = "week", by: str = "supplier") -> DataFrame:
    """A price panel from the order lines of the test tables: price is the unit price, a symbol is a supplier or its nation.

    First and last prices are those of the least and greatest line by date and all that prices it, since line numbers repeat.
    The panel is written at its first use: calendars, spans and formulas each start from it, and the lines are read once.
    """
    return kept(f"panel-{period}-{by}", spark, sf_dir, lambda: _trade_panel(spark, sf_dir, period, by))


def _trade_panel(spark: SparkSession, sf_dir: str, period: str, by: str) -> DataFrame:
    """Lines go by supplier as they are, once for bars and returns; a nation's bars are few, so its lines are put together first."""
    raw = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*raw, "l_suppkey")
    if by == "nation":
        supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
        lines = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(*raw, F.col("s_nationkey").cast("string").alias("symbol"))
    else:
        lines = lines.select(*raw, F.col("l_suppkey").cast("string").alias("symbol")).repartition("symbol")
    price = F.col("l_extendedprice") / F.when(F.col("l_quantity") != 0, F.col("l_quantity"))
    order = F.struct(*raw)
    lines = lines.select(F.to_date(F.date_trunc(period, "l_shipdate")).alias("date"), "symbol", price.alias("px"), order.alias("at"), F.col("l_quantity").alias("q"))
    bars = lines.groupBy("symbol", "date").agg(
        F.min_by("px", "at").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "at").alias("close"), F.sum("q").alias("volume")
    )
    return clean(bars)


def trade_panel_sql(period: str = "week", by: str = "supplier") -> str:
    """CTEs ``panel`` and ``dense`` for DuckDB, as ``trade_panel`` and ``densify``."""
    symbol, join = ("l_suppkey", "") if by == "supplier" else ("s_nationkey", "JOIN supplier ON l_suppkey = s_suppkey")
    at = "row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)"
    return f"""bars AS (
  SELECT date_trunc('{period}', l_shipdate)::DATE AS date, {symbol}::VARCHAR AS symbol, arg_min(l_extendedprice / l_quantity, {at}) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, {at}) AS close, sum(l_quantity) AS volume
  FROM lineitem {join} GROUP BY 1, 2
), panel AS (
  SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS returns FROM bars
), days AS (
  SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS tpos FROM (SELECT DISTINCT date FROM panel)
), spans AS (
  SELECT symbol, min(date) AS a, max(date) AS b FROM panel GROUP BY symbol
), dense AS (
  SELECT d.date, s.symbol, open, high, low, close, volume, returns, d.tpos, p.close IS NOT NULL AS observed
  FROM spans s JOIN days d ON d.date BETWEEN s.a AND s.b LEFT JOIN panel p ON p.date = d.date AND p.symbol = s.symbol
)"""
