"""Events of test 2: jump days, declustered to episodes, with salience arms, windows and market covariates.

Events are some ten to some hundred rows and the calendar some ten thousand; both are built from tables of a row per date.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import DAYS, day_range, handed

WINDOW, GAP, LEAST_DAYS = 21, 21, 15
# White space of all scripts.
WHITE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def dominant_category(shares: list[str], labels: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(name, share) of the largest of several columns, the first of equals; nulls count as 0."""
    values = F.array(*(F.coalesce(F.col(c), F.lit(0.0)) for c in shares))
    names = F.array(*(F.lit((labels or {}).get(c, c)) for c in shares))
    top = F.array_max(values)
    return F.element_at(names, F.array_position(values, top).cast("int")), top


def jumps(raw: DataFrame, shares: list[str], first: str, last: str, labels: dict[str, str] | None = None) -> DataFrame:
    """Jump days with return, clarity and confidence within [first, last], and their dominant category."""
    name, share = dominant_category(shares, labels)
    kept = raw.na.drop("any", subset=["date", "ret", "clarity", "confidence"]).filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return kept.select("date", "ret", "clarity", "confidence", name.alias("category"), share.alias("category_share"))


def descriptions(passages: DataFrame) -> DataFrame:
    """``date, description``: the shortest usable text of each date, the least of equally short ones."""
    text = stripped(F.col("description"))
    kept = passages.filter("date is not null").withColumn("description", text).filter((F.length("description") > 0) & ~F.lower("description").isin("nan", "none"))
    order = Window.partitionBy("date").orderBy(F.length("description"), "description")
    return kept.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("date", "description")


def stripped(text: Column, ends: str = "both") -> Column:
    """Text without white space of any kind at its end, or at both ends."""
    return F.regexp_replace(text, rf"{WHITE}+\z" if ends == "right" else rf"\A{WHITE}+|{WHITE}+\z", "")


def described(events: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds ``description`` of each event's date, empty where there is none. ``texts`` has one row a date at most."""
    found = texts.select(F.col("date").alias("_date"), F.col("description"))
    return events.join(F.broadcast(found), F.col("date") == F.col("_date"), "left").drop("_date").withColumn("description", F.coalesce("description", F.lit("")))


def label(description: Column, category: Column) -> Column:
    """An event's line in the report: its shortened description or a stand-in, and its category in brackets."""
    text = F.when(F.length(description) > 0, shorten(description)).otherwise("[no description]")
    return F.when(F.length(category) > 0, F.concat(text, F.lit("  ("), category, F.lit(")"))).otherwise(text)


def event_list(events: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """``event_id, date, ret, consensus, matches, label`` of the usable events of high salience; matches are missing without a geometry.

    ``pairs`` (event_id, low_id) has the low events within the caliper; ``events`` have a description.
    """
    high = events.filter("usable and salience = 'high'")
    n = None if pairs is None else pairs.groupBy("event_id").agg(F.count(F.lit(1)).alias("matches"))
    met = high.withColumn("matches", F.lit(None).cast("long")) if n is None else high.join(F.broadcast(n), "event_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))
    return met.select("event_id", "date", "ret", "consensus", "matches", label(F.col("description"), F.coalesce("category", F.lit(""))).alias("label"))


def event_counts(jump_days: DataFrame, episodes: DataFrame) -> DataFrame:
    """``section, item, value``: the report's counts of jumps, episodes and arms; an arm holds usable episodes, the middle is what is left."""
    arm = lambda v: F.count_if(F.col("usable") & (F.col("salience") == v))
    counts = episodes.agg(F.count(F.lit(1)).alias("episodes"), arm("high").alias("high"), arm("low").alias("low")).withColumn("middle", F.col("episodes") - F.col("high") - F.col("low"))
    both = counts.crossJoin(jump_days.agg(F.count(F.lit(1)).alias("jumps")))  # one row each
    return both.unpivot([], ["jumps", "episodes", "high", "low", "middle"], "item", "value").select(F.lit("events").alias("section"), "item", F.col("value").cast("double").alias("value"))


def shorten(text: Column, most: int = 58) -> Column:
    """Text of at most ``most`` characters; of longer ones the last three are dots, without white space before them."""
    cut = stripped(F.substring(text, 1, most - 3), "right")
    return F.when(F.length(text) > most, F.concat(cut, F.lit("..."))).otherwise(text)


def as_of(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows of ``days`` with the position of the first calendar date on or after theirs; -1 beyond the end.

    Both are sorted together within ranges of days: the next calendar row's position is a running minimum from below, and beyond
    the range's end the least position of later ranges; no range join.
    """
    marks = days.select("date", F.lit(None).cast("int").alias("tpos"), F.lit(1).alias("side")).unionByName(calendar.select("date", F.col("tpos").cast("int").alias("tpos"), F.lit(0).alias("side")))
    marks = handed(marks.withColumn("_range", day_range("date")), "_range", later={"after_min": F.min("tpos")})
    ahead = Window.partitionBy("_range").orderBy(F.col("date"), F.desc("side")).rowsBetween(0, Window.unboundedFollowing)
    found = marks.withColumn("next", F.coalesce(F.min("tpos").over(ahead), "after_min")).filter("side = 1").select("date", F.coalesce("next", F.lit(-1)).alias("tpos")).distinct()
    return days.join(found, "date")


def decluster(mapped: DataFrame, gap: int = GAP) -> DataFrame:
    """One anchor for each chain of jumps at most ``gap`` days apart: greatest clarity, then absolute return, then the earliest.

    Adds ``cluster`` and ``episode_n_jumps``. Chains are found over ranges of positions: a range is handed the last position
    before it, and how many chains began in earlier ranges.
    """
    rows = mapped.filter("tpos >= 0").withColumn("_range", F.floor(F.col("tpos") / DAYS).cast("int"))
    order = Window.partitionBy("_range").orderBy("tpos", "date")
    rows = handed(rows, "_range", earlier={"_last_max": F.max("tpos")})
    fresh = F.when(F.col("tpos") - F.coalesce(F.lag("tpos").over(order), "_last_max") <= gap, 0).otherwise(1)
    rows = handed(rows.withColumn("_new", fresh), "_range", earlier={"_chains_sum": F.sum("_new")})
    own = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    chained = rows.withColumn("cluster", (F.coalesce("_chains_sum", F.lit(0)) + own - 1).cast("int"))
    best = Window.partitionBy("cluster").orderBy(F.desc("clarity"), F.desc(F.abs("ret")), "date")
    counted = chained.withColumn("episode_n_jumps", F.count(F.lit(1)).over(Window.partitionBy("cluster")))
    return counted.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "_new", "_range", "_last_max", "_chains_sum")


def salience(episodes: DataFrame) -> DataFrame:
    """Adds ``consensus``, half the z-scores of clarity and confidence, and ``salience``: low up to the lower quartile, else high from the upper, else middle."""
    names = ("clarity", "confidence")
    spread = episodes.agg(*(f(c).alias(f"_{n}_{c}") for c in names for n, f in (("mean", F.avg), ("sd", F.stddev_samp))))
    z = lambda c: (F.col(c) - F.col(f"_mean_{c}")) / F.when(F.col(f"_sd_{c}") != 0, F.col(f"_sd_{c}"))
    scored = episodes.crossJoin(F.broadcast(spread)).withColumn("consensus", 0.5 * z("clarity") + 0.5 * z("confidence")).drop(*spread.columns)  # one row
    q = scored.agg(F.percentile("consensus", F.lit(0.25)).alias("_low"), F.percentile("consensus", F.lit(0.75)).alias("_high"))
    arm = F.when(F.col("consensus") <= F.col("_low"), "low").when(F.col("consensus") >= F.col("_high"), "high").otherwise("middle")
    return scored.crossJoin(F.broadcast(q)).withColumn("salience", arm).drop("_low", "_high")  # one row


def windows(episodes: DataFrame, n_days: int, width: int = WINDOW) -> DataFrame:
    """Adds the centred window [window_start, window_end] in calendar positions, ``usable`` if it lies inside, and ``event_id``."""
    start = F.col("tpos") - width // 2
    out = episodes.withColumns({"window_start": start, "window_end": start + width - 1, "event_id": F.concat(F.lit("E"), F.date_format("date", "yyyyMMdd"))})
    return out.withColumn("usable", (F.col("window_start") >= 0) & (F.col("window_end") < n_days))


def market(panel: DataFrame) -> DataFrame:
    """``date, mkt_ret, cs_std``: mean and dispersion of returns over symbols."""
    return panel.groupBy("date").agg(F.avg("returns").alias("mkt_ret"), F.stddev_samp("returns").alias("cs_std"))


def event_days(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """``event_id, tpos, date``: the days of each usable window, by an equality join on exploded positions."""
    days = events.filter("usable").select("event_id", F.explode(F.sequence("window_start", "window_end")).alias("tpos"))
    return days.join(calendar, "tpos")


def window_covariates(events: DataFrame, calendar: DataFrame, market_days: DataFrame, least: int = LEAST_DAYS) -> DataFrame:
    """``event_id, realized_vol, drawdown, dispersion`` over each window; NULL with fewer than ``least`` returns.

    Drawdown is the largest loss from the running maximum of cumulative returns, whose first value is that of the first day.
    """
    rows = event_days(events, calendar).join(market_days, "date", "left")
    have = rows.filter("mkt_ret is not null")
    sofar = Window.partitionBy("event_id").orderBy("tpos").rowsBetween(Window.unboundedPreceding, 0)
    curve = have.withColumn("c", F.product(1 + F.col("mkt_ret")).over(sofar)).withColumn("m", F.max("c").over(sofar))
    enough = F.count("mkt_ret") >= least
    loss = F.max(1 - F.col("c") / F.when(F.col("m") != 0, F.col("m")))
    return curve.groupBy("event_id").agg(
        F.when(enough, F.stddev_samp("mkt_ret") * math.sqrt(252)).alias("realized_vol"), F.when(enough, loss).alias("drawdown"), F.when(enough, F.avg("cs_std")).alias("dispersion")
    )
