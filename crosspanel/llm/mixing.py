"""Mixing sources to target weights with a low-discrepancy schedule.

Slot i of the mix has the golden-ratio point i * phi mod 1. Mapped through the cumulative slot shares of the sources, it
names the source whose next block of shuffled words comes. Blocks of a source hold equally many words; ranks of its slots
deal them round robin, so the k-th pass over a source starts only after the one before has ended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, word_count

#: The golden ratio's fraction as an odd 32-bit multiplier: i * PHI mod 2**32 is the point of slot i.
PHI = 2654435769
_RING = 1 << 32
#: Cells of the ring, for looking up the source of a point.
_CELLS = 4096


@dataclass(frozen=True)
class Share:
    """One source of a mix. Blocks hold ``block`` words, the last one the rest; ``low <= point < high`` are its slots."""

    source: str | None
    size: int
    target: float
    block: int
    blocks: int
    low: int
    high: int


def fill(sizes: list[int], weights: list[float], ceiling: float) -> list[float]:
    """Share the sum of sizes by weight; what exceeds ``ceiling`` times a size is shared again among the rest."""
    left, mass = float(sum(sizes)), float(sum(weights))
    target = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (ceiling * sizes[i] / weights[i], i))
    for at, i in enumerate(order):
        if left * weights[i] / mass <= ceiling * sizes[i]:
            for j in order[at:]:
                target[j] = left * weights[j] / mass
            break
        target[i] = float(ceiling * sizes[i])
        left, mass = left - target[i], mass - weights[i]
    return target


def shares(totals: list[tuple[str | None, int]], weights: tuple[float, ...], ceiling: float, block_words: int, least_blocks: int) -> tuple[list[Share], int]:
    """The plan of a mix, in the code point order of the sources (null last), and its number of slots."""
    totals = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    targets = fill([n for _, n in totals], [weights[i % len(weights)] for i in range(len(totals))], ceiling)
    block = [min(block_words, max(1, n // least_blocks)) for _, n in totals]
    slots = [t / b for t, b in zip(targets, block)]
    whole, out, run, low = sum(slots), [], 0.0, 0
    for (source, n), target, b, own in zip(totals, targets, block, slots):
        run += own
        high = int(run / whole * _RING) if whole else 0
        out.append(Share(source, n, target, b, -(-n // b), low, high))
        low = high
    return out, int(-(-whole // 1))


def _point(i: Column) -> Column:
    """i * PHI mod 2**32 without overflow."""
    i = F.pmod(i, F.lit(_RING))
    high = F.pmod(F.shiftright(i, 16) * F.lit(PHI), F.lit(_RING))
    return F.pmod(F.shiftleft(high, 16) + i.bitwiseAND(F.lit(0xFFFF)) * F.lit(PHI), F.lit(_RING))


def schedule(spark: SparkSession, plan: list[Share], slots: int) -> DataFrame:
    """The mix in order: ``slot, source_no, pass, block``. Slots beyond three full passes of a source don't exist.

    Ranks within a source are taken in chunks of about the square root of the number of slots, so no task holds a source.
    """
    cells = [(c, i, s.low, s.high, s.blocks) for i, s in enumerate(plan) if s.high > s.low for c in range(s.low * _CELLS // _RING, (s.high - 1) * _CELLS // _RING + 1)]
    lookup = spark.createDataFrame(cells, "cell long, source_no int, low long, high long, blocks long")
    chunk = max(1, int(slots**0.5))
    dealt = (
        spark.range(slots)
        .select(F.col("id").alias("slot"), _point(F.col("id")).alias("point"))
        .withColumn("cell", F.shiftright("point", 20))
        .join(F.broadcast(lookup), "cell")
        .filter("low <= point and point < high")
        .select("slot", "source_no", "blocks", F.expr(f"slot div {chunk}").alias("chunk"))
    )
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("source_no", "chunk").agg(F.count(F.lit(1)).alias("n")).select("source_no", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("source_no", "chunk").orderBy("slot")
    ranked = dealt.withColumn("rank", F.row_number().over(within)).join(offsets, ["source_no", "chunk"]).withColumn("rank", F.col("first") + F.col("rank") - 1)
    return ranked.select("slot", "source_no", F.expr("rank div blocks").alias("pass"), F.expr("rank % blocks").alias("block"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ceiling: int = 3, block_words: int = 1024, least_blocks: int = 1024,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """How many words of each document the mix takes: ``id_col, size, source_size, target, taken, source_col``.

    Sources in code point order, null last, weigh ``weights``, repeating; together they get as many words as there are.
    A target stops at ``ceiling`` times its source's size. ``taken`` counts repeats and is at most ``ceiling`` times the
    size. Null ids, texts (0 words) and sources are kept; documents without words and sources without words take 0;
    repeated rows count each; an empty table gives an empty result; other columns of the input are not read.
    The order within a source is that of a hash of the id, so reruns agree.

    The driver holds one row per source: a mix names each of its sources.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = stash(sized.withColumn("order", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))), "sizes")
    totals = [(r["source"], int(r["n"])) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    plan, slots = shares(totals, weights, ceiling, block_words, least_blocks)
    kind = "source string, source_no int, source_size long, target double, words long, blocks long"
    named = spark.createDataFrame([(s.source, i, s.size, s.target, s.block, s.blocks) for i, s in enumerate(plan)], kind)
    rows = sized.join(F.broadcast(named), sized["source"].eqNullSafe(named["source"])).drop(named["source"])
    rows = rows.withColumn("bucket", F.substring("order", 1, 3))
    full = rows.filter("size > 0")
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = full.groupBy("source_no", "bucket").agg(F.sum("size").alias("n")).select("source_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("source_no", "bucket").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = full.withColumn("end", F.sum("size").over(within)).join(offsets, ["source_no", "bucket"]).withColumn("begin", F.col("first") + F.col("end") - F.col("size"))
    pieces = placed.withColumn("block", F.explode(F.expr("sequence(begin div words, (begin + size - 1) div words)")))
    overlap = F.least(F.expr("begin + size"), F.expr("(block + 1) * words")) - F.greatest(F.col("begin"), F.expr("block * words"))
    times = schedule(spark, plan, slots).filter(F.col("pass") < ceiling).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = pieces.select("id", "source", "size", "source_size", "target", "source_no", "begin", "block", overlap.alias("part")).join(times, ["source_no", "block"], "left")
    taken = taken.groupBy("source_no", "begin", "id", "source", "size", "source_size", "target").agg(F.sum(F.col("part") * F.coalesce("times", F.lit(0))).alias("taken"))
    empty = rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["id", "size", "source_size", "target", "taken", "source"]
    both = taken.select(columns).unionByName(empty.select(columns))
    return both.select(F.col("id").alias(id_col), "size", "source_size", F.round("target", 6).alias("target"), "taken", F.col("source").alias(source_col))
