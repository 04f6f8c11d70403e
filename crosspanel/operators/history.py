"""Long histories: row numbers, blocks of time with the rows around them, and exponential means as scans.

A window by symbol puts a symbol's whole history into one task. Here rows are numbered by two levels of counts, cut into
blocks of equal length, and each block is sent the rows before and after it that its windows reach.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import DATE, SYMBOL

ROW, BLOCK, AROUND = "_rn", "_block", "_around"
#: Days of a bucket in which rows are counted and numbered.
DAYS = 64
#: Decay beyond which a weight no longer changes a double: exp(-60).
DECAY = 60.0


def numbered(df: DataFrame, name: str = ROW) -> DataFrame:
    """Adds a row's number within its symbol, from 1 by date. Buckets of days are counted, counts summed, rows numbered within a bucket.

    No task gets a symbol's rows, only its bucket counts. Dates of a symbol must differ.
    """
    bucket = F.floor(F.datediff(F.col(DATE), F.lit("1970-01-01").cast("date")) / DAYS).cast("int")
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(SYMBOL).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(SYMBOL, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select(SYMBOL, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy(SYMBOL, "_bucket").orderBy(DATE))
    return rows.join(first, [SYMBOL, "_bucket"]).withColumn(name, (F.col("_first") + own).cast("long")).drop("_bucket", "_first")


def with_surroundings(df: DataFrame, length: int, back: int, ahead: int) -> DataFrame:
    """Each row of ``df`` (with ROW) in its block, and again in the block after or before it if that block's windows reach it.

    ``length`` must not be less than either reach. Copies have AROUND set, to be dropped when the windows are done.
    """
    place, block = (F.col(ROW) - 1) % length, F.floor((F.col(ROW) - 1) / length).cast("long")
    blocks = F.array(block, *([F.when(place >= length - back, block + 1)] if back else []), *([F.when(place < ahead, block - 1)] if ahead else []))
    spread = df.withColumn(BLOCK, F.explode(F.filter(blocks, lambda b: b.isNotNull())))
    return spread.withColumn(AROUND, F.col(BLOCK) != block)


def ewm_frame(df: DataFrame, x: Column, span: float, recursive: bool, name: str) -> DataFrame:
    """Adds ``name``: the exponentially weighted mean of x by symbol with weight 2 / (span + 1), linear in the rows.

    Older rows decay across gaps, gaps carry the last value. ``recursive``: the first value has full weight and later ones that of
    the recursion. A symbol's rows are cut where the decay since the cut has reached DECAY; within a block the weighted sums are
    running sums of values over their decay, and one state comes over from the block before: what lies further back has lost all
    weight. States are (decayed sum, decayed weight) at a block's end.
    """
    keep = 1.0 - 2.0 / (span + 1)
    if not 0 < keep < 1:
        raise ValueError(f"a span of {span}: it must exceed 1")
    own = Window.partitionBy(SYMBOL).orderBy(DATE)
    sofar = own.rowsBetween(Window.unboundedPreceding, 0)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    c = {k: f"{name}_{k}" for k in ("x", "i", "g", "l", "b", "c", "t", "w", "p", "y")}
    col = lambda k: F.col(c[k])
    rows = df.withColumn(c["x"], x).withColumn(c["i"], F.row_number().over(own))
    seen = col("x").isNotNull()
    if recursive:
        # a value's decay and weight follow from its distance to the value before it; the first one has none
        rows = rows.withColumn(c["g"], col("i") - F.last(F.when(seen, col("i")), ignorenulls=True).over(before))
        old = F.pow(F.lit(keep), col("g"))
        share = old / (old + (1 - keep))
        loss = F.when(~seen | col("g").isNull(), 0.0).when(share > math.exp(-2 * DECAY), -F.log(F.when(share > 0, share))).otherwise(2 * DECAY)
        weight = F.coalesce((1 - keep) / (old + (1 - keep)), F.lit(1.0))
        rows = rows.withColumn(c["l"], loss).withColumn(c["b"], F.floor(F.sum(c["l"]).over(sofar) / DECAY))
    else:
        length = math.ceil((DECAY - math.log(1 - keep)) / -math.log(keep))
        weight = F.lit(1.0)
        rows = rows.withColumn(c["l"], F.lit(-math.log(keep))).withColumn(c["b"], F.floor((col("i") - 1) / length))
    within = Window.partitionBy(SYMBOL, c["b"]).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(c["c"], F.sum(c["l"]).over(within)) if recursive else rows.withColumn(c["c"], ((col("i") - 1) % length + 1) * -math.log(keep))
    grown = F.exp(col("c"))
    rows = rows.withColumns({c["t"]: F.coalesce(F.sum(weight * col("x") * grown).over(within), F.lit(0.0)), c["w"]: F.coalesce(F.sum(F.when(seen, weight * grown)).over(within), F.lit(0.0))})
    # the state at the end of the last block before this one, and how much it decays up to there
    past = Window.partitionBy(SYMBOL).orderBy(c["b"]).rangeBetween(Window.unboundedPreceding, -1) if recursive else Window.partitionBy(SYMBOL).orderBy(c["b"]).rangeBetween(-1, -1)
    state = F.struct((col("t") / grown).alias("t"), (col("w") / grown).alias("w"))
    rows = rows.withColumn(c["p"], F.max_by(state, col("i")).over(past))
    top, low = col("t") + F.coalesce(col("p")["t"], F.lit(0.0)), col("w") + F.coalesce(col("p")["w"], F.lit(0.0))
    rows = rows.withColumn(c["y"], F.when(seen & (low > 0), top / F.when(low > 0, low)))
    return rows.withColumn(name, F.last(c["y"], ignorenulls=True).over(sofar)).drop(*c.values())
