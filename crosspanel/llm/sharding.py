"""Sharding by jump consistent hashing (native: DataFrame functions only).

The generator of the published algorithm is a keyed hash of (key, step), so a row's shard
depends on its key and the number of shards alone, and one more shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Bytes that every row costs besides its text.
ROW_OVERHEAD = 16


def jump_hash(key: Column, shards: int) -> Column:
    """STRUCT<shard, next>: the shard among ``shards``, and the first jump target at or beyond ``shards``.

    ``next = shards`` says that with one more shard the row moves to the new one; otherwise it stays.
    A jump always goes forward, so ``shards`` steps are enough. A null key is a key like any other.
    """

    def step(state: Column, i: Column) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(key, i), 11) + F.lit(1)).cast("double") / F.lit(float(2**53))
        target = F.floor((state["next"] + F.lit(1)).cast("double") / unit).cast("long")
        moved = F.struct(state["next"].alias("shard"), target.alias("next"))
        return F.when(state["next"] < F.lit(shards), moved).otherwise(state)

    start = F.struct(F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1024) -> DataFrame:
    """Assign every row to a shard and a gapless slot in it.

    Returns ``id_col, size, text_crc32, law, shard, slot, grown_shard``. ``size`` is the UTF-8 length of the
    text plus 16; a null text has length 0 and checksum 0. Rows with a null id share one shard, repeated rows each
    get a slot of their own, an empty table gives an empty result, and other columns of the input are not read.
    The law is ``key``: equal texts under different ids may lie in different shards.

    Slots follow (bucket, id, checksum, size) within a shard. A shard is numbered in ``buckets`` pieces, so that no
    task holds a whole shard; the table of piece offsets has at most ``shards * buckets`` rows and is broadcast.
    """
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
        jump_hash(F.col(id_col), shards).alias("jump"),
    ).select(
        "id", "size", "crc",
        F.col("jump.shard").cast("int").alias("shard"),
        F.when(F.col("jump.next") == shards, F.lit(shards)).otherwise(F.col("jump.shard")).cast("int").alias("grown"),
        F.pmod(F.xxhash64("id", "crc", "size"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    slim = stash(slim, "shard")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slim.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("id", "crc", "size")
    return (
        slim.withColumn("rank", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select(
            F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
            (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"), F.col("grown").alias("grown_shard"),
        )
    )
