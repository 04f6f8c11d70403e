"""Exact dedup by a Golomb-coded fingerprint exchange.

Every input partition (a sender) sorts its distinct 64-bit fingerprints and sends each hash range, Rice-coded, to the
owner of the range. Owners answer with one bit per fingerprint: seen in another sender too. Only rows whose fingerprint
occurs twice (suspects) have their texts shuffled, and they are grouped by their bytes. Everything else stays where it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import code_points, join_spread, partitions, small_batches, squeeze, stash, text_bytes, tidy

#: Up to so many suspect fingerprints (8 bytes each) are broadcast; beyond that the texts meet them in a shuffled join.
BROADCAST_FINGERPRINTS = 1_000_000


def golomb_encode(values: np.ndarray) -> bytes:
    """Rice code (a Golomb code with a power of two) of sorted distinct unsigned 64-bit values.

    The first value is sent as it is; the parameter follows from the gaps between values, wherever their range begins.
    """
    n = len(values)
    if n == 0:
        return b""
    delta = np.diff(values)
    k = max(0, (int(values[-1] - values[0]) // n).bit_length() - 1)
    quotient = (delta >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1)
    unary = np.zeros(int(ends[-1]) if n > 1 else 0, np.uint8)
    unary[ends - 1] = 1
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    low = ((delta[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    head = np.array([n, k, len(unary)], "<i8").tobytes() + values[:1].astype("<u8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def golomb_decode(code: bytes) -> np.ndarray:
    if not code:
        return np.zeros(0, np.uint64)
    n, k, bits = (int(x) for x in np.frombuffer(code, "<i8", 3))
    cut = 32 + (bits + 7) // 8
    first = np.frombuffer(code[24:32], "<u8")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code[32:cut], np.uint8), count=bits))
    quotient = np.diff(ends, prepend=-1) - 1
    delta = quotient.astype(np.uint64) << np.uint64(k)
    if k:
        low = np.unpackbits(np.frombuffer(code[cut:], np.uint8), count=(n - 1) * k).reshape(n - 1, k)
        for column in range(k):
            delta |= low[:, column].astype(np.uint64) << np.uint64(k - 1 - column)
    return np.concatenate([first, first + np.cumsum(delta, dtype=np.uint64)]).astype(np.uint64)


def _digest(text: bytes) -> bytes:
    return hashlib.sha256(squeeze(text)).digest()


def _send(owners: int, id_type: pa.DataType):
    step = (1 << 64) // owners + 1
    out = pa.schema([("id", id_type), ("row", pa.int64()), ("sha", pa.binary()), ("points", pa.int32()), ("sender", pa.int32()), ("owner", pa.int32()), ("slot", pa.int32()), ("local", pa.bool_()), ("code", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = TaskContext.get().partitionId()
        ids, digests, points = [], [], []
        for batch in batches:
            texts = text_bytes(batch.column(1))
            ids.append(batch.column(0))
            digests.append(b"".join(map(_digest, texts)))
            points.append(np.fromiter(map(code_points, texts), np.int32, len(texts)))
        if not ids:
            return
        sha = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
        prints = np.ascontiguousarray(sha[:, :8]).view(">u8").ravel().astype(np.uint64)
        distinct, inverse, count = np.unique(prints, return_inverse=True, return_counts=True)
        owner = (distinct // np.uint64(step)).astype(np.int32)
        found, first = np.unique(owner, return_index=True)
        slot = np.arange(len(distinct)) - np.repeat(first, np.diff(np.append(first, len(distinct))))
        n, width = len(prints), 32
        rows = {
            "id": pa.chunked_array(ids, type=id_type).combine_chunks(),
            "row": pa.array((np.int64(sender) << 32) + np.arange(n)),
            "sha": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(sha.tobytes())]),
            "points": pa.array(np.concatenate(points)),
            "sender": pa.array(np.full(n, sender, np.int32)),
            "owner": pa.array(owner[inverse]),
            "slot": pa.array(slot[inverse].astype(np.int32)),
            "local": pa.array(count[inverse] > 1),
        }
        yield pa.RecordBatch.from_arrays([rows.get(f.name, pa.nulls(n, f.type)) for f in out], schema=out)
        bounds = [*first.tolist(), len(distinct)]
        codes = [golomb_encode(distinct[a:b]) for a, b in zip(bounds, bounds[1:])]
        sent = {"sender": pa.array(np.full(len(codes), sender, np.int32)), "owner": pa.array(found.astype(np.int32)), "code": pa.array(codes, pa.binary())}
        yield pa.RecordBatch.from_arrays([sent.get(f.name, pa.nulls(len(codes), f.type)) for f in out], schema=out)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One owner task: a bit per received fingerprint, set if another sender has it too."""
    whole = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if whole is None or not whole.num_rows:
        return
    values = [golomb_decode(c) for c in whole.column("code").to_pylist()]
    distinct, count = np.unique(np.concatenate(values), return_counts=True)
    repeated = distinct[count > 1]
    bits = []
    for v in values:
        at = np.minimum(np.searchsorted(repeated, v), max(0, len(repeated) - 1))
        hit = repeated[at] == v if len(repeated) else np.zeros(len(v), bool)
        bits.append(np.packbits(hit, bitorder="little").tobytes() if hit.any() else None)
    some = pa.array([i for i, b in enumerate(bits) if b], pa.int64())
    yield pa.RecordBatch.from_pydict({"sender": whole.column("sender").take(some).combine_chunks(), "owner": whole.column("owner").take(some).combine_chunks(), "bits": pa.array([b for b in bits if b], pa.binary())})


def _reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_bytes(batch.column(1))
        squeezed = [squeeze(t) for t in texts]
        prints = np.frombuffer(b"".join(hashlib.sha256(s).digest()[:8] for s in squeezed), ">i8").astype(np.int64)
        points = np.fromiter(map(code_points, texts), np.int32, len(texts))
        yield pa.RecordBatch.from_pydict({"print": pa.array(prints), "id": batch.column(0), "points": pa.array(points), "squeezed": pa.array(squeezed, pa.binary())})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without their ASCII white space; a null text is empty. Of equal texts
    the row with the most code points, then the smallest id (null ids last), stays; of fully repeated rows one stays.
    An empty table gives an empty result; other columns of the input are not read. A group of copies of any size is
    combined before its shuffle, so no task gathers it.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    owners = partitions(spark)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType
    sent_schema = T.StructType([
        T.StructField("id", kind), T.StructField("row", T.LongType()), T.StructField("sha", T.BinaryType()), T.StructField("points", T.IntegerType()), T.StructField("sender", T.IntegerType()),
        T.StructField("owner", T.IntegerType()), T.StructField("slot", T.IntegerType()), T.StructField("local", T.BooleanType()), T.StructField("code", T.BinaryType()),
    ])
    from pyspark.sql.pandas.types import to_arrow_type

    sent = stash(slim.mapInArrow(tidy(_send(owners, to_arrow_type(kind))), sent_schema), "fingerprints")
    rows = sent.filter(F.col("row").isNotNull()).drop("code")
    bitmaps = sent.filter(F.col("code").isNotNull()).select("sender", "owner", "code").repartition(owners, "owner").mapInArrow(tidy(_answer), "sender int, owner int, bits binary")
    seen = F.coalesce(F.expr("shiftright(cast(conv(hex(substring(bits, (slot div 8 + 1)::int, 1)), 16, 10) as int), slot % 8) & 1") == 1, F.lit(False))
    flagged = stash(rows.join(bitmaps, ["sender", "owner"], "left").select("id", "row", "sha", "points", (F.col("local") | seen).alias("suspect")), "flags")
    single = flagged.filter(~F.col("suspect")).select("id", F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"), "sha")
    suspects = flagged.filter("suspect")
    wanted = stash(suspects.select(F.conv(F.hex(F.substring("sha", 1, 8)), 16, -10).cast("long").alias("print")).distinct(), "suspects")
    small = wanted.limit(BROADCAST_FINGERPRINTS + 1).count() <= BROADCAST_FINGERPRINTS
    texts = slim.mapInArrow(tidy(_reread), T.StructType([T.StructField("print", T.LongType()), T.StructField("id", kind), T.StructField("points", T.IntegerType()), T.StructField("squeezed", T.BinaryType())]))
    texts = texts.join(F.broadcast(wanted) if small else wanted, "print", "left_semi")
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("none"), "id"))
    groups = texts.groupBy("print", "squeezed").agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
    groups = stash(groups.select(F.unhex(F.sha2("squeezed", 256)).alias("sha"), "size", F.col("best.id").alias("keep"), (-F.col("best.points")).alias("most")), "groups")
    # the row that stays is met by (text, id, length), whose rows are combined first: copies of one text spread
    top = suspects.groupBy("sha", "id", "points").agg(F.min("row").alias("row")).join(groups.select(F.col("sha").alias("_sha"), "keep", "most"), (F.col("sha") == F.col("_sha")) & F.col("id").eqNullSafe(F.col("keep")) & (F.col("points") == F.col("most")))
    winners = top.groupBy("sha").agg(F.min("row").alias("winner"))
    decided = stash(groups.join(winners, "sha").select("sha", "keep", "size", "winner"), "decided")
    copies = join_spread(suspects, decided.withColumn("many", F.col("size")), "sha", "many", suspects.count()).select("id", "keep", "size", (F.col("row") == F.col("winner")).alias("kept"), "sha")
    both = single.unionByName(copies)
    return both.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))
