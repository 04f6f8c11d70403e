"""Shared plumbing of the training-data operators: tables, scratch space, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside this ASCII white space class.
WHITE = r"\x20\x09-\x0D"
WORD = rf"[^{WHITE}]+"
_WHITE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"

_own_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or a temporary one for a purely local session."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        master = conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_scratch[app] = tempfile.mkdtemp(prefix="crosspanel-")
        atexit.register(shutil.rmtree, _own_scratch[app], ignore_errors=True)
    return _own_scratch[app]


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = f"{scratch_root(df.sparkSession)}/stash-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own(name: str, df: DataFrame) -> str:
    """A column name that ``df`` hasn't, in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start offsets, end offsets) of a string or binary Arrow array, without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    off = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start, end = off[:-1], off[1:].copy()
    if column.null_count:
        null = column.is_null().to_numpy(zero_copy_only=False)
        end[null] = start[null]
    return raw, start, end


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    raw, start, end = buffers(column)
    view = memoryview(raw)
    return [bytes(view[a:b]) for a, b in zip(start.tolist(), end.tolist())]


def squeeze(text: bytes) -> bytes:
    """The text without its ASCII white space."""
    return text.translate(None, _WHITE_BYTES)


def code_points(text: bytes) -> int:
    """Code points of valid UTF-8: bytes that are not continuation bytes."""
    if len(text) < 64:
        return len(text.decode("utf-8", "replace"))
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Let Arrow batches hold about ``size`` of data: ten thousand long texts at once are too much for a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """``small_batches`` for the actions inside of the block; the session's own setting is back after it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow whose worker gives free memory back to the system when a task ends; workers are reused."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def join_spread(left: DataFrame, right: DataFrame, key: str, count: str, total: int, floor: int = 2_000) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row a key and in ``count`` how many rows of ``left`` have it.

    Keys of more than ``floor`` rows and more than a hundred-thousandth of all ``total`` rows are at most 100,000: these rows
    of ``right`` are broadcast, so that no task gathers the rows of a hot key. The others meet in a shuffle. ``left`` is read twice.
    """
    big = max(floor, total // 100_000)
    hot, cold = right.filter(F.col(count) > big).drop(count), right.filter(F.col(count) <= big).drop(count)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h
