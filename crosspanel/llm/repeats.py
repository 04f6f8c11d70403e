"""Finding repeated fixed-length windows of symbol sequences (words or bytes) across a corpus.

Consecutive windows that share their minimal k-gram hash (the minimizer) form a run. Equal windows have equal minimizers, so
runs dealt by minimizer meet every window they can equal, at a twelfth (words) or less of the rows that single windows take.
Minimizers that a sample of documents shows to be very frequent are hot; their windows are dealt one by one, by their own
hash. What the sample misses is cut where it comes (``by_key_cut``), so no task holds a whole frequent key. A sender passes
on a run that it sees again and again twice; further copies are known to be repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64

#: Multiplier of the polynomial hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
#: Longest run in one record.
RUN = 256
#: Bytes kept of a window's hash; with the 64 bits of the minimizer they identify a window.
CODE = 6


class Roller:
    """Rabin-Karp hashes of all windows of a sequence of unsigned 64-bit symbols."""

    def __init__(self) -> None:
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.power):
            for name, base in (("power", BASE), ("inverse", _INVERSE)):
                step = np.full(n, base, np.uint64)
                step[0] = 1
                setattr(self, name, np.cumprod(step, dtype=np.uint64))

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        self.grow(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.power[: len(symbols)], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, length: int) -> np.ndarray:
        n = len(prefix) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix64((prefix[length:] - prefix[:n]) * self.inverse[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


def runs_of(valid: np.ndarray, key: np.ndarray, cap: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of runs among the valid windows with one key, cut to ``cap`` windows."""
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) != 1) | (key[at[1:]] != key[at[:-1]])
    first = np.flatnonzero(fresh)
    length = np.diff(np.append(first, len(at)))
    if (length > cap).any():
        inside = np.arange(len(at)) - np.repeat(first, length)
        first = np.flatnonzero(fresh | (inside % cap == 0))
        length = np.diff(np.append(first, len(at)))
    return at[first], length


class Seen:
    """How often a task has sent each run so far (it counts to two). Forgetting is harmless: a run is then sent again.

    Runs are told apart by two 64-bit halves of a digest; of two that share the first half only one is remembered.
    """

    def __init__(self, most: int = 3_000_000) -> None:
        self.first, self.second, self.count, self.most = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), most

    def keep(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Which of these to send; the others have been sent twice."""
        if len(self.first) > self.most:
            self.__init__(self.most)
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(a)))
        rank = np.arange(len(a)) - np.repeat(head, size)
        da, db = a[head], b[head]
        at = np.minimum(np.searchsorted(self.first, da), max(0, len(self.first) - 1))
        met = (self.first[at] == da) & (self.second[at] == db) if len(self.first) else np.zeros(len(da), bool)
        before = np.where(met, self.count[at], 0) if len(self.first) else np.zeros(len(da), np.int64)
        out = np.empty(len(first), bool)
        out[order] = rank + np.repeat(before, size) < 2
        self.count[at[met]] = np.minimum(before + size, 2)[met]
        fresh = ~met
        _, new = np.unique(np.concatenate([self.first, da[fresh]]), return_index=True)  # what is remembered comes first
        self.first, self.second, self.count = (np.concatenate([x, y[fresh]])[new] for x, y in ((self.first, da), (self.second, db), (self.count, np.minimum(size, 2))))
        return out


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def by_key(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of about ``least`` rows from batches sorted by ``key``; no key is cut."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column("key").to_numpy()
        cut = int(np.flatnonzero(keys == keys[-1])[0])
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).to_batches()
        rows -= cut
    if rows:
        yield pa.Table.from_batches(held)


def by_key_cut(batches: Iterator[pa.RecordBatch], least: int, most: int) -> Iterator[tuple[pa.Table, bool, bool]]:
    """(table, begun, goes_on): as ``by_key``, but a key of more than ``most`` rows is cut, so tables are bounded.

    ``begun``: rows of the first key may have been in tables before; ``goes_on``: rows of the last key may come in later ones.
    """
    held: list[pa.RecordBatch] = []
    rows, begun = 0, False
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column("key").to_numpy()
        cut = int(np.flatnonzero(keys == keys[-1])[0])
        if cut:
            yield whole.slice(0, cut), begun, False
            begun, rows = False, rows - cut
        held = whole.slice(cut).to_batches()
        if rows >= most:
            yield whole.slice(cut), begun, True
            held, rows, begun = [], 0, True
    if rows:
        yield pa.Table.from_batches(held), begun, False


def repeated_rows(batches: Iterator[pa.RecordBatch], least: int, most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, flags) of rows sorted by ``key`` and ``proof``: flagged if another row has both. Equals are found by binary search.

    Tables are bounded, however many rows are equal: the last row of one is compared with the first ones of the next.
    """
    carry, last = None, None
    for t, _, goes_on in by_key_cut(batches, least, most):
        if carry is not None:
            t, carry = pa.concat_tables([carry, t]), None
        key, proof = t.column("key").to_numpy(), t.column("proof").to_numpy()
        order = np.lexsort((proof, key))
        key, proof = key[order], proof[order]
        twin = np.searchsorted(key, key, side="right") - np.searchsorted(key, key, side="left") > 1
        same = (key[1:] == key[:-1]) & (proof[1:] == proof[:-1])
        twin &= np.append(same, False) | np.append(False, same)
        if last is not None:
            twin |= (key == last[0]) & (proof == last[1])
        last = key[-1], proof[-1]
        flags = np.empty(len(key), bool)
        flags[order] = twin
        if goes_on and not twin[-1]:
            at = int(order[-1])
            carry, last = t.slice(at, 1), None
            rest = np.delete(np.arange(len(key)), at)
            t, flags = t.take(pa.array(rest)), flags[rest]
        yield t, flags
    if carry is not None:
        yield carry, np.zeros(1, bool)


def flagged_spans(flag: np.ndarray, record: np.ndarray, position: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, begin, end) of the covered symbols, one for each stretch of flagged windows in a record."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (record[at[1:]] != record[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return record[at[first]], position[at[first]], position[at[last]] + window


def merge(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, sorted; touching ones become one."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > end[:-1])
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:], len(begin)) - 1]


def with_spans(docs: DataFrame, spans: DataFrame, text: Column) -> DataFrame:
    """``id, text, spans``: each document with the list of its intervals (null: none).

    Documents with the same id and the same text share their intervals. Both sides meet by id and a hash of the text.
    """
    lists = spans.groupBy("id", "print").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))  # repeated rows find equal intervals
    lists = lists.select(F.col("id").alias("_id"), F.col("print").alias("_print"), "spans")
    left = docs.select("id", F.xxhash64(text).alias("print"), text.alias("text"))
    return left.join(lists, left["id"].eqNullSafe(lists["_id"]) & (left["print"] == lists["_print"]), "left").select("id", "text", "spans")


def span_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list offsets, begins, ends) of a column of lists of intervals."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    flat = column.flatten()
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return offsets, flat.field("begin").to_numpy().astype(np.int64), flat.field("end").to_numpy().astype(np.int64)
