"""Packing token sequences by cutting-stock column generation.

Documents are tokenised and cut into pieces of the sequence length; what is left of each is cut at a half and a quarter of it
(long items leave gaps that nothing fits), and the pieces are the items. The histogram of item
lengths, on a grid, is a cutting-stock problem: a linear program over patterns (multisets of lengths that fit a sequence),
whose columns are priced by a knapsack dynamic program. Rounded-down pattern counts, completed by best fit for the rest,
give a plan in terms of lengths; items, ranked within their length, are assigned to its slots by arithmetic.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, small_batches, stash, tidy

#: Pieces of one length are numbered in so many parts.
BUCKETS = 1024
_encodings: dict[str, tiktoken.Encoding] = {}
#: The pre-tokenizer's pattern of byte-level BPE vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def encoding(path: str) -> tiktoken.Encoding:
    """A byte-level BPE tokenizer file as an encoder with the same ids; tests hold it against the tokenizers library."""
    if path not in _encodings:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        of = byte_alphabet()
        ranks = {bytes(map(of.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
        _encodings[path] = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encodings[path]


# The white space of the pattern's ``\s``.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: White-space runs of so many characters are cut out before encoding.
LONG_RUN = 100_000


def encode(of: tiktoken.Encoding, text: str, special: bool = False) -> np.ndarray:
    """The ids of a text; ``special`` recognises special tokens, as the tokenizers library does.

    The pattern's look-ahead backtracks over a white-space run and gives up at about a million characters. So long runs are
    encoded apart, with equal ids: all of a run but its last character is one pre-token, and matching starts afresh at that
    last character; before the end of the text or a special token the whole run is one.
    """
    whole = (lambda x: of.encode_to_numpy(x, allowed_special="all")) if special else (lambda x: of.encode_to_numpy(x, disallowed_special=()))
    if len(text) < LONG_RUN:
        return whole(text)
    parts, at = [], 0
    for m in _RUN.finditer(text):
        if m.end() - m.start() < LONG_RUN:
            continue
        ends = m.end() == len(text) or special and any(text.startswith(t, m.end()) for t in of.special_tokens_set)
        upto = m.end() - (not ends)
        parts += [whole(text[at : m.start()]), np.array(of._encode_single_piece(text[m.start() : upto]), np.uint32)]
        at = upto
    return np.concatenate([*parts, whole(text[at:])]) if parts else whole(text)


def _pieces(path: str, capacity: int, end_id: int):
    cuts = (capacity, capacity // 2, capacity // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoding(path)
        for batch in batches:
            raw, begin, end = buffers(batch.column(1))
            view = memoryview(raw)
            row, start, length, crc, total = [], [], [], [], []
            for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
                ids = np.append(encode(of, str(view[a:b], "utf-8"), special=True), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                at = 0
                while at < n:
                    part = ids[at : at + next((c for c in cuts if n - at >= c), n - at)]
                    row.append(i)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(n)
                    at += len(part)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["id", "start", "length", "crc", "total"])

    return run


def best_pattern(price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes 1..len(price) within the capacity (an unbounded knapsack)."""
    value = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, np.int64)
    sizes = np.arange(1, len(price) + 1)
    for c in range(1, capacity + 1):
        options = value[c - sizes[:c]] + price[:c]
        k = int(options.argmax())
        value[c], choice[c] = (options[k], k + 1) if options[k] > value[c - 1] else (value[c - 1], 0)
    pattern, c = np.zeros(len(price), np.int64), capacity
    while c > 0:
        if choice[c]:
            pattern[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return float(value[capacity]), pattern


def column_generation(counts: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """(pattern, times): patterns over sizes 1..len(counts) that hold every item, nearly as few as can be."""
    m = len(counts)
    live = np.flatnonzero(counts)
    if not len(live):
        return []
    basis = np.zeros((len(live), len(live)))
    for j, k in enumerate(live):
        basis[j, j] = capacity // (k + 1)
    need = counts[live].astype(float)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(len(live)))
        price = np.zeros(m)
        price[live] = np.maximum(dual, 0)
        worth, pattern = best_pattern(price, capacity)
        if worth <= 1 + 1e-7:
            break
        column = pattern[live].astype(float)
        direction = np.linalg.solve(basis, column)
        times = np.linalg.solve(basis, need)
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.full(len(live), np.inf)
        ratio[up] = np.maximum(times[up], 0) / direction[up]
        basis[:, int(ratio.argmin())] = column
    times = np.linalg.solve(basis, need)
    plan, rest = [], counts.astype(np.int64).copy()
    for j in np.argsort(-times, kind="stable"):
        pattern = np.zeros(m, np.int64)
        pattern[live] = np.rint(basis[:, j]).astype(np.int64)
        used = pattern > 0
        n = int(min(np.floor(max(times[j], 0) + 1e-9), (rest[used] // pattern[used]).min()))
        if n > 0:
            plan.append((pattern, n))
            rest -= n * pattern
    # the few items that rounding leaves: best fit, longest first
    free: list[int] = []
    bins: list[np.ndarray] = []
    for k in range(m - 1, -1, -1):
        for _ in range(int(rest[k])):
            fit = [(f, i) for i, f in enumerate(free) if f > k]
            if fit:
                i = min(fit)[1]
            else:
                free.append(capacity)
                bins.append(np.zeros(m, np.int64))
                i = len(bins) - 1
            free[i] -= k + 1
            bins[i][k] += 1
    return plan + [(b, 1) for b in bins]


def slots(plan: list[tuple[np.ndarray, int]], sizes: int) -> dict[str, np.ndarray]:
    """Intervals of ranks within a size: ranks first, first + 1, ... go to slot ``place`` of sequences base, base + 1, ..."""
    taken, base, rows = np.zeros(sizes, np.int64), 0, []
    for pattern, times in plan:
        place = 0
        for k in np.flatnonzero(pattern)[::-1]:
            for _ in range(int(pattern[k])):
                rows.append((k + 1, taken[k], base, place))
                taken[k] += times
                place += 1
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {name: table[:, i].copy() for i, name in enumerate(("size", "first", "base", "place"))}


def _assign(plan: dict[str, np.ndarray]):
    edge = (plan["size"] << 44) + plan["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("size").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            at = np.searchsorted(edge, (size << 44) + rank, side="right") - 1
            sequence = plan["base"][at] + rank - plan["first"][at]
            names = ["id", "start", "length", "crc", "total"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(plan["place"][at])], names=[*names, "sequence", "place"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, grid: int = 4, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids by the tokenizer file, then ``end_id``; a null text is empty and has that id only. Pieces are as
    long as a sequence, but for up to three at the end of a document; lengths count in steps of ``grid``. Null ids are kept, repeated
    rows are packed each, an empty table gives an empty result, and other columns are not read.
    The driver holds the histogram (capacity / grid numbers) and the plan, whose size depends on the grid alone.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(n, T.LongType()) for n in ("start", "length", "crc", "total"))])
    pieces = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(_pieces(tokenizer, capacity, end_id)), schema)
    bucket = F.pmod(F.xxhash64("id", "start", "crc"), F.lit(BUCKETS)).cast("int")
    pieces = stash(pieces.withColumns({"size": F.ceil(F.col("length") / grid).cast("int"), "bucket": bucket}), "pieces")
    units = -(-capacity // grid)
    counted = stash(pieces.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n")), "histogram")
    counts = np.zeros(units, np.int64)
    for r in counted.groupBy("size").agg(F.sum("n").alias("n")).collect():  # at most ``units`` rows
        counts[r["size"] - 1] = r["n"]
    whole = int(counts[-1])
    rest = counts.copy()
    rest[-1] = 0
    plan = column_generation(rest, capacity // grid)
    if whole:
        full = np.zeros(units, np.int64)
        full[-1] = 1
        plan.append((full, whole))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # at most units * BUCKETS rows
    within = Window.partitionBy("size", "bucket").orderBy("id", "start", "crc")
    ranked = pieces.withColumn("own", F.row_number().over(within)).join(F.broadcast(offsets), ["size", "bucket"]).withColumn("rank", (F.col("first") + F.col("own") - 1).cast("long"))
    placed_schema = T.StructType([*schema.fields, T.StructField("sequence", T.LongType()), T.StructField("place", T.LongType())])
    placed = ranked.select("id", "start", "length", "crc", "total", "size", "rank").mapInArrow(tidy(_assign(slots(plan, units))), placed_schema)
    ahead = Window.partitionBy("sequence").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"), F.col("sequence").alias("sequence_id"),
        F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"),
    )
