"""Packing whole documents by the sum-of-squares rule.

Each document is placed where the sum over all gaps of the squared number of open bins with that gap becomes smallest: gaps
stay spread, so that whatever comes finds a bin that it fills. Documents are dealt into shards of bounded size by a hash;
within a shard they come in hashed order, the smallest tenth last and longest first, which closes what is open.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import arrow_batches, buffers, mix64, stash, tidy
from .packing import byte_alphabet

#: Pieces that one shard packs, about.
SHARD = 65_536
#: Words a worker remembers, and the longest of them in bytes.
WORDS, LONGEST = 400_000, 64
_encoders: dict[str, _Words] = {}


# The tokenizer's pattern over small letters that lie in these ranges, and texts that the pattern's short form reads
# as the library does: ASCII, and the Latin letters up to U+017F but for two that are no letters and one that grows when made small.
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u017F]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u017F]+")
_PLAIN = re.compile(r"[\x00-\x7F\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+")
_END = "</w>"


def _byte_pairs(spec: dict) -> tiktoken.Encoding | None:
    """The vocabulary as byte pairs whose words end in a byte that no text has; None if ids don't rise with the order of merges.

    Where they do, the pair of least id is always the pair merged first, so both libraries take the same steps.
    """
    of, vocabulary = byte_alphabet(), spec["model"]["vocab"]
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    special = {t["content"] for t in spec["added_tokens"]}
    if spec["model"].get("end_of_word_suffix") != _END or merged != list(range(merged[0], merged[0] + len(merged))):
        return None
    ranks = {bytes(map(of.__getitem__, t.removesuffix(_END) if t != _END else t)) + b"\xff" * (t.endswith(_END) and t != _END): i for t, i in vocabulary.items() if t not in special}
    return tiktoken.Encoding("word-ends", pat_str=".", mergeable_ranks=ranks, special_tokens={})


class _Words(dict):
    """Ids, as little-endian 32-bit integers, of what stands between ASCII white space.

    The tokenizer's pattern never matches across white space and its normaliser composes nothing across it, so ids of a text are
    those of its parts, joined. Words of Latin letters, digits and ASCII signs are cut and merged here, three times as fast; all
    others, and what may be a special token, go through the library. Tests hold both against it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pairs, self.special = _byte_pairs(spec), [t["content"] for t in spec["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(path)

    def _ids(self, word: str) -> list[int]:
        if self.pairs is None or len(word) > LONGEST or not _PLAIN.fullmatch(word) or any(t in word for t in self.special):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        return [i for part in _PART.findall(word.lower()) for i in self.pairs._encode_single_piece(part.encode() + b"\xff")]

    def __missing__(self, word: bytes) -> bytes:
        ids = np.array(self._ids(word.decode("utf-8", "replace")), "<u4").tobytes()
        if len(word) <= LONGEST and len(self) < WORDS:
            self[word] = ids
        return ids


def token_ids(path: str, text: bytes) -> bytes:
    """A text's ids by a tokenizer whose tokens hold no white space, four bytes each."""
    if path not in _encoders:
        _encoders[path] = _Words(path)
    return b"".join(map(_encoders[path].__getitem__, text.split()))


def _pieces(path: str, capacity: int, end_id: int):
    last, step = int(end_id).to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, begin, end = buffers(batch.column(1))
            view = memoryview(raw)
            row, piece, length, crc = [], [], [], []
            for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
                ids = token_ids(path, bytes(view[a:b])) + last
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())], names=["id", "piece", "length", "crc"])

    return run


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and its place there, items taken in order; of equal sums the tighter bin is chosen.

    An open bin has a gap between 0 and the capacity; full bins and new ones don't count.
    """
    open_, bins_of = np.zeros(capacity + 1, np.int64), [[] for _ in range(capacity + 1)]
    where, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    total, never = 0, 1 << 40
    for i, s in enumerate(sizes.tolist()):
        n = open_[s:]
        change = np.where(n > 0, 1 - 2 * n, never)
        change[-1] = 0  # a new bin
        change[1:] += 2 * open_[1 : capacity - s + 1] + 1  # what the gap left counts, none if the bin is full
        gap = s + int(change.argmin())
        if gap == capacity:
            where[i], place[i] = total, 0
            total += 1
        else:
            where[i] = bins_of[gap].pop()
            place[i] = capacity - gap
            open_[gap] -= 1
        if gap > s:
            bins_of[gap - s].append(int(where[i]))
            open_[gap - s] += 1
    return where, place


def order(sizes: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Hashed order, but the smallest tenth last and longest first."""
    by_hash = np.argsort(hashed, kind="stable")
    small = sizes[by_hash] <= np.quantile(sizes, 0.1)
    late = by_hash[small]
    return np.concatenate([by_hash[~small], late[np.argsort(-sizes[late], kind="stable")]])


def _packed(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        table = table.take(pa.array(order(table["length"].to_numpy().astype(np.int64), mix64(table["rid"].to_numpy()))))
        where, place = sum_of_squares(table["length"].to_numpy().astype(np.int64), capacity)
        shard = table["shard"].to_numpy().astype(np.int64)
        out = table.drop_columns(["shard", "rid"])
        return out.append_column("sequence", pa.array((shard << 33) + 2 * where)).append_column("place", pa.array(place))

    return run


def best_fit(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, sequence_id, offset``: documents in few sequences of at most ``capacity`` tokens.

    A document is its ids, then ``end_id``; a null or empty text has that id only. Documents longer than a sequence are cut into
    whole sequences, and what is left of them is packed with the others. Null ids are kept, repeated rows are packed each, an empty
    table gives an empty result, and other columns are not read. Reruns on the same files agree.

    A shard is packed by one task, at about SHARD pieces; a hash of the row's place deals them, so copies and hot ids spread.
    Every shard may end with some bins not full, a few in ten thousand of its own (README).
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("piece", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("crc", T.LongType())])
    with arrow_batches(docs.sparkSession, "8m"):
        cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(_pieces(tokenizer, capacity, end_id)), schema)
        pieces = stash(cut.withColumn("rid", F.monotonically_increasing_id()), "cut-pieces")
    whole, rest = pieces.filter(F.col("length") == capacity), pieces.filter(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // SHARD))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int"))
    packed = T.StructType([*schema.fields, T.StructField("sequence", T.LongType()), T.StructField("place", T.LongType())])
    # shards have even numbers, whole sequences odd ones
    placed = dealt.groupBy("shard").applyInArrow(_packed(capacity), packed).unionByName(whole.select("id", "piece", "length", "crc", (2 * F.col("rid") + 1).alias("sequence"), F.lit(0).cast("long").alias("place")))
    return placed.select(
        F.col("id").alias(id_col), "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
        F.col("sequence").alias("sequence_id"), F.col("place").alias("offset"),
    )
