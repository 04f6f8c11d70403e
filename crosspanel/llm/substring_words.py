"""Substring dedup over words: Rabin-Karp hashes of every fixed-length window of words, shuffled in runs by Spark and counted by the tasks that own them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import mix64, partitions, small_batches, stash, text_bytes, tidy
from .repeats import CODE, Roller, Seen, binary_array, by_key_cut, flagged_spans, merge, ranges, repeated_rows, runs_of, sliding_min, span_arrays, with_spans

#: Words are taken to memory in pieces of about so many bytes of text.
PIECE = 4 << 20
#: A minimizer is hot if it is estimated in this share of the documents, or in so many; one document in SAMPLE is looked at.
HOT_SHARE, HOT_ROWS, SAMPLE = 0.002, 20_000, 64
#: Rows of one minimizer beyond which its windows are dealt out once more, each by its own hash.
MOST = 200_000


class Words:
    """A random 64-bit number for each word, remembered while memory allows."""

    def __init__(self, most: int = 400_000) -> None:
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of each document) in pieces of bounded size."""
    first, held, size = 0, [], 0
    for text in text_bytes(batch.column(column)):
        held.append(text.split())
        size += len(text)
        if size >= PIECE:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def _scan(docs: list[list[bytes]], hash_words: Words, roll: Roller, window: int, gram: int):
    """(window hashes, minimizers, validity, document of each position, first position of each document)."""
    counts = np.fromiter(map(len, docs), np.int64, len(docs))
    flat = hash_words([w for d in docs for w in d])
    begin = np.cumsum(counts) - counts
    if len(flat) < window:
        return None
    prefix = roll.prefix(flat)
    whole = roll.windows(prefix, window)
    least = sliding_min(roll.windows(prefix, gram), window - gram + 1)
    owner = np.repeat(np.arange(len(docs)), counts)
    return whole, least, owner[: len(whole)] == owner[window - 1 :], owner, begin


def _hot(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_words, roll = Words(), Roller()
        for batch in batches:
            for _, docs in pieces(batch, 0):
                if (found := _scan(docs, hash_words, roll, window, gram)) is None:
                    continue
                _, least, valid, owner, _ = found
                start, _ = runs_of(valid, least)
                pairs = np.unique(np.stack([owner[start].astype(np.uint64), least[start]]), axis=1) if len(start) else np.zeros((2, 0), np.uint64)
                keys, n = np.unique(pairs[1], return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return run


def hot_keys(docs: DataFrame, window: int, gram: int) -> np.ndarray:
    """Very frequent minimizers of a sample of documents: a hint for dealing, at most 100,000; results don't depend on it."""
    sample = docs.filter(F.pmod(F.xxhash64("id", "print"), F.lit(SAMPLE)) == 0)
    counted = sample.select("text").mapInArrow(tidy(_hot(window, gram)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    least = max(3, min(HOT_ROWS // SAMPLE, int(sample.count() * HOT_SHARE)))
    found = counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(100_000).collect()
    return np.sort(np.array([r["key"] for r in found], np.int64).view(np.uint64))


def _send(window: int, gram: int, hot: np.ndarray, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_words, roll, seen = Words(), Roller(), Seen()
        for batch in batches:
            prints = batch.column(1).to_numpy()
            for first, docs in pieces(batch, 2):
                if (found := _scan(docs, hash_words, roll, window, gram)) is None:
                    continue
                whole, least, valid, owner, begin = found
                start, length = runs_of(valid, least)
                if not len(start):
                    continue
                loose = np.isin(least[start], hot)
                single = ranges(start[loose], length[loose])
                start, length = np.concatenate([start[~loose], single]), np.concatenate([length[~loose], np.ones(len(single), np.int64)])
                key = np.concatenate([least[start[: len(start) - len(single)]], mix64(whole[single] ^ mix64(least[single]))])
                sums = np.append(np.uint64(0), np.cumsum(mix64(whole) * roll.power[: len(whole)], dtype=np.uint64))
                content = mix64((sums[start + length] - sums[start]) * roll.inverse[start] ^ key)
                send = seen.keep(content, key)
                row = owner[start]
                place = start - begin[row]
                at = ranges(start[send], length[send])
                code = whole[at].view(np.uint8).reshape(-1, 8)[:, :CODE]
                full = pa.RecordBatch.from_arrays([
                    pa.array(key[send].view(np.int64)), batch.column(0).take(pa.array(first + row[send])), pa.array(prints[first + row[send]]),
                    pa.array(place[send].astype(np.int32)), pa.array(length[send].astype(np.int32)), binary_array(code, length[send] * CODE),
                ], schema=schema)
                yield full
                if not send.all():
                    # runs that are known to be repeated: join neighbours, deal by place
                    order = np.argsort(start[~send])
                    s, n, r = start[~send][order], length[~send][order], row[~send][order]
                    new = np.append(True, (s[1:] != s[:-1] + n[:-1]) | (r[1:] != r[:-1]))
                    head = np.flatnonzero(new)
                    tail = np.append(head[1:], len(s)) - 1
                    n, s, r = s[tail] + n[tail] - s[head], s[head], r[head]
                    spread = mix64(prints[first + r].view(np.uint64) + s.astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(spread.view(np.int64)), batch.column(0).take(pa.array(first + r)), pa.array(prints[first + r]),
                        pa.array((s - begin[r]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.nulls(len(s), pa.binary()),
                    ], schema=schema)

    return run


def _count(window: int, most: int, schema: pa.Schema):
    """Owner task: windows with one minimizer and one hash that occur twice are repeated.

    Rows are spans (``key`` is null), or, of a minimizer with more than ``most`` rows, single windows for another count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begun, goes_on in by_key_cut(batches, 150_000, most):
            known = t.column("code").is_null().to_numpy() if t.column("code").null_count else np.zeros(t.num_rows, bool)
            n = t.column("n").to_numpy().astype(np.int64)
            start = t.column("start").to_numpy().astype(np.int64)
            key = t.column("key").to_numpy().view(np.uint64)
            part = (begun & (key == key[0])) | (goes_on & (key == key[-1]))  # of a key that other tables have too
            full = np.flatnonzero(~known)
            code = np.frombuffer(b"".join(t.column("code").take(pa.array(full)).to_pylist()), np.uint8).reshape(-1, CODE)
            wide = np.zeros((len(code), 8), np.uint8)
            wide[:, :CODE] = code
            code = wide.view(np.uint64).ravel()
            record = np.repeat(full, n[full])
            order = np.lexsort((code, key[record]))
            a, b = key[record][order], code[order]
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            flag = np.empty(len(order), bool)
            flag[order] = np.append(same, False)[: len(order)] | np.append(False, same)[: len(order)]
            position = ranges(start[full], n[full])
            loose = part[record]
            r, x, y = flagged_spans(flag & ~loose, record, position, window)
            k = np.flatnonzero(known)
            lone = np.flatnonzero(loose)
            none = len(r) + len(k)
            r, x, y = np.concatenate([r, k, record[lone]]), np.concatenate([x, start[k], position[lone]]), np.concatenate([y, start[k] + n[k] - 1 + window, position[lone] + window])
            again = np.append(np.zeros(none, np.uint64), mix64(key[record[lone]] ^ mix64(code[lone]))).view(np.int64)
            at, span = pa.array(r), np.arange(len(r)) < none
            yield pa.RecordBatch.from_arrays([
                pa.array(again, mask=span), pa.array(np.append(np.zeros(none, np.uint64), code[lone]).view(np.int64), mask=span),
                t.column("id").take(at).combine_chunks(), t.column("print").take(at).combine_chunks(), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)),
            ], schema=schema)

    return run


def _recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, flags in repeated_rows(batches, 150_000, 400_000):
        yield from t.filter(pa.array(flags)).drop_columns(["key", "proof"]).to_batches()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, begins, ends = span_arrays(batch.column(2))
        total, gone, digest = [], [], []
        for i, text in enumerate(text_bytes(batch.column(1))):
            words = text.split()
            lo, hi = offsets[i], offsets[i + 1]
            total.append(len(words))
            removed = 0
            if hi > lo:
                b, e = merge(begins[lo:hi], ends[lo:hi])
                removed = int((e - b).sum())
                kept: list[bytes] = []
                last = 0
                for x, y in zip(b.tolist(), e.tolist()):
                    kept += words[last:x]
                    last = y
                words = kept + words[last:]
            gone.append(removed)
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])


def repeated_word_spans(slim: DataFrame, window: int = 35, gram: int = 12, most: int | None = None) -> DataFrame:
    """``id, print, begin, end``: intervals of words that repeated windows cover. ``slim`` has id, print (hash of the text), text."""
    kind = slim.schema["id"].dataType
    hot = hot_keys(slim, window, gram)
    fields = [("key", pa.int64()), ("id", to_arrow_type(kind)), ("print", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("code", pa.binary())]
    sent = slim.mapInArrow(tidy(_send(window, gram, hot, pa.schema(fields))), T.StructType([
        T.StructField("key", T.LongType()), T.StructField("id", kind), T.StructField("print", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("code", T.BinaryType()),
    ]))
    n = partitions(slim.sparkSession)
    spans = T.StructType([T.StructField("id", kind), T.StructField("print", T.LongType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = [("key", pa.int64()), ("proof", pa.int64()), ("id", to_arrow_type(kind)), ("print", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())]
    counted = sent.repartition(n, "key").sortWithinPartitions("key").mapInArrow(
        tidy(_count(window, MOST if most is None else most, pa.schema(fields))), T.StructType([T.StructField("key", T.LongType()), T.StructField("proof", T.LongType()), *spans.fields])
    )
    counted = stash(counted, "counted")
    again = counted.filter("key is not null").repartition(n, "key").sortWithinPartitions("key", "proof").mapInArrow(tidy(_recount), spans)
    return counted.filter("key is null").select(spans.names).unionByName(again)


def substring_dedup(docs: DataFrame, window: int = 35, gram: int = 12, most: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word of a window of ``window`` words that also starts anywhere else: ``id_col, n_words, n_removed, kept_sha256``.

    Windows are judged on the input and never cross documents. Repeated rows are repetitions of each other. A null text
    has no words; its digest is that of the empty string. Null ids are kept; an empty table gives an empty result; other
    columns are not read. A minimizer with more than ``most`` rows in one task has its windows dealt out once more.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("print"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_word_spans(slim, window, gram, most)
    joined = with_spans(slim, spans, F.col("text"))
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return joined.mapInArrow(tidy(_cut), schema).withColumnRenamed("id", id_col)
