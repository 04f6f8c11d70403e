"""Ranked lexical search: a tree of maxima over document ranges for each term, searched best bound first.

Documents are indexed where they are scanned, in shards of some thousand: postings of the terms that queries have. When the
corpus statistics are known, each posting has its integer part of a score, and each term of a shard a tree: a leaf is a
document, a node of the next level holds the maximum over FAN neighbours. The bound of a range is the weighted sum of its
terms' maxima. A query opens the range with the highest bound, again and again, until no bound can reach its tenth document;
ranges whose bound equals that score are opened while they may hold a smaller id. A task keeps its ten best from shard to
shard, so later shards are mostly cut at their roots.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, buffers, stash, tidy

#: Documents and postings of a shard at most (a document is never cut), and children of a tree's node.
SHARD, POSTINGS, FAN = 8192, 1 << 21, 32
#: Queries are searched in groups of about so many terms in all; what a group sends to the tasks is bounded by it.
TERMS = 100_000
_SPACE = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: A term's bytes: ASCII digits and letters, small, and all of other characters; everything else becomes a blank.
_FOLD = bytes(0x20 if b in set(_SPACE) - set(range(0x41, 0x5B)) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """All terms of a text in order, with repeats."""
    return text.translate(_FOLD).split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    raw, start, end = buffers(column)
    view = memoryview(raw)
    return (bytes(view[a:b]) for a, b in zip(start.tolist(), end.tolist()))


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(terms_of(x))) for x in _texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["rid", "terms"])


def _tight(x: np.ndarray) -> tuple[bytes, int]:
    width = 2 if not x.size or int(x.max()) < 1 << 15 else 4 if int(x.max()) < 1 << 31 else 8
    return x.astype(f"<i{width}").tobytes(), width


def _wide(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").astype(np.int64)


def _index(vocabulary: dict[bytes, int], schema: pa.Schema, shard: int, most: int):
    """Shards of the scanned documents, each ordered by id: sizes of the documents and postings by term, then document."""

    def row(ids: list[pa.Array], sizes: list[int], doc: list[int], term: list[int], tf: list[int]) -> pa.RecordBatch:
        names = pa.concat_arrays(ids)
        order = pc.sort_indices(names, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        d, t, f = place[np.array(doc, np.int64)], np.array(term, np.int64), np.array(tf, np.int64)
        by = np.lexsort((d, t))
        terms, first = np.unique(t[by], return_index=True)
        df = np.diff(np.append(first, len(by)))
        n = np.array(sizes, np.int64)[order]
        packed = [_tight(n), _tight(d[by]), _tight(f[by])]
        values = [[names.take(pa.array(order)).to_pylist()], [terms.tolist()], [df.tolist()], *([x] for p in packed for x in p), [int(n.sum())], [int((n > 0).sum())]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, doc, term, tf = [], [], [], [], []
        for batch in batches:
            begun = 0
            for i, text in enumerate(_texts(batch.column(1))):
                words = terms_of(text)
                for t, c in Counter(words).items():
                    if (k := vocabulary.get(t)) is not None:
                        doc.append(len(sizes))
                        term.append(k)
                        tf.append(c)
                sizes.append(len(words))
                if len(sizes) >= shard or len(doc) >= most:
                    yield row([*ids, batch.column(0).slice(begun, i + 1 - begun)], sizes, doc, term, tf)
                    ids, sizes, doc, term, tf, begun = [], [], [], [], [], i + 1
            if begun < batch.num_rows:
                ids.append(batch.column(0).slice(begun))
        if sizes:
            yield row(ids, sizes, doc, term, tf)

    return run


def score_parts(tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """The factor of each posting that the term's weight multiplies: (10**9 tf) div (1000 tf + 8 m), m = 10 + (90 n N) div L."""
    m = np.array([10 + 90 * x * documents // words for x in n.tolist()], np.int64) if len(n) and 90 * int(n.max()) * documents >= 1 << 62 else 10 + 90 * n * documents // words
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Trees:
    """The trees of a shard's terms, level by level: nodes sorted by (term, range), their maxima and first children."""

    def __init__(self, first: np.ndarray, doc: np.ndarray, value: np.ndarray, documents: int):
        """``first``: where each term's postings begin, and their end; ``doc`` rises within a term."""
        self.levels, begin, node, best = [(doc, value, None)], first, doc, value
        reach = 1
        while reach < documents:
            reach *= FAN
            node = node // FAN
            fresh = np.ones(len(node), bool)
            fresh[1:] = node[1:] != node[:-1]
            fresh[begin[:-1]] = True
            starts = np.flatnonzero(fresh)
            best, node = np.maximum.reduceat(best, starts), node[starts]
            begin = np.searchsorted(starts, begin)
            self.levels.append((node, best, np.append(starts, len(fresh))))
        self.begin = begin

    def search(self, terms: np.ndarray, weight: np.ndarray, ids: list, top: list, most: int) -> int:
        """Put the documents that belong there into ``top``, sorted (-score, id is null, id) of at most ``most``; how many ranges were opened."""
        opened, height = 0, len(self.levels) - 1
        if height == 0:  # a shard of one document: the postings are the roots
            entries = np.concatenate([np.arange(self.begin[t], self.begin[t + 1]) for t in terms])
            weight = np.repeat(weight, [self.begin[t + 1] - self.begin[t] for t in terms])
            _offer(top, -int((weight * self.levels[0][1][entries]).sum()), ids[0], most)
            return 1
        entries = self.begin[terms]
        heap = [(-int((weight * self.levels[height][1][entries]).sum()), 0, height, entries, weight)]
        while heap:
            bound, first, level, entries, weight = heapq.heappop(heap)
            if bound >= 0 or len(top) == most and (bound, ids[first] is None, ids[first] or 0) >= top[-1][:3]:
                # equal bounds come by rising first id, so no later range can do better
                break
            opened += 1
            node, best, _ = self.levels[level - 1]
            starts = self.levels[level][2]
            count, step = starts[entries + 1] - starts[entries], FAN ** (level - 1)
            at = np.repeat(starts[entries] - np.cumsum(count) + count, count) + np.arange(count.sum())
            each = np.repeat(weight, count)
            child = node[at] - first // step
            total = np.zeros(FAN, np.int64)
            np.add.at(total, child, each * best[at])
            floor = -top[-1][0] if len(top) == most else 1
            for c in np.flatnonzero(total >= max(floor, 1)).tolist():
                if level == 1:
                    _offer(top, -int(total[c]), ids[first + c], most)
                else:
                    own = child == c
                    heapq.heappush(heap, (-int(total[c]), first + c * step, level - 1, at[own], each[own]))
        return opened


def _offer(top: list, score: int, name, most: int) -> None:
    key = (score, name is None, name or 0)
    if score < 0 and (len(top) < most or key < top[-1]):
        insort(top, key)
        del top[most:]


def _search(queries: list[tuple[int, np.ndarray]], weight: np.ndarray, documents: int, words: int, most: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: list[list] = [[] for _ in queries]
        place = np.full(len(weight), -1, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                n, doc, tf = (_wide(r[x], r[f"{x}_width"]) for x in ("n", "doc", "tf"))
                if not len(doc):
                    continue
                known = np.array(r["terms"], np.int64)
                first = np.concatenate([[0], np.cumsum(np.array(r["df"], np.int64))])
                trees = Trees(first, doc, score_parts(tf, n[doc], documents, words), len(n))
                place[known] = np.arange(len(known))
                for (_, own), top in zip(queries, tops):
                    here = place[own]
                    here, own = here[here >= 0], own[here >= 0]
                    if len(here):
                        trees.search(here, weight[own], r["ids"], top, most)
                place[known] = -1
        rid = [q for (q, _), top in zip(queries, tops) for _ in top]
        found = [x for top in tops for x in top]
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array([None if lost else i for _, lost, i in found], schema.field(1).type), pa.array([-s for s, _, _ in found], pa.int64())], schema=schema)

    return run


def rank(docs: DataFrame, queries: DataFrame, most: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """``query_id, rank, id_col, score``: the ``most`` documents of highest score above 0 for each query, equal scores by rising id.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))) over the N documents that have a term; a document's score is the sum
    over a query's different terms of weight * ((10**9 tf) div (1000 tf + 8 m)). Results are exact. A null text has no terms; a
    query without terms, or whose terms no document has, gives no rows. Rows of one id are documents, or queries, of their own;
    null ids of documents come last among ties. An empty table on either side gives an empty result; other columns are not read.
    Ids must be whole numbers.

    The driver holds the terms of one group of queries and their counts (about TERMS; one query's terms are never parted).
    Each group reads the documents once.
    """
    spark = docs.sparkSession
    kind, name = docs.schema[id_col].dataType, queries.schema[query_id].dataType
    number = pa.int64()
    shards = pa.schema([("ids", pa.list_(number)), ("terms", pa.list_(pa.int32())), ("df", pa.list_(pa.int32())), ("n", pa.binary()), ("n_width", pa.int32()), ("doc", pa.binary()), ("doc_width", pa.int32()), ("tf", pa.binary()), ("tf_width", pa.int32()), ("words", number), ("filled", number)])
    shard_sql = "ids array<long>, terms array<int>, df array<int>, n binary, n_width int, doc binary, doc_width int, tf binary, tf_width int, words long, filled long"
    hits = pa.schema([("rid", number), ("doc", number), ("score", number)])
    with arrow_batches(spark, "8m"):
        asked = stash(queries.select(F.monotonically_increasing_id().alias("rid"), F.col(query_id).alias("query"), F.col(query_text).cast("string").alias("text")), "queries")
        asked_terms = stash(asked.select("rid", "text").mapInArrow(tidy(_query_terms), "rid long, terms array<binary>").filter("size(terms) > 0"), "query-terms")
        total = asked_terms.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
        groups = -(-total // TERMS)
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        found = []
        for g in range(groups):
            rows = [(r["rid"], [bytes(t) for t in r["terms"]]) for r in asked_terms.filter(F.pmod(F.xxhash64("rid"), F.lit(groups)) == g).collect()]
            vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in rows for t in ts}))}
            index = stash(texts.mapInArrow(tidy(_index(vocabulary, shards, SHARD, POSTINGS)), shard_sql), "shards")
            sums = index.agg(F.sum("filled").alias("documents"), F.sum("words").alias("words")).first()
            if not sums["words"]:
                continue
            df = np.zeros(len(vocabulary), np.int64)
            counted = index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df"))
            for r in counted.collect():  # a row for each term of the group
                df[r["terms"]] = r["df"]
            weight = np.array([math.floor(1000 * math.log((2 * sums["documents"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
            own = [(rid, np.array([vocabulary[t] for t in ts], np.int64)) for rid, ts in rows]
            search = _search(own, weight, sums["documents"], sums["words"], most, hits)
            found.append(stash(index.mapInArrow(tidy(search), "rid long, doc long, score long"), "hits"))
    if not found:
        return spark.createDataFrame([], T.StructType([T.StructField(query_id, name), T.StructField("rank", T.IntegerType()), T.StructField(id_col, kind), T.StructField("score", T.LongType())]))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    best = Window.partitionBy("rid").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    return ranked.join(asked.select("rid", "query"), "rid").select(F.col("query").alias(query_id), "rank", F.col("doc").cast(kind).alias(id_col), "score")
