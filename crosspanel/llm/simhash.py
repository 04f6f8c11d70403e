"""SimHash near-dedup by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits have a 32-bit half that differs in at most one. So each half is
indexed once for every bit, with that bit masked out; halves that differ in at most one bit share such a variant, and an
equality join on (half, masked bit, rest) meets every pair, which is then verified on all 64 bits. Only edges that join
two parts within a task are passed on; connected components are then found by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_spread, partitions, small_batches, stash, text_bytes, tidy
from .repeats import by_key

HALF = 32
#: Variants with more members than this are dealt again by segments of the other half, one of which must agree, and again.
CROWD = 2_000


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash over word shingles: a bit is set if it is in over half of the shingles' hashes; no words give 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)  # one shingle: its hash
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1])
    n = len(words) - width + 1
    hash_of = xxhash.xxh64_intdigest
    return majority(np.fromiter([hash_of(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), (ends[width - 1 :] - 1).tolist())], np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "print"])

    return run


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, print): both halves of a fingerprint under each of their 32 masks. The key holds half, bit and the other 31 bits."""
    bit = np.arange(HALF, dtype=np.uint64)
    for batch in batches:
        prints = batch.column("print").to_numpy().view(np.uint64)
        for at in range(0, len(prints), 2000):
            p = prints[at : at + 2000]
            halves = np.stack([p & np.uint64(0xFFFFFFFF), p >> np.uint64(32)], axis=1)
            rest = halves[:, :, None] & ~(np.uint64(1) << bit)
            key = (np.arange(2, dtype=np.uint64)[None, :, None] << np.uint64(37)) | (bit << np.uint64(32)) | rest
            yield pa.RecordBatch.from_pydict({"key": pa.array(key.ravel().view(np.int64)), "print": pa.array(np.repeat(p, 2 * HALF).view(np.int64))})


class Forest:
    """Disjoint sets of fingerprints; ``join`` tells whether an edge was new."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def link(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest member of each part) after joining the parts of a and b."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (jump := label[label]).tobytes() != label.tobytes():
            label = jump


def parts(key: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct fingerprints, label of each) after linking those within ``distance`` bits under a common key.

    ``key`` is sorted. Each row is held against its 1st, 2nd, ... successor under the same key, for all keys at once; a key
    whose rows have all come into one part is left out from then on, so dense groups take few rounds.
    """
    distinct, index = np.unique(prints, return_inverse=True)
    label = np.arange(len(distinct))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    end = np.repeat(np.append(first[1:], len(key)), np.diff(np.append(first, len(key))))
    live, gap = np.arange(len(key)), 0
    while len(live):
        gap += 1
        live = live[live + gap < end[live]]
        hit = live[np.bitwise_count(prints[live] ^ prints[live + gap]) <= distance]
        a, b = index[hit], index[hit + gap]
        fresh = label[a] != label[b]
        if fresh.any():
            label = link(label, a[fresh], b[fresh])
        if gap & (gap - 1) == 0 and len(live):
            own = label[index]
            mixed = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
            live = live[np.repeat(mixed, np.diff(np.append(first, len(key))))[live]]
    return distinct, label


def _verify(distance: int):
    """Edges from each linked fingerprint to the smallest of its part, without those that close a circle within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, out = Forest(), []
        for t in by_key(batches, 50_000):
            distinct, label = parts(t.column("key").to_numpy(), t.column("print").to_numpy().view(np.uint64), distance)
            moved = np.flatnonzero(label != np.arange(len(label)))
            out += [pair for pair in zip(distinct[moved].tolist(), distinct[label[moved]].tolist()) if forest.join(*pair)]
        if out:
            both = np.array(out, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"a": pa.array(both[:, 0].copy()), "b": pa.array(both[:, 1].copy())})

    return run


def _dealt_again(rows: DataFrame, width: int) -> tuple[DataFrame, int]:
    """Rows (key, print, rest) under four finer keys each: rests of ``width`` bits that differ in three bits at most agree in one of
    four segments; the finer key has that segment, the finer rest the other bits."""
    step = -(-width // 4)
    starts = [k * step for k in range(4) if k * step < width]
    rest = F.col("rest")
    segment = lambda at: F.shiftrightunsigned(rest, at).bitwiseAND(F.lit((1 << step) - 1))
    without = lambda at: F.shiftleft(F.shiftrightunsigned(rest, at + step), at).bitwiseOR(rest.bitwiseAND(F.lit((1 << at) - 1)))
    parts = F.array(*(F.struct(F.xxhash64("key", F.lit(width), F.lit(at), segment(at)).alias("key"), without(at).alias("rest")) for at in starts))
    return rows.select("print", F.explode(parts).alias("part")).select("part.key", "print", "part.rest"), width - step


def near_edges(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``print``) within ``distance`` bits that span every component.

    Works for ``distance`` up to 3. What shares a variant differs in at most 3 bits of the other half; a crowded variant is dealt
    again by segments of that half, one of which agrees, and what is still crowded by segments of the bits that are left, until no
    key has more than CROWD fingerprints. No pair is lost, and no key is held whole that is larger.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves with one wildcard find up to three differing bits")
    spark = prints.sparkSession
    pairs = prints.mapInArrow(tidy(_variants), "key long, print long")
    n = partitions(spark)
    crowds = lambda rows: stash(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("key"), "crowds")
    crowded = crowds(pairs)
    loose = pairs
    if crowded.limit(1).count():
        marked = pairs.join(crowded.withColumn("crowd", F.lit(True)), "key", "left")
        other = F.when(F.shiftright("key", 37).bitwiseAND(F.lit(1)) == 0, F.shiftrightunsigned("print", 32)).otherwise(F.col("print").bitwiseAND(F.lit(0xFFFFFFFF)))
        loose, hot, width = marked.filter("crowd is null").select("key", "print"), marked.filter("crowd").select("key", "print", other.alias("rest")), 32
        while True:
            hot, width = _dealt_again(hot, width)
            hot = stash(hot, "dealt")
            crowded = crowds(hot) if width else None
            if crowded is None or not crowded.limit(1).count():
                loose = loose.unionByName(hot.select("key", "print"))
                break
            marked = hot.join(crowded.withColumn("crowd", F.lit(True)), "key", "left")
            loose, hot = loose.unionByName(marked.filter("crowd is null").select("key", "print")), marked.filter("crowd").select("key", "print", "rest")
    dealt = loose.repartition(n, "key").sortWithinPartitions("key", "print")
    return dealt.mapInArrow(tidy(_verify(distance)), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges (a, b): root is the smallest node reachable.

    Alternating large and small stars; edges of a hub are not gathered in one task (see ``join_spread``). Each round is written to the shared folder. Rounds go on until
    nothing moves: labels only fall, and their number grows with the logarithm of the longest path.
    """
    edges = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total = 2 * edges.count()
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_spread(both.filter("v > u"), least, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stash(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_spread(large, least, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        fresh = stash(small, "edges")
        # done when every node has one edge, to a node that has none
        roots = fresh.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        open_ = fresh.select(F.col("v").alias("u")).distinct().join(roots.select("u"), "u", "left_semi").limit(1).count() + roots.filter("n > 1").limit(1).count()
        edges = fresh
        if not open_:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def component_ids(nodes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``key, n, component_id``: the least id in the component of each node. ``nodes`` has key, least and n; ``found`` node and root."""
    members = found.select(F.col("node").alias("_node"), "root").unionByName(found.select(F.col("root").alias("_node"), "root").distinct())
    rooted = stash(nodes.join(members, F.col(key) == F.col("_node"), "left").select(key, "least", "n", F.coalesce("root", key).alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("many"))
    return stash(join_spread(rooted, ids, "root", "many", rooted.count()).select(key, "n", "component_id"), "labels")


def simhash_dedup(docs: DataFrame, distance: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint, component_id`` of every row.

    Fingerprints link at ``distance`` or fewer differing bits; component_id is the smallest id reachable, its own included.
    A text without words, null too, has fingerprint zero, linked like any other. Null ids are not smallest; a component of
    null ids only has a null id. Repeated rows each get a row; an empty table gives an empty result; other columns are
    not read. Documents with one fingerprint are one node, whose smallest id is found by partial aggregates.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", slim.schema["id"].dataType), T.StructField("print", T.LongType())])
    marked = stash(slim.mapInArrow(tidy(_fingerprints(width)), schema), "simhash")
    nodes = stash(marked.groupBy("print").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    labels = component_ids(nodes, components(near_edges(nodes.select("print"), distance)), "print")
    return join_spread(marked, labels, "print", "n", marked.count()).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
