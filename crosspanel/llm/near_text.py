"""Near-dedup of texts that share at least 0.8 of their five-word shingles (Jaccard).

Distinct shingle sets are nodes. SimHash fingerprints within three bits, by their deletion variants as in ``simhash``, propose
groups of nodes first. Three bits hold few of the pairs of similarity 0.8, so minimum hashes in bands propose further groups, by
equality only; within a group the sets themselves are compared, so no pair below the similarity links. 25 bands of 4 hashes miss a pair of similarity 0.8 with a
probability of 2 in a million, of 0.85 and more with less than 1 in 100 million.

A crowded group isn't gathered: its blocks of nodes are each compared with its hub first, which joins near copies at once.
Nodes of crowds that are then not in the hub's component are strangers: they are held against all of their crowd's blocks, which
are few. Crowds of many blocks are grouped anew by rare shingles first: of two similar sets the rarest fifths share a shingle, whatever order rarity gives, so no pair is lost, and texts that have only
frequent passages in common part. What is crowded by a rare shingle again is cut in blocks like before, and only strangers of
such a crowd are held against all of its blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_spread, mix64, partitions, small_batches, stash, text_bytes, tidy
from .repeats import by_key
from .simhash import Forest, component_ids, components, majority, near_edges

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 4
#: Keys of a node: a band each, and the part that its fingerprint belongs to.
KEYS = BANDS + 1
#: Groups of more nodes than this are compared in blocks, so a task holds at most twice as many sets of one group.
CROWD = 500
#: In a crowd of so many blocks at most, strangers meet all blocks; in larger ones rare shingles are told apart first, which costs
#: the keys of a fifth of all shingles, however large the crowd.
BLOCKS = 20
#: Up to so many ids (8 bytes each) are broadcast to the texts; beyond that both are shuffled.
BROADCAST_IDS = 1_000_000
#: Shingles are counted in so many bins to tell rare from frequent ones; the counts come to the driver and go to the tasks.
BINS = 1 << 16
_rng = np.random.default_rng(5)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1])
    n = len(words) - width + 1
    hash_of = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([hash_of(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), (ends[width - 1 :] - 1).tolist())], np.uint64, n))


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 7)


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of minimum hashes of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, ((found[at : at + 4096, None] ^ _MASKS) * _FACTORS).min(axis=0))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + row)
    return out


def _nodes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width) for t in text_bytes(batch.column(1))]
            nodes, prints = np.array([node_of(s) for s in sets], np.uint64), np.array([majority(s) for s in sets], np.uint64)
            keys = np.concatenate([bands(s) for s in sets]) if sets else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes.view(np.int64)), pa.array(prints.view(np.int64)), lists], names=["id", "node", "print", "keys"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) of the keys that several nodes have; the key becomes a hash of its nodes, so equal groups are one."""
    for t in by_key(batches, 50_000):
        key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        many = size > 1
        if many.any():
            name = [xxhash.xxh64_intdigest(node[a : a + n].tobytes(), 11) for a, n in zip(first[many].tolist(), size[many].tolist())]
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.repeat(np.array(name, np.uint64).view(np.int64), size[many])), "node": pa.array(node[np.repeat(many, size)])})


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width) for t in text_bytes(batch.column(0))]
            yield pa.RecordBatch.from_pydict({"node": pa.array(np.array([node_of(s) for s in sets], np.uint64).view(np.int64)), "hashes": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= least * (len(both) - common) - 1e-9


def _verify(least: float):
    """Edges of similar nodes that span the parts of each group; pairs already in one part are not compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, out = Forest(), []
        for t in by_key(batches, 2_000):
            key, node = t.column("key").to_numpy(), t.column("node").to_pylist()
            raw = t.column("hashes")
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist()
            for a, b in zip(first, [*first[1:], len(key)]):
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in raw.slice(a, b - a)]
                for gap in range(1, b - a):
                    for i in range(b - a - gap):
                        u, v = node[a + i], node[a + i + gap]
                        if forest.root(u) != forest.root(v) and similar(sets[i], sets[i + gap], least):
                            forest.join(u, v)
                            out.append((u, v))
                    if len({forest.root(x) for x in node[a:b]}) == 1:
                        break
        if out:
            both = np.array(out, np.int64)
            yield pa.RecordBatch.from_pydict({"a": pa.array(both[:, 0].copy()), "b": pa.array(both[:, 1].copy())})

    return run


def near_text_dedup(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, component_id`` of every row.

    Texts link if the Jaccard similarity of their sets of ``width``-word shingles is at least ``similarity``, 0.8 or more;
    component_id is the smallest id reachable, its own included. Texts without words, null ones too, are linked with each
    other. Null ids are not smallest; a component of null ids only has a null id. Repeated rows each get a row. An empty table
    gives an empty result; other columns are not read.
    """
    if similarity < SIMILARITY:
        raise ValueError("the bands find pairs of similarity 0.8 or more")
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", slim.schema["id"].dataType), T.StructField("node", T.LongType()), T.StructField("print", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    marked = stash(slim.mapInArrow(tidy(_nodes(width)), schema), "near")
    nodes = stash(marked.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("print").alias("print"), F.first("keys").alias("keys")), "nodes")
    pairs = stash(nodes.select("node", F.explode("keys").alias("key")).unionByName(_by_fingerprints(nodes)), "pairs")  # crowds are counted, dealt and met from it
    find = lambda p: _links(p, nodes, slim, similarity, width)
    edges, crowds = _round(pairs, KEYS * nodes.count(), find, "links")
    found = components(edges)
    members = None if crowds is None else _members(pairs, crowds, found, KEYS * nodes.count())
    if members is not None:
        few, many = members.filter(F.col("blocks") <= BLOCKS), members.filter(F.col("blocks") > BLOCKS)
        if few.limit(1).count():
            edges = edges.unionByName(stash(find(_against_all(few, crowds, KEYS * nodes.count())), "few-links"))
        if many.limit(1).count():
            finer = _by_rare_shingles(many, nodes, slim, similarity, width)
            total = finer.count()
            more, crowds = _round(finer, total, find, "rare-links")
            edges = edges.unionByName(more)
            members = None if crowds is None else _members(finer, crowds, components(edges), total)
            if members is not None:
                edges = edges.unionByName(stash(find(_against_all(members, crowds, total)), "last-links"))
        found = components(edges)
    labels = component_ids(nodes.drop("keys", "print"), found, "node")
    return join_spread(marked.select("id", "node"), labels, "node", "n", marked.count()).select(F.col("id").alias(id_col), "component_id")


def _by_fingerprints(nodes: DataFrame) -> DataFrame:
    """(node, key): the part of each node's fingerprint; fingerprints within three bits are linked."""
    found = components(near_edges(nodes.select("print").distinct())).select(F.col("node").alias("print"), "root")
    return nodes.select("node", "print").join(found, "print", "left").select("node", F.xxhash64(F.lit("simhash"), F.coalesce("root", "print")).alias("key"))


def _round(pairs: DataFrame, total: int, find: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, DataFrame | None]:
    """Edges within the groups of ``pairs`` (key, node), crowded ones against their hubs only, and the crowds if there are any."""
    crowds = stash(pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).filter(F.col("n") > CROWD), "crowds")
    if not crowds.limit(1).count():
        return stash(find(pairs), name), None
    crowds = crowds.withColumn("blocks", F.ceil(F.col("n") / CROWD))
    return stash(find(_against_hubs(pairs, crowds, total)), name), crowds


def _sets_of(wanted: DataFrame, nodes: DataFrame, slim: DataFrame, width: int) -> DataFrame:
    """``node, hashes`` of the wanted nodes, from the text of one document of each."""
    ids = stash(nodes.join(wanted.select("node").distinct(), "node", "left_semi").select(F.col("least").alias("_id")).distinct(), "wanted")
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = slim.join(F.broadcast(ids) if small else ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    return stash(texts.mapInArrow(tidy(_sets(width)), "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")


def _links(pairs: DataFrame, nodes: DataFrame, slim: DataFrame, similarity: float, width: int) -> DataFrame:
    """Edges (a, b) of similar nodes among those that share a key; ``pairs`` has key and node."""
    n = partitions(pairs.sparkSession)
    dealt = pairs.repartition(n, "key").sortWithinPartitions("key", "node")
    groups = stash(dealt.mapInArrow(tidy(_groups), "key long, node long").distinct(), "groups")
    sets = _sets_of(groups, nodes, slim, width)
    met = groups.join(sets, "node").select("key", "node", "hashes").repartition(n, "key").sortWithinPartitions("key", "node")
    return met.mapInArrow(tidy(_verify(similarity)), "a long, b long").distinct()


def _bin(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes) % np.uint64(BINS)).astype(np.int64)


def _binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BINS, np.int64)
    for batch in batches:
        for x in batch.column(0):
            counts += np.bincount(_bin(np.frombuffer(x.as_py(), np.uint64)), minlength=BINS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"bin": pa.array(some), "n": pa.array(counts[some])})


def rarest(found: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The set's first shingles by rarity: as many as must hold one of any set with a similarity of ``least``."""
    order = np.lexsort((found, counts[_bin(found)]))
    return found[order[: len(found) - int(np.ceil(least * len(found) - 1e-9)) + 1]]


def _prefixes(counts: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [rarest(np.frombuffer(x.as_py(), np.uint64), counts, least) for x in batch.column("hashes")]
            node = np.repeat(batch.column("node").to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_pydict({"node": pa.array(node), "key": pa.array((np.concatenate(keys) if keys else np.zeros(0, np.uint64)).view(np.int64))})

    return run


def _by_rare_shingles(members: DataFrame, nodes: DataFrame, slim: DataFrame, similarity: float, width: int) -> DataFrame:
    """(node, key) of crowds' members under each of their rare shingles that a stranger has too. A set's rarest fifth and one more are its keys."""
    sets = _sets_of(members, nodes, slim, width)
    counts = np.zeros(BINS, np.int64)
    for r in sets.select("hashes").mapInArrow(tidy(_binned), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most BINS rows
        counts[r["bin"]] = r["n"]
    keyed = stash(sets.mapInArrow(tidy(_prefixes(counts, similarity)), "node long, key long"), "rare")
    strange = keyed.join(members.filter("strange").select("node").distinct(), "node", "left_semi").select("key").distinct()
    return stash(keyed.join(strange, "key", "left_semi").select("node", "key"), "rare-pairs")


def _block(of: str, blocks: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), of), F.col(blocks))


def _each(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))


def _against_hubs(pairs: DataFrame, crowds: DataFrame, total: int) -> DataFrame:
    """``pairs`` with the crowded keys dealt in blocks, the least node of a key in each of its blocks."""
    rest = pairs.join(F.broadcast(crowds.filter(F.col("n") > max(CROWD, total // 100_000)).select("key")), "key", "left_anti").join(crowds.select("key"), "key", "left_anti")
    members = join_spread(pairs, crowds, "key", "n", total, CROWD).select("node", F.xxhash64("key", _block("node", "blocks", 1)).alias("key"))
    hubs = crowds.select(F.col("hub").alias("node"), "key", _each("blocks").alias("block")).select("node", F.xxhash64("key", "block").alias("key"))
    return rest.select("node", "key").unionByName(members.unionByName(hubs).distinct())


def _members(pairs: DataFrame, crowds: DataFrame, found: DataFrame, total: int) -> DataFrame | None:
    """``key, node, blocks, strange`` of the crowds that have a stranger, a node outside of its hub's component; None if none has."""
    roots = found.select("node", "root")
    hubs = crowds.join(roots.withColumnRenamed("node", "hub"), "hub", "left").select("key", "n", "blocks", F.coalesce("root", "hub").alias("home"))
    members = join_spread(pairs, hubs, "key", "n", total, CROWD).join(roots, "node", "left").select("key", "node", "blocks", (F.coalesce("root", "node") != F.col("home")).alias("strange"))
    members = stash(members, "members")
    mixed = stash(members.filter("strange").groupBy("key").agg(F.count(F.lit(1)).alias("strangers")), "strangers")
    if not mixed.limit(1).count():
        return None
    return stash(join_spread(members, crowds.select("key", "n").join(mixed.select("key"), "key"), "key", "n", total, CROWD), "mixed")


def _against_all(members: DataFrame, crowds: DataFrame, total: int) -> DataFrame:
    """Keys of pairs of blocks in which each stranger meets all of its crowd.

    Members of the hub's component are linked already and needn't meet each other. Row blocks hold the strangers, column
    blocks everyone.
    """
    rows = members.filter("strange").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CROWD).alias("rows"))
    met = join_spread(members, crowds.select("key", "n").join(rows, "key"), "key", "n", total, CROWD)
    lines = met.filter("strange").select("node", "key", _block("node", "rows", 2).alias("row"), _each("blocks").alias("block"))
    columns = met.select("node", "key", _each("rows").alias("row"), _block("node", "blocks", 1).alias("block"))
    return lines.unionByName(columns).select("node", F.xxhash64("key", "row", "block").alias("key")).distinct()
