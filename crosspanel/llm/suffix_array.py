"""Suffix-array dedup of byte strings.

Windows that can be repeated are found first: runs of windows with one minimizer (see ``repeats``) whose minimizer occurs
again. Runs whose whole bytes, told by a 128-bit digest, occur twice are repeated as they are. What remains, runs that share a
minimizer but not their bytes, goes to shards by minimizer. A shard builds the suffix array of its runs by Larsson-Sadakane
refinement, takes common prefixes by Kasai's algorithm, and marks windows that agree with a neighbour on their full length.
A very frequent minimizer is spread over shards by content, and one that fills a shard is cut; the digests of their windows
are sorted across shards and met by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import buffers, mix64, partitions, small_batches, stash, text_bytes, tidy
from .repeats import Roller, Seen, binary_array, by_key_cut, flagged_spans, merge, ranges, repeated_rows, runs_of, sliding_min, span_arrays

#: Bytes of text scanned at once.
PIECE = 1 << 20
#: Positions in one suffix array: two ranks and a position fit one sort key.
SHARD = (1 << 21) - 4096
#: Low bits of a minimum that hold its place in a piece of text.
_PLACE = np.uint64((1 << 28) - 1)
#: A minimizer is very frequent if it is estimated in this share of the documents, or in so many; one document in SAMPLE is looked at.
SAMPLE, HOT_SHARE, HOT_ROWS = 64, 0.002, 20_000
#: Rows of one minimizer beyond which a task takes them in parts: when it settles equal runs, and when it fills shards.
MOST_RUNS, MOST_PARTS = 400_000, 40_000


# ---- the suffix array -------------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of a text.

    ``text`` holds unsigned symbols of at most 9 bits; fewer than 2**21. Larsson-Sadakane: all suffixes are sorted by their
    first few symbols; groups of equal ones are then refined by the rank of what follows, in doubling steps; suffixes alone
    in their group are left out. A sort key holds group, next rank and position.
    """
    n = len(text)
    position = np.arange(n, dtype=np.uint64)
    key = np.zeros(n, np.uint64)
    step = 4
    for k in range(step):
        key <<= np.uint64(9)
        key[: n - k] |= text[k:].astype(np.uint64)
    packed = np.sort((key << np.uint64(21)) | position)
    order = (packed & np.uint64(0x1FFFFF)).astype(np.int64)
    head = packed >> np.uint64(21)
    first = np.append(True, head[1:] != head[:-1])
    # a suffix's rank is the place of the first of its group
    lead = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = lead + 1  # 0 stands for the end of the text
    while True:
        last = np.append(first[1:], True)
        open_ = np.flatnonzero(~(first & last))
        if not len(open_):
            break
        at = order[open_]
        follow = rank[np.minimum(at + step, n)]
        packed = (rank[at].astype(np.uint64) << np.uint64(42)) | (follow.astype(np.uint64) << np.uint64(21)) | at.astype(np.uint64)
        packed.sort()
        at = (packed & np.uint64(0x1FFFFF)).astype(np.int64)
        order[open_] = at
        head = packed >> np.uint64(21)
        fresh = np.append(True, head[1:] != head[:-1])
        first[open_] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, open_, 0)) + 1
        step *= 2
    return order


def kasai(text: np.ndarray, order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to ``most``, of each suffix with the one before it in ``order``, by position.

    Kasai's walk: from one position of a run to the next the common prefix shrinks by one at most. All runs walk together.
    ``text`` ends with ``most`` padding symbols beyond the last run; runs end in symbols of their own.
    """
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    before = np.where(place > 0, order[place - 1], -1)
    out = np.zeros(len(order), np.int64)
    by = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by], lengths[by]
    h = np.zeros(len(starts), np.int64)
    for offset in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -offset, side="left"))
        i = starts[:live] + offset
        j = before[i]
        h = np.where(j >= 0, np.maximum(h[:live] - 1, 0), 0)
        going = np.flatnonzero(j >= 0)
        while len(going):
            a, b = i[going] + h[going], j[going] + h[going]
            going = going[(text[a] == text[b]) & (h[going] < most)]
            h[going] += 1
        out[i] = h
    return out


def shared_windows(parts: list[bytes], counts: np.ndarray, window: int) -> list[np.ndarray]:
    """For each part (a run's bytes, ``counts`` windows long), which of its windows occur elsewhere in the parts.

    All parts form one text; each ends with a symbol of its own, so that no common prefix runs over an end.
    """
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    n = int((sizes + 2).sum())
    text = np.zeros(n, np.int64)
    inside = ranges(starts, sizes)
    text[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + 1
    # the end of part k: two symbols above all bytes, k in base 255
    k = np.arange(len(parts))
    text[starts + sizes] = 257 + k % 255
    text[starts + sizes + 1] = 257 + k // 255 % 255
    order = suffix_array(text)
    ends = text.copy()
    ends[starts + sizes] = -1 - k  # distinct for the comparison of prefixes
    padded = np.append(ends, np.full(window + 1, -(1 << 40)))
    common = kasai(padded, order, starts, sizes, window)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    after = np.append(common[order[1:]], 0)  # common prefix with the next suffix
    hit = (common >= window) | (after[place] >= window)
    return [hit[s : s + c] for s, c in zip(starts.tolist(), counts.tolist())]


# ---- runs of documents ------------------------------------------------------------------------------------------------


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, length of each text) in pieces of bounded size."""
    raw, begin, end = buffers(batch.column(column))
    at = 0
    while at < len(begin):
        first, size = at, 0
        while at < len(begin) and (size < PIECE):
            size += int(end[at] - begin[at])
            at += 1
        counts = end[first:at] - begin[first:at]
        yield first, raw[ranges(begin[first:at], counts)], counts


def digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """BLAKE2b digests of stretches of bytes, as two unsigned 64-bit columns."""
    view, digest = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    joined = b"".join([digest(view[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist())])
    return np.frombuffer(joined, np.uint64).reshape(-1, 2)


def _scan(data: np.ndarray, counts: np.ndarray, roll: Roller, window: int, gram: int):
    if len(data) < window:
        return None
    prefix = roll.prefix(data.astype(np.uint64) + np.uint64(1))
    grams = roll.windows(prefix, gram)
    # minima with their places: of equal grams the leftmost counts
    place = sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), window - gram + 1) & _PLACE
    least = grams[place.astype(np.int64)]
    # a window is valid if no text ends within it
    valid = np.zeros(len(least), bool)
    begin = np.cumsum(counts) - counts
    some = counts >= window
    valid[ranges(begin[some], counts[some] - window + 1)] = True
    start, n = runs_of(valid, least)
    row = np.searchsorted(begin, start, side="right") - 1
    while len(row) and (counts[row] == 0).any():  # several texts may begin at one place: the last one has bytes
        row = np.where(counts[row] == 0, row + 1, row)
    content = digests(data, start, start + n + window - 1)
    # equal windows in one run have their minimizers at different places
    moves = np.append(0, np.cumsum(place[1:] != place[:-1]))
    return start, n, row, least[start], content, begin, moves[start + n - 1] != moves[start]


def _hot(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()
        for batch in batches:
            for _, data, counts in _pieces(batch, 0):
                if (found := _scan(data, counts, roll, window, gram)) is None:
                    continue
                _, _, row, key, _, _, _ = found
                pairs = np.unique(np.stack([row.astype(np.uint64), key]), axis=1) if len(row) else np.zeros((2, 0), np.uint64)
                keys, n = np.unique(pairs[1], return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return run


def hot_keys(slim: DataFrame, window: int, gram: int) -> np.ndarray:
    """Very frequent minimizers of a sample: a hint for dealing that results don't depend on; at most 100,000."""
    sample = slim.filter(F.pmod(F.xxhash64("id", "print"), F.lit(SAMPLE)) == 0)
    counted = sample.select("text").mapInArrow(tidy(_hot(window, gram)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    least = max(3, min(HOT_ROWS // SAMPLE, int(sample.count() * HOT_SHARE)))
    found = counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(100_000).collect()
    return np.sort(np.array([r["key"] for r in found], np.int64).view(np.uint64))


def _runs(window: int, gram: int, hot: np.ndarray, schema: pa.Schema):
    """Rows (key, mini, content, proof, id, print, start, n, known, own); own: the run may repeat itself. A hot run is dealt by its content, others by their minimizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, seen = Roller(), Seen()
        for batch in batches:
            prints = batch.column(1).to_numpy()
            for first, data, counts in _pieces(batch, 2):
                if (found := _scan(data, counts, roll, window, gram)) is None or not len(found[0]):
                    continue
                start, n, row, mini, content, begin, own = found
                content, proof = content[:, 0].copy(), content[:, 1].copy()
                known = ~seen.keep(content, proof)
                key = np.where(np.isin(mini, hot), mix64(content ^ mini), mini)
                key = np.where(known, mix64(prints[first + row].view(np.uint64) + start.astype(np.uint64)), key)
                at = first + row
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), pa.array(mini.view(np.int64)), pa.array(content.view(np.int64)), pa.array(proof.view(np.int64)), batch.column(0).take(pa.array(at)), pa.array(prints[at]),
                    pa.array((start - begin[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(known), pa.array(own),
                ], schema=schema)

    return run


def _settle(window: int, hot: np.ndarray, most: int):
    """Owner of minimizers: rows (id, print, begin, end, mini, content, open). Not open: repeated; open: for a shard to sort out.

    Rows come sorted by key and content. A key of more than ``most`` rows comes in several tables; all its contents go to the shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, last = None, None
        for t, begun, goes_on in by_key_cut(batches, 200_000, most):
            if carry is not None:
                t, carry = pa.concat_tables([carry, t]), None
            key, mini, content, proof = (t.column(name).to_numpy() for name in ("key", "mini", "content", "proof"))
            start, n = t.column("start").to_numpy().astype(np.int64), t.column("n").to_numpy().astype(np.int64)
            known = t.column("known").to_numpy()
            free = np.flatnonzero(~known)
            order = free[np.lexsort((proof[free], content[free], key[free]))]
            if goes_on and len(order):
                end = order[-1]
                alike = (key[order] == key[end]) & (content[order] == content[end]) & (proof[order] == proof[end])
                if alike.sum() == 1 and last != (key[end], content[end], proof[end]):  # its copies may come later
                    carry, order = t.slice(int(end), 1), order[:-1]
            k, c, p = key[order], content[order], proof[order]
            new_key = np.ones(len(order), bool)
            new_key[1:] = k[1:] != k[:-1]
            new = new_key.copy()
            new[1:] |= (c[1:] != c[:-1]) | (p[1:] != p[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(order)))
            group = np.cumsum(new_key) - 1
            cut = (begun & (k == key[0])) | (goes_on & (k == key[-1])) if len(key) else np.zeros(0, bool)
            mixed = ((np.bincount(group, new)[group] > 1) | cut)[first] | np.isin(mini[order[first]].view(np.uint64), hot) | t.column("own").to_numpy()[order[first]]
            met = np.array([last == x for x in zip(k[first].tolist(), c[first].tolist(), p[first].tolist())], bool) if begun and last else np.zeros(len(first), bool)
            if len(order):
                last = k[-1].item(), c[-1].item(), p[-1].item()
            # copies: all rows of a content that comes twice; the first row of each content of a mixed minimizer goes on
            done = np.concatenate([np.flatnonzero(known), order[np.repeat((size > 1) | met, size)]])
            rows = np.concatenate([done, order[first[mixed & ~met]]])
            yield settled(t, rows, len(done), start, n, mini, content)
        if carry is not None:
            one = [carry.column(name).to_numpy() for name in ("start", "n", "mini", "content")]
            yield settled(carry, np.zeros(1, np.int64), 0, one[0].astype(np.int64), one[1].astype(np.int64), *one[2:])

    def settled(t: pa.Table, rows: np.ndarray, done: int, start: np.ndarray, n: np.ndarray, mini: np.ndarray, content: np.ndarray) -> pa.RecordBatch:
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays([
            t.column("id").take(at).combine_chunks(), t.column("print").take(at).combine_chunks(), pa.array(start[rows].astype(np.int32)),
            pa.array((start[rows] + n[rows] - 1 + window).astype(np.int32)), pa.array(mini[rows]), pa.array(content[rows]), pa.array(np.arange(len(rows)) >= done),
        ], names=["id", "print", "begin", "end", "mini", "content", "open"])

    return run


def _extents(hot: np.ndarray, schema: pa.Schema):
    """(id, print, text, runs) to one row for each run with its bytes: (key, id, print, start, wide, bytes). Hot runs are wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, begin, _ = buffers(batch.column(2))
            lists = batch.column(3)
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            flat = lists.flatten()
            b, e = (flat.field(x).to_numpy().astype(np.int64) for x in ("begin", "end"))
            mini, content = (flat.field(x).to_numpy().view(np.uint64) for x in ("mini", "content"))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            wide = np.isin(mini, hot)
            key = np.where(wide, mix64(content), mini)
            for at in range(0, len(row), 20_000):
                part = slice(at, at + 20_000)
                take = pa.array(row[part])
                yield pa.RecordBatch.from_arrays([
                    pa.array(key[part].view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(b[part].astype(np.int32)),
                    pa.array(wide[part]), binary_array(raw[ranges(begin[row[part]] + b[part], e[part] - b[part])], e[part] - b[part]),
                ], schema=schema)

    return run


def _shards(window: int, most: int, room: int, schema: pa.Schema):
    """Suffix arrays over runs. Rows (id, print, begin, end, key, proof): spans, and the digests of the windows of wide runs for the merge."""

    def one(t: pa.Table, wide: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = t.column("bytes").to_pylist()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        counts = sizes - window + 1
        hits = shared_windows(parts, counts, window)
        start = t.column("start").to_numpy().astype(np.int64)
        record = np.repeat(np.arange(len(parts)), counts)
        place = ranges(start, counts)
        flag = np.concatenate(hits)
        rows, begin, end = flagged_spans(flag, record, place, window)
        none = pa.nulls(len(rows), pa.int64())
        ids, prints = t.column("id").combine_chunks(), t.column("print").combine_chunks()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), prints.take(pa.array(rows)), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), none, none], schema=schema)
        if wide.any():
            chosen = np.flatnonzero(wide[record])
            at = ranges(np.cumsum(sizes) - sizes, counts)[chosen]
            marks = digests(np.frombuffer(b"".join(parts), np.uint8), at, at + window)
            # of the windows that are repeated in here, one of each stands for all; the rest ask
            order = np.lexsort((marks[:, 1], marks[:, 0]))
            again = np.append(False, (marks[order[1:]] == marks[order[:-1]]).all(axis=1))[: len(order)]
            order = order[~(again & flag[chosen[order]])]
            chosen, marks = chosen[order], marks[order].view(np.int64)
            rows = pa.array(record[chosen])
            yield pa.RecordBatch.from_arrays([
                ids.take(rows), prints.take(rows), pa.array(place[chosen].astype(np.int32)), pa.array((place[chosen] + window).astype(np.int32)),
                pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy()),
            ], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begun, goes_on in by_key_cut(batches, 4_000, most):
            key = t.column("key").to_numpy()
            size = pc_lengths(t) + 2
            part = (begun & (key == key[0])) | (goes_on & (key == key[-1]))  # of a key that other tables have too
            lo = 0
            while lo < len(key):
                upto = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), room, side="right")))
                split = upto < len(key) and key[upto] == key[upto - 1]
                if split and (head := int(np.flatnonzero(key == key[upto])[0])) > lo:
                    upto, split = head, False  # the key that doesn't fit begins the next shard
                if split:
                    part = part | (key == key[upto])  # one minimizer fills several shards
                yield from one(t.slice(lo, upto - lo), t.column("wide").to_numpy()[lo:upto] | part[lo:upto])
                lo = upto

    return run


def pc_lengths(t: pa.Table) -> np.ndarray:
    """Lengths of the binaries in column ``bytes``."""
    return np.concatenate([np.diff(np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, c.offset * 4)) for c in t.column("bytes").chunks if len(c)]).astype(np.int64)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of several shards, sorted by their digests: repeated are those that binary search finds in more than one place."""
    for t, flags in repeated_rows(batches, 200_000, 400_000):
        yield from t.filter(pa.array(flags)).drop_columns(["key", "proof"]).to_batches()


def attach(slim: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``id, print, text`` and the list of each document; both sides are shuffled by document, at every size alike."""
    lists = lists.withColumnsRenamed({"id": "_id", "print": "_print"})
    return slim.join(lists, slim["id"].eqNullSafe(F.col("_id")) & (slim["print"] == F.col("_print")), how).drop("_id", "_print")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, begins, ends = span_arrays(batch.column(2))
        total, gone, spans, digest = [], [], [], []
        for i, text in enumerate(text_bytes(batch.column(1))):
            lo, hi = offsets[i], offsets[i + 1]
            b, e = merge(begins[lo:hi], ends[lo:hi]) if hi > lo else (begins[:0], ends[:0])
            digester, last = hashlib.sha256(), 0
            for x, y in zip(b.tolist(), e.tolist()):
                digester.update(text[last:x])
                last = y
            digester.update(text[last:])
            total.append(len(text))
            gone.append(int((e - b).sum()))
            spans.append(len(b))
            digest.append(digester.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (total, gone, spans)), pa.array(digest, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _fields(kind: T.DataType, **types: T.DataType) -> tuple[T.StructType, pa.Schema]:
    """A schema for Spark and for Arrow; the type of ``id`` is ``kind``."""
    fields = [T.StructField(n, kind if n == "id" else t) for n, t in types.items()]
    return T.StructType(fields), pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])


def repeated_byte_spans(slim: DataFrame, window: int, gram: int, most_runs: int = MOST_RUNS, most_parts: int = MOST_PARTS, room: int = SHARD) -> DataFrame:
    """``id, print, begin, end``: bytes that repeated windows cover. ``slim`` has id, print (hash of the text) and text."""
    n = partitions(slim.sparkSession)
    kind, long, int_ = slim.schema["id"].dataType, T.LongType(), T.IntegerType()
    hot = hot_keys(slim, window, gram)
    spark_schema, arrow = _fields(kind, key=long, mini=long, content=long, proof=long, id=kind, print=long, start=int_, n=int_, known=T.BooleanType(), own=T.BooleanType())
    dealt = slim.mapInArrow(tidy(_runs(window, gram, hot, arrow)), spark_schema).repartition(n, "key").sortWithinPartitions("key", "content", "proof")
    settled_schema, _ = _fields(kind, id=kind, print=long, begin=int_, end=int_, mini=long, content=long, open=T.BooleanType())
    settled = stash(dealt.mapInArrow(tidy(_settle(window, hot, most_runs)), settled_schema), "settled")
    open_ = settled.filter("open")
    lists = open_.groupBy("id", "print").agg(F.collect_set(F.struct("begin", "end", "mini", "content")).alias("runs"))
    extent_schema, arrow = _fields(kind, key=long, id=kind, print=long, start=int_, wide=T.BooleanType(), bytes=T.BinaryType())
    extents = attach(slim, lists, "inner").select("id", "print", "text", "runs").mapInArrow(tidy(_extents(hot, arrow)), extent_schema)
    shard_schema, arrow = _fields(kind, id=kind, print=long, begin=int_, end=int_, key=long, proof=long)
    shards = stash(extents.repartition(n, "key").sortWithinPartitions("key").mapInArrow(tidy(_shards(window, most_parts, room, arrow)), shard_schema), "shards")
    span_schema, _ = _fields(kind, id=kind, print=long, begin=int_, end=int_)
    across = shards.filter("key is not null").repartition(n, "key").sortWithinPartitions("key", "proof").mapInArrow(tidy(_merge), span_schema)
    columns = ["id", "print", "begin", "end"]
    return settled.filter("not open").select(columns).unionByName(shards.filter("key is null").select(columns)).unionByName(across)


def suffix_dedup(docs: DataFrame, window: int = 200, gram: int = 100, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """Remove every byte of a ``window`` bytes long string that also starts anywhere else: ``id_col, n_bytes, n_removed, n_spans, kept_sha256``.

    Texts are taken as UTF-8; strings are judged on the input, never cross documents, and may overlap their repetition.
    Repeated rows are repetitions of each other. A null text is empty. Null ids are kept; an empty table gives an empty
    result; other columns are not read. ``bounds``: ``most_runs``, ``most_parts`` and ``room``, the rows of a minimizer and
    the bytes of a shard that a task holds at once.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("print"), F.col(text_col).cast("string").alias("text"))
    spans = stash(repeated_byte_spans(slim, window, gram, **bounds), "spans")
    lists = spans.groupBy("id", "print").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))  # repeated rows find equal spans
    joined = attach(slim, lists, "left").select("id", "text", "spans")
    schema, _ = _fields(kind, id=kind, n_bytes=T.LongType(), n_removed=T.LongType(), n_spans=T.LongType(), kept_sha256=T.StringType())
    return joined.mapInArrow(tidy(_cut), schema).withColumnRenamed("id", id_col)
