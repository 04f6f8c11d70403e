"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

N-grams of tokens are packed in one long integer (16 bits a token). The counts, continuation counts, discounts, back-off
masses and interpolated probabilities come from grouped counts and equality joins sharded by context or by suffix. So does a
document's perplexity: its n-grams, counted, are sent to the shards that hold their probabilities, and the sums of their
logarithms come back. Only what the vocabulary bounds is broadcast: probabilities of single tokens and masses of contexts of
one token. A document is kept if its log perplexity is at most a quantile of held-out trusted documents of its language,
plus some slack.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, mix64, own, partitions, small_batches, stash, tidy
from .packing import encode, encoding

BITS = 16
#: The token before the first one; no text yields it.
BEGIN = (1 << BITS) - 1
#: Log perplexities are counted in bins of this width for their quantiles.
BIN = 0.001
#: Up to so many trusted ids (8 bytes each) are broadcast to the texts; beyond that both are shuffled.
BROADCAST_IDS = 1_000_000
#: One trusted id in so many is held out for the thresholds.
HOLD_OUT = 5
#: N-grams in one shard of the model, and the least number of shards.
SHARD, LEAST_SHARDS = 1_000_000, 16
#: Tokens and texts whose n-grams are counted and sent together.
PIECE, PIECE_TEXTS = 300_000, 30_000
_MASK = (1 << BITS) - 1


@dataclass
class Base:
    """What the vocabulary bounds: probability of each single token, and back-off mass of each context of one token (NaN: none)."""

    order: int
    unigram: np.ndarray
    mass: np.ndarray


@dataclass
class Model:
    """``chunks`` (shard, level, keys, values): level k for sorted n-grams of order k + 1 and their probabilities, -k for contexts of k tokens and their masses."""

    base: Base
    count: int
    chunks: DataFrame | None


@dataclass
class Shard:
    """One shard's n-grams of orders 2 and up, by level."""

    base: Base
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)
    ready: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def add(self, level: int, keys: bytes, values: bytes) -> None:
        self.parts.setdefault(level, []).append((np.frombuffer(keys, np.int64), np.frombuffer(values, np.float64)))

    def _find(self, level: int, keys: np.ndarray, none: float) -> np.ndarray:
        if level not in self.ready:
            held = self.parts.pop(level, [])
            k, v = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0))
            by = np.argsort(k, kind="stable")
            self.ready[level] = k[by], v[by]
        k, v = self.ready[level]
        if not len(k):
            return np.full(len(keys), none)
        at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
        return np.where(k[at] == keys, v[at], none)

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of the last token of each n-gram of the full order."""
        prob = self.base.unigram[grams & _MASK]
        for k in range(1, self.base.order):
            gram = grams & ((1 << (BITS * (k + 1))) - 1)
            found = self._find(k, gram, math.nan)
            mass = self.base.mass[gram >> BITS] if k == 1 else self._find(-k, gram >> BITS, math.nan)
            prob = np.where(np.isnan(found), np.where(np.isnan(mass), 1.0, mass) * prob, found)
        return np.log(prob)


def _spread(order: int, count: int) -> int:
    """Over how many shards the followers of a token are spread."""
    return count if order == 2 else min(4, count)


def _shard_of(before: np.ndarray, last: np.ndarray, order: int, count: int) -> np.ndarray:
    """The shard of a token and the one before it: all that a position looks up lies there, and no token's followers fill one shard."""
    home = mix64(before.astype(np.uint64)) % np.uint64(count)
    return ((home + mix64(last.astype(np.uint64) + np.uint64(1)) % np.uint64(_spread(order, count))) % np.uint64(count)).astype(np.int32)


def _grams(tokens: np.ndarray, begins: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each token; a text begins at each of ``begins``."""
    n = len(tokens)
    gram = tokens.astype(np.int64)
    place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
    for k in range(1, order):
        before = np.full(n, BEGIN, np.int64)
        before[k:] = np.where(place[k:] >= k, tokens[: max(0, n - k)], BEGIN)
        gram = gram | (before << (BITS * k))
    return gram


def _pieces(path: str, batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens, tokens of each text) of some hundred thousand tokens at a time."""
    of = encoding(path)
    raw, begin, end = buffers(batch.column(column))
    view, at = memoryview(raw), 0
    while at < batch.num_rows:
        first, held, size = at, [], 0
        while at < batch.num_rows and size < PIECE and at - first < PIECE_TEXTS:
            held.append(encode(of, str(view[begin[at] : end[at]], "utf-8")).astype(np.int64))
            size += len(held[-1])
            at += 1
        yield first, np.concatenate(held), np.fromiter(map(len, held), np.int64, len(held))


def _counts(path: str, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, tokens, count in _pieces(path, batch, 0):
                keys, n = np.unique(_grams(tokens, (np.cumsum(count) - count)[count > 0], order), return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "n": pa.array(n.astype(np.int64))})

    return run


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ from the counts of counts 1 to 4, kept within [0, k]."""
    of = {r["n"]: r["c"] for r in counts.filter("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    n = [max(1, of.get(k, 0)) for k in range(5)]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(k, max(0.0, k - (k + 1) * y * n[k + 1] / n[k])) for k in (1, 2, 3)]


def _discount(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def fit(texts: DataFrame, tokenizer: str, order: int = 2, vocabulary: int = 50_257) -> Model | None:
    """Train on all rows of ``texts`` (column text). None if they have no tokens."""
    if not 1 <= order <= 3:
        raise ValueError("three tokens fit a key")
    counts = [stash(texts.select("text").mapInArrow(tidy(_counts(tokenizer, order)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), f"grams-{order}")]
    for k in range(order - 1, 0, -1):  # continuation counts of the lower orders: distinct predecessors of each suffix
        suffix = F.col("key").bitwiseAND(F.lit((1 << (BITS * k)) - 1))
        counts.insert(0, stash(counts[0].groupBy(suffix.alias("key")).agg(F.count(F.lit(1)).alias("n")), f"grams-{k}"))
    whole = counts[0].agg(F.sum("n")).first()[0]
    if not whole:
        return None
    d = _discounts(counts[0])
    mass = counts[0].agg(F.sum(_discount(F.col("n"), d))).first()[0] / whole
    floor = mass / vocabulary
    lower = stash(counts[0].select("key", ((F.col("n") - _discount(F.col("n"), d)) / F.lit(float(whole)) + F.lit(floor)).alias("p")), "level-1")
    levels, backoffs = [lower], [None]
    for k in range(1, order):
        d = _discounts(counts[k])
        grams = counts[k].withColumns({"context": F.shiftright("key", BITS), "suffix": F.col("key").bitwiseAND(F.lit((1 << (BITS * k)) - 1))})
        contexts = grams.groupBy("context").agg(F.sum("n").alias("total"), F.sum(_discount(F.col("n"), d)).alias("held")).select("context", "total", (F.col("held") / F.col("total")).alias("mass"))
        contexts = stash(contexts, "contexts")
        own = (F.col("n") - _discount(F.col("n"), d)) / F.col("total")
        lower = grams.join(contexts, "context").join(lower.select(F.col("key").alias("suffix"), "p"), "suffix").select("key", (own + F.col("mass") * F.col("p")).alias("p"))
        lower = stash(lower, f"level-{k + 1}")
        levels.append(lower)
        backoffs.append(contexts)
    unigram, mass = np.full(1 << BITS, floor), np.full(1 << BITS, math.nan)
    for df, to in ((levels[0], unigram), (backoffs[1] if order > 1 else None, mass)):  # a row for each token of the vocabulary at most
        if df is not None:
            t = df.select(df.columns[0], df.columns[-1]).toArrow()
            to[t.column(0).to_numpy()] = t.column(1).to_numpy()
    base = Base(order, unigram, mass)
    if order == 1:
        return Model(base, 1, None)
    size, n = sum(df.count() for df in levels[1:]), partitions(texts.sparkSession)
    count = max(LEAST_SHARDS, -(-size // SHARD), math.isqrt(n))
    rows = [df.select(F.lit(k * sign).alias("level"), F.col(df.columns[0]).alias("key"), F.col(df.columns[-1]).alias("value")) for k in range(1, order) for sign, df in ((1, levels[k]), (-1, backoffs[k])) if k * sign != -1]
    placed = reduce(DataFrame.unionByName, rows).mapInArrow(tidy(_place(order, count)), "shard int, level int, key long, value double")
    chunks = placed.repartition(n, "shard").sortWithinPartitions("shard", "level", "key").mapInArrow(tidy(_chunks), "shard int, level int, keys binary, vals binary")
    return Model(base, count, stash(chunks, "model"))


def _place(order: int, count: int):
    """The shard of each n-gram; contexts of two tokens go to all shards of their last token's followers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level, key, value = (batch.column(c).to_numpy() for c in range(3))
            gram = np.flatnonzero(level > 0)
            shard = [_shard_of(key[gram] >> BITS & _MASK, key[gram] & _MASK, order, count)]
            rows = [gram]
            context = np.flatnonzero(level < 0)
            home = (mix64((key[context] & _MASK).astype(np.uint64)) % np.uint64(count)).astype(np.int64)
            for k in range(_spread(order, count)):
                rows.append(context)
                shard.append(((home + k) % count).astype(np.int32))
            at = np.concatenate(rows)
            yield pa.RecordBatch.from_pydict({"shard": pa.array(np.concatenate(shard)), "level": pa.array(level[at]), "key": pa.array(key[at]), "value": pa.array(value[at])})

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one shard and level as two binaries."""
    for batch in batches:
        shard, level, key, value = (batch.column(c).to_numpy() for c in range(4))
        first = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (level[1:] != level[:-1]))) if len(shard) else np.zeros(0, np.int64)
        cut = [*zip(first.tolist(), [*first[1:].tolist(), len(shard)])]
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array(shard[first]), "level": pa.array(level[first]),
            "keys": pa.array([key[a:b].tobytes() for a, b in cut], pa.binary()), "vals": pa.array([value[a:b].tobytes() for a, b in cut], pa.binary()),
        })


def _squeeze(x: np.ndarray) -> bytes:
    return len(x).to_bytes(4, "little") + pa.compress(x.tobytes(), "zstd", asbytes=True)


def _unsqueeze(x: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(x[:4], "little") * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(x[4:], n, "zstd", asbytes=True), kind)


#: Rows that meet in a shard: 0 a part of the model (level, keys, values), 1 counted n-grams of a piece, 2 what needs no shard.
_MET = "slot int, turn int, name binary, level int, a binary, b binary, c binary, d binary"
_SUMS = "name binary, texts binary, docs binary, n binary, total binary"
_names = lambda schema: [c.split()[0] for c in schema.split(", ")]


def _send(path: str, sent, count: int, replicas: int):
    """Texts (digest, text) to rows of ``_MET``: a piece's n-grams by shard, each once with the texts that have it and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = sent.value
        for batch in batches:
            digests = batch.column(0).to_pylist()
            for first, tokens, sizes in _pieces(path, batch, 1):
                texts = len(sizes)
                joined = b"".join(digests[first : first + texts])
                name = hashlib.md5(joined).digest()
                turn = int.from_bytes(name[:8], "little")
                gram = _grams(tokens, (np.cumsum(sizes) - sizes)[sizes > 0], base.order)
                doc = np.repeat(np.arange(texts), sizes)
                # after a token that the model hasn't as a context nothing but the token itself counts
                known = ~np.isnan(base.mass[gram >> BITS & _MASK]) if base.order > 1 else np.zeros(len(gram), bool)
                loose = ~known
                total = np.bincount(doc[loose], np.log(base.unigram[gram[loose] & _MASK]), texts)
                mine = np.bincount(doc[loose], minlength=texts)
                rows = [(turn % (count * replicas), 2, name, None, joined, sizes.astype(np.int32).tobytes(), mine.astype(np.int32).tobytes(), total.tobytes())]
                both, times = np.unique((doc[known].astype(np.uint64) << np.uint64(48)) | gram[known].astype(np.uint64), return_counts=True)
                gram, doc = (both & np.uint64((1 << 48) - 1)).astype(np.int64), (both >> np.uint64(48)).astype(np.uint16)
                shard = _shard_of(gram >> BITS & _MASK, gram & _MASK, base.order, count)
                by = np.lexsort((gram, shard))
                gram, doc, shard, times = gram[by], doc[by], shard[by], times[by]
                edge = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist() if len(shard) else []
                for a, b in zip(edge, [*edge[1:], len(shard)]):
                    g = gram[a:b]
                    own = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                    each = np.diff(np.append(own, len(g)))
                    parts = np.diff(g[own], prepend=0), each.astype(np.uint16), doc[a:b], times[a:b].astype(np.uint32)
                    rows.append((int(shard[a]) * replicas + turn % replicas, 1, name, None, *map(_squeeze, parts)))
                yield pa.RecordBatch.from_pydict(dict(zip(_names(_MET), (pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int32(), pa.binary(), pa.int32(), *[pa.binary()] * 4])))))

    return run


def _look_up(sent):
    """Rows sorted by slot and turn to rows of ``_SUMS``: for each piece, which of its texts (by number) have how many n-grams here, and their log probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            out: list[tuple] = []
            for slot, turn, name, level, a, b, c, d in zip(*(x.to_pylist() for x in batch.columns)):
                if slot != at:
                    at, shard = slot, Shard(sent.value)
                if turn == 0:
                    shard.add(level, a, b)
                elif turn == 2:
                    out.append((name, a, b, c, d))
                else:
                    logs = np.repeat(shard.logs(np.cumsum(_unsqueeze(a, np.int64))), _unsqueeze(b, np.uint16))
                    doc, times = _unsqueeze(c, np.uint16), _unsqueeze(d, np.uint32)
                    n = np.bincount(doc, times)
                    some = np.flatnonzero(n)
                    out.append((name, None, some.astype(np.uint16).tobytes(), n[some].astype(np.int32).tobytes(), np.bincount(doc, logs * times)[some].tobytes()))
            yield pa.RecordBatch.from_pydict(dict(zip(_names(_SUMS), (pa.array(c, pa.binary()) for c in (zip(*out) if out else [[]] * 5)))))

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by piece to (text, copies, n, total): the sums of all shards for each text of a piece."""

    def close(held: list[tuple]) -> pa.RecordBatch:
        local = [r for r in held if r[1] is not None]
        digests, sizes = local[0][1], np.frombuffer(local[0][2], np.int32).astype(np.int64)  # pieces of one name have equal texts
        n, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
        for _, texts, docs, count, sums in held:
            where = slice(None) if texts is not None else np.frombuffer(docs, np.uint16)
            n[where] += np.frombuffer(count, np.int32)
            total[where] += np.frombuffer(sums, np.float64)
        if (n != len(local) * sizes).any():
            raise RuntimeError("rows came in another order when a task ran again; score a table that is read from files")
        names = pa.array([digests[16 * i : 16 * i + 16] for i in range(len(sizes))], pa.binary())
        return pa.RecordBatch.from_pydict({"text": names, "copies": pa.array(np.full(len(sizes), len(local), np.int64)), "n": pa.array(n), "total": pa.array(total)})

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(x.to_pylist() for x in batch.columns)):
            if held and held[0][0] != row[0]:
                yield close(held)
                held = []
            held.append(row)
    if held:
        yield close(held)


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def score(texts: DataFrame, model: Model, tokenizer: str) -> DataFrame:
    """``text`` (MD5), ``tokens`` and ``log_perplexity`` (null without tokens) of each distinct text in column ``text``.

    A piece of some hundred thousand tokens sends each of its n-grams once to the shard that has its probability, with the
    texts it is in; a shard answers with a sum for each text of the piece. Shards of a small model are replicated, so that
    there is work for every task.
    """
    spark, n = texts.sparkSession, partitions(texts.sparkSession)
    base = spark.sparkContext.broadcast(model.base)
    replicas = max(1, n // model.count)
    met = texts.filter("text is not null").select(digest(F.col("text")).alias("digest"), "text").mapInArrow(tidy(_send(tokenizer, base, model.count, replicas)), _MET)
    if model.chunks is not None:
        copies = model.chunks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
        none = F.lit(None).cast("binary")
        met = met.unionByName(copies.select((F.col("shard") * replicas + F.col("copy")).cast("int").alias("slot"), F.lit(0).alias("turn"), none.alias("name"), "level", F.col("keys").alias("a"), F.col("vals").alias("b"), none.alias("c"), none.alias("d")))
    sums = met.repartition(n, "slot").sortWithinPartitions("slot", "turn").mapInArrow(tidy(_look_up(base)), _SUMS)
    found = sums.repartition(n, "name").sortWithinPartitions("name").mapInArrow(tidy(_gather), "text binary, copies long, n long, total double")
    each = found.groupBy("text").agg(F.sum("copies").alias("copies"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    return each.select("text", F.expr("n div copies").alias("tokens"), F.when(F.col("n") > 0, F.round(-F.col("total") / F.col("n"), 6)).alias("log_perplexity"))


def _trusted(labels: DataFrame) -> DataFrame:
    good = labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct()
    return good.withColumn("held", F.pmod(F.xxhash64("_trusted"), F.lit(HOLD_OUT)) == 0)


def classify(docs: DataFrame, labels: DataFrame, tokenizer: str, order: int = 2, quantile: float = 0.99, slack: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id, lang, text`` (MD5), ``tokens, log_perplexity, limit, kept`` of every row.

    The model is fitted to all labelled good, harmless documents that are not held out. Every document is scored; the limit of a language is ``quantile`` of the log perplexities of all its
    held-out trusted documents, plus ``slack``; languages without any take that of all languages together. Without a
    model or limits everything with tokens is kept. Texts without tokens, null ones too, are not kept. Null languages are a
    language; null ids are scored, but never trusted; repeated rows are scored each.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    trusted = stash(_trusted(labels), "trusted")
    ids = trusted.filter(~F.col("held")).select("_trusted")
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = slim.join(F.broadcast(ids) if small else ids, slim["id"] == ids["_trusted"], "left_semi").select("text")
    model = fit(texts, tokenizer, order) or Model(Base(1, np.full(1 << BITS, 1 / 50_257), np.full(1 << BITS, math.nan)), 1, None)
    sums = stash(score(slim.select("text"), model, tokenizer), "sums").withColumnRenamed("text", "_text")
    rows = slim.withColumn("text", digest(F.col("text")))
    scored = stash(rows.join(sums, F.col("text") == F.col("_text"), "left").select("id", "lang", "text", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), "log_perplexity"), "scored")
    held = trusted.filter("held").select("_trusted")
    mine = scored.join(held, scored["id"] == held["_trusted"], "left_semi").select("lang", F.floor(F.col("log_perplexity") / BIN).alias("bin")).filter("bin is not null")
    bins = mine.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    limits = _limits([(r["lang"], r["bin"], r["n"]) for r in bins.collect()], quantile, slack)  # bins of few languages
    overall = limits.pop(("all",), None)
    table = spark.createDataFrame([(k[0], v) for k, v in limits.items()], "_lang string, _limit double")
    out = scored.join(F.broadcast(table), scored["lang"].eqNullSafe(table["_lang"]), "left").withColumn("limit", F.coalesce("_limit", F.lit(overall).cast("double"))).drop("_lang", "_limit")
    return out.withColumn("kept", F.coalesce(F.col("log_perplexity") <= F.coalesce("limit", F.lit(float("inf"))), F.lit(False)))


def _limits(bins: list[tuple], quantile: float, slack: float) -> dict[tuple, float]:
    """{(lang,): limit}, and ("all",) for all together: the upper edge of the bin in which the quantile lies, plus slack."""
    groups: dict[tuple, list] = {}
    for lang, b, n in bins:
        groups.setdefault((lang, 0), []).append((b, n))
        groups.setdefault(("all", 1), []).append((b, n))
    out = {}
    for (name, every), rows in groups.items():
        total, run = sum(n for _, n in rows), 0
        for b, n in sorted(rows):
            run += n
            if run >= quantile * total:
                out[("all",) if every else (name, "lang")] = round((b + 1) * BIN + slack, 6)
                break
    return out


def quality_verdicts(docs: DataFrame, labels: DataFrame, tokenizer: str, id_col: str = "doc_id", **options) -> DataFrame:
    """``id_col, lang, n_tokens, perplexity, limit, kept`` of every row; see ``classify``."""
    out = classify(docs, labels, tokenizer, id_col=id_col, **options)
    return out.select(F.col("id").alias(id_col), "lang", F.col("tokens").alias("n_tokens"), F.round(F.exp("log_perplexity"), 4).alias("perplexity"), F.round(F.exp("limit"), 4).alias("limit"), "kept")


def keep_good(docs: DataFrame, labels: DataFrame, tokenizer: str, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The documents that the classifier keeps, with their own columns.

    The verdict depends on text and language alone, so rows meet it by these; no column of ``docs`` is touched.
    """
    kept = stash(classify(docs, labels, tokenizer, text_col=text_col, lang_col=lang_col, **options).filter("kept").select("text", "lang").distinct(), "kept")
    kept = kept.select(F.col("text").alias(own("text", docs)), F.col("lang").alias(own("lang", docs)))
    same = (digest(docs[text_col].cast("string")) == kept[kept.columns[0]]) & docs[lang_col].cast("string").eqNullSafe(kept[kept.columns[1]])
    return docs.join(kept, same, "left_semi")
