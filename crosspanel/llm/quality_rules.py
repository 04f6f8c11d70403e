"""Quality rules (native: DataFrame functions only).

Counts of a text's words, lines and symbols give a base verdict. What passes it is judged by a hashed n-gram
log-likelihood ratio: word and word-pair features are hashed to buckets, one multinomial is fitted to a trusted target and
one to the whole corpus, and a document's mean log ratio must reach a quantile of the trusted documents' own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WORD, stash

WINDOW = 8
#: Scores are counted in bins of this width to find the one of their quantile.
BIN = 0.01


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WHITE}]+"), "")


def base_counts(docs: DataFrame, text: Column) -> DataFrame:
    """Adds ``words`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    windows = F.transform(F.sequence(F.lit(1), F.col("n_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    none = F.array().cast("array<long>")
    out = docs.withColumns({"words": _words(text), "n_symbols": F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long"), "lines": lines})
    out = out.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    }).drop("lines")
    out = out.withColumn("hashes", F.when(F.col("n_words") >= WINDOW, windows).otherwise(none))
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn("placed", F.when(twice, F.array_sort(placed))).drop("hashes")
    same = lambda x, k: F.coalesce(F.get("placed", k)["h"] == x["h"], F.lit(False))
    repeated = F.filter("placed", lambda x, k: same(x, k - 1) | same(x, k + 1))
    out = out.withColumn("starts", F.when(F.col("placed").isNotNull(), F.array_sort(F.transform(repeated, lambda x: x["i"])))).drop("placed")

    def cover(state: Column, i: Column) -> Column:
        return F.struct((i + F.lit(WINDOW)).alias("end"), (state["n"] + i + F.lit(WINDOW) - F.greatest(i, state["end"])).alias("n"))

    covered = F.aggregate("starts", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), cover)["n"]
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _features(buckets: int) -> Column:
    """Bucket of each word (even) and of each pair of neighbours (odd)."""
    half = F.lit(buckets // 2)
    one = F.transform("words", lambda w: (F.pmod(F.xxhash64(w), half) * 2).cast("int"))
    pair = F.zip_with(F.expr("slice(words, 1, greatest(size(words) - 1, 0))"), F.expr("slice(words, 2, greatest(size(words) - 1, 0))"), lambda a, b: (F.pmod(F.xxhash64(a, b), half) * 2 + 1).cast("int"))
    return F.concat(one, pair)


def trusted_ids(labels: DataFrame, limit: int | None = None) -> DataFrame:
    """Ids of good, harmless documents: all, or up to ``limit`` in the order of a hash of the id."""
    good = labels.filter("quality = 1 and toxic = 0").select(F.col("doc_id").alias("trusted")).filter(F.col("trusted").isNotNull()).distinct()
    return good if limit is None else good.orderBy(F.xxhash64("trusted"), "trusted").limit(limit)


def _quantile(scores: DataFrame, quantile: float) -> float | None:
    """The exact quantile of column ``score``, interpolated like ``percentile``; only one or two bins send their values."""
    place = F.floor(F.col("score") / BIN)
    bins = sorted((r["bin"], r["n"]) for r in scores.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect())
    if not bins:
        return None
    at = quantile * (sum(n for _, n in bins) - 1)
    low, high = math.floor(at), math.ceil(at)
    found, run = {}, 0
    for b, n in bins:
        ranks = [k for k in {low, high} if run <= k < run + n]
        if ranks:
            seen = run
            for r in scores.filter(place == b).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy("score").collect():
                found |= {k: r["score"] for k in ranks if seen <= k < seen + r["n"]}
                seen += r["n"]
        run += n
    return found[low] if low == high else (high - at) * found[low] + (at - low) * found[high]


def quality_rules(
    docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, trusted_limit: int = 20_000, quantile: float = 0.005, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score``.

    ``kept`` is false if the base rules fail or the score, the mean log ratio of the document's features, is below the
    ``quantile`` of the scores of all trusted documents. The target is fitted to at most ``trusted_limit`` labelled rows (so
    their ids can be broadcast); the corpus counts cover every document. A null text has no words and fails. Without any
    trusted document only the base rules decide. Repeated rows each get a row; other columns are not read.
    The table of ratios has ``buckets`` entries, whatever the corpus.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ids = trusted_ids(labels, trusted_limit)
    featured = slim.select("id", _words(F.col("text")).alias("words"))
    flagged = featured.join(F.broadcast(ids), featured["id"] == ids["trusted"], "left").select(F.col("trusted").isNotNull().alias("good"), F.explode(_features(buckets)).alias("bucket"))
    counts = flagged.groupBy("bucket").agg(F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("target"), F.count(F.lit(1)).alias("raw"))
    target, raw = [0] * buckets, [0] * buckets
    for r in counts.collect():  # at most ``buckets`` rows
        target[r["bucket"]], raw[r["bucket"]] = r["target"], r["raw"]
    if sum(target):
        # ln((t + s) / (T + s M)) - ln((r + s) / (R + s M)), evaluated in SQL so that no two engines round apart
        table = spark.createDataFrame(list(zip(range(buckets), target, raw)), "bucket int, target long, raw long")
        t, r = sum(target) + 0.5 * buckets, sum(raw) + 0.5 * buckets
        ratio = F.round(F.ln((F.col("target") + 0.5) / F.lit(t)) - F.ln((F.col("raw") + 0.5) / F.lit(r)), 6)
        values = [x["v"] for x in table.select("bucket", ratio.alias("v")).orderBy("bucket").collect()]
    else:
        values = [0.0] * buckets
    ratios = F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")
    total = F.aggregate("features", F.lit(0.0), lambda s, b: s + F.element_at(ratios, b + 1))
    score = F.round(total / F.greatest(F.size("features"), F.lit(1)), 6)
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = base_counts(slim, F.col("text")).drop("text").withColumn("features", _features(buckets)).withColumn("score", score)
    out = stash(out.select("id", *counted, "score"), "rules")
    every = trusted_ids(labels)
    least = _quantile(stash(out.join(every, out["id"] == every["trusted"], "left_semi").select("score"), "scores"), quantile)
    fine = F.lit(True) if least is None else F.col("score") >= F.lit(least)
    return out.select(F.col("id").alias(id_col), *counted, (~F.col("base_failed") & fine).alias("kept"), "score")
