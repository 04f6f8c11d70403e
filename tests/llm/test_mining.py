"""Ranked search, hard negatives and sum-of-squares packing against brute force."""

import collections
import functools
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crosspanel.llm import best_fit, ranked_search
from crosspanel.llm.hard_negatives import mine, product

VECTORS = "vec_id long, embedding array<float>, label int, score long, block string, grp string"
rng = np.random.default_rng(11)


def hard(rows, every=100, width=3):
    """Brute force over (id, vector, label) in Python integers."""
    x = [(i, v, lab, k) for k, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    whole = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v, _, _ in x]
    last = lambda i: (i is None, i or 0)
    out = collections.Counter()
    for a, (i, _, lab, k) in enumerate(x):
        if i is None or i % every:
            continue
        score = [sum(p * q for p, q in zip(whole[a], w)) for w in whole]
        order = sorted(range(len(x)), key=lambda j: (-score[j], last(x[j][0]), x[j][3]))
        for p in [j for j in order if j != a and x[j][2] == lab][:5]:
            near = [j for j in order if x[j][2] != lab and 80 * score[p] <= 100 * score[j] <= 100 * score[p]][:5]
            for rank, j in enumerate(near, 1):
                out[i, x[p][0], rank, x[j][0], score[p], score[j]] += 1
    return out


def vector_rows():
    rows = []
    for i in range(400):
        v = rng.normal(0, 0.3, 40).round(1).tolist()  # coarse steps make ties
        rows.append((i, v, int(rng.integers(0, 4)) if i % 3 else 1))  # a third of all rows and more have one label
    rows += [(100, rows[3][1], 1), (200, rows[200][1], 2), (None, rows[100][1], 2), (None, rows[100][1], 1), (401, None, 1), (402, [1.0] * 40, None), (403, [float("nan")] + [0.0] * 39, 1)]
    rows += [(404, [None] + [0.5] * 39, 1), (405, [float("inf")] * 40, 2), (406, [], 1), (407, [0.5] * 10, 2), (500, [0.25] * 40, 3), (600, [0.0] * 40, 1)]
    return rows + [(700 + i, rows[100][1], 1 + i % 2) for i in range(60)]  # copies of an anchor


def test_hard_negatives(spark, monkeypatch):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], VECTORS).repartition(3)
    for size in (1024, 16):
        monkeypatch.setattr("crosspanel.llm.hard_negatives.ROWS", size)
        monkeypatch.setattr("crosspanel.llm.hard_negatives.ANCHORS", 2 if size == 16 else 256)
        monkeypatch.setattr("crosspanel.llm.hard_negatives.CELL", 2)
        got = collections.Counter(map(tuple, mine(df).collect()))
        want = hard(rows)
        # rows that share an id and a score may stand for each other, ids and scores may not
        assert got == want and len(got) > 100


def test_hard_negatives_of_huge_components(spark):
    """Sums of components beyond the stated limit don't overflow; below it they are exact beyond 53 bits."""
    big = float(2**20)
    rows = [(0, [big, 1.0], 1), (1, [big, 2.0], 1), (2, [big, 1.5], 2), (3, [3e38, -3e38], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {tuple(r) for r in mine(df).collect()}
    assert (0, 1, 1, 2, 2**56 + 256 * 512, 2**56 + 256 * 384) in got


def test_product_is_exact():
    a, b = rng.integers(-(1 << 30), 1 << 30, (5, 7)), rng.integers(-(1 << 30), 1 << 30, (4, 7))
    assert (product(a, b) == np.array([[sum(int(p) * int(q) for p, q in zip(x, y)) for y in b] for x in a])).all()


@pytest.mark.parametrize("rows", [[], [(1, [0.5], 1)], [(100, [0.5], 1)], [(100, [], 1), (1, [], 1), (2, [], 2)]])
def test_hard_negatives_of_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert collections.Counter(map(tuple, mine(df).collect())) == hard(rows)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, queries, most=10):
    """Brute force: every document's score for every query."""
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    filled = [(i, c) for i, c in counts if c]
    n, total = len(filled), sum(sum(c.values()) for _, c in filled)
    df = collections.Counter(t for _, c in filled for t in c)
    out = collections.Counter()
    for q, text in queries:
        scored = []
        for i, c in filled:
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        for k, (s, _, _, i) in enumerate(sorted(scored)[:most], 1):
            out[q, k, i, -s] += 1
    return out


def search_rows():
    words = ["w%d" % int(x) for x in rng.zipf(1.3, 20000) if x < 3000]
    text = lambda n: " ".join(rng.choice(words, n))
    passage = text(30)
    docs = [(int(i), text(int(rng.integers(1, 120)))) for i in rng.permutation(900)]
    docs += [(1000 + i, passage) for i in range(150)] + [(2000 + i, text(5) + " " + passage) for i in range(40)]  # copies: equal scores over many ranges
    docs += [(None, passage), (None, passage), (1000, passage), (3000, None), (3001, ""), (3002, "!? \n"), (3003, text(60000)), (3004, "Äpfel ÄPFEL äpfel Über-Äpfel"), (3005, "CamelCase x9 X9")]
    queries = [(i, text(int(rng.integers(1, 40)))) for i in range(25)] + [(100, passage), (100, passage), (101, passage.upper().replace(" ", "--")), (None, "w1 w2"), (102, None), (103, "?"), (104, "Äpfel x9"), (105, "unseen"), (106, " ".join(words))]
    return docs, queries


@pytest.mark.parametrize("shard,fan,group", [(8192, 32, 100_000), (50, 4, 60), (1, 4, 100_000), (33, 32, 1000)])
def test_ranked_search(spark, monkeypatch, shard, fan, group):
    for name, value in (("SHARD", shard), ("FAN", fan), ("TERMS", group)):
        monkeypatch.setattr(ranked_search, name, value)
    docs, queries = search_rows()
    if shard == 1:
        docs, queries = docs[:300] + docs[-20:], queries[:6] + queries[25:29]
    if group == 60:
        queries = [q for q in queries if q[0] != 106]
    a = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, rid string, score int").repartition(3)
    b = spark.createDataFrame([(*q, "x") for q in queries], "item_id long, text string, rank string")
    got = collections.Counter(map(tuple, ranked_search.rank(a, b).collect()))
    assert got == ranked(docs, queries) and len(got) > 50


def test_search_opens_few_ranges():
    """The bound cuts: a query of rare words opens a small part of the tree, and copies of equal score don't open it all."""
    n = 8192
    doc = np.concatenate([np.arange(n), np.arange(0, n, 500)])
    value = np.concatenate([np.full(n, 5), np.arange(900, 900 + len(range(0, n, 500)))])
    trees = ranked_search.Trees(np.array([0, n, len(doc)]), doc, value, n)
    top = []
    opened = trees.search(np.array([0, 1]), np.array([1, 100]), list(range(n)), top, 10)
    assert [x[2] for x in top] == list(range(8000, 3000, -500)) and opened < 60
    top = []
    assert trees.search(np.array([0]), np.array([1]), list(range(n)), top, 10) <= 5 and [x[2] for x in top] == list(range(10))


def test_ranked_search_of_empty_tables(spark):
    a = spark.createDataFrame([(1, "one two")], "doc_id int, text string")
    b = spark.createDataFrame([(1, "two")], "item_id int, text string")
    assert ranked_search.rank(a, b.limit(0)).collect() == [] and ranked_search.rank(a.limit(0), b).collect() == []
    assert [tuple(r)[:3] for r in ranked_search.rank(a, b).collect()] == [(1, 1, 1)]
    assert ranked_search.rank(a, b).schema.names == ranked_search.rank(a, b.limit(0)).schema.names


WORD_BPE = P.path("word_bpe_49k.json")
ODD_TEXTS = ["", " \n\t", "It's I'll we're <|endoftext|> <|startoftext|>x", "a<|endoftext|>b", "Ünïcode ÇA ǅ ΣΑΣ İstanbul ﬁ ½ ١٢٣ 漢字かな 🙂🙂 é a ́b", "x y z\x85w\x1cv", "line\r\nline\x0b\x0cline", "1234567 a1b2 '''s's", "̈́  q Å`"]


@functools.cache
def _library():
    return Tokenizer.from_file(WORD_BPE)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet=st.sampled_from("abcxyzABCÀÖØÞßàöøÿĀĿŒſıİ×÷ªº'sdmrevl09.,-<|>_\x1c\x00 "), max_size=40), st.lists(st.sampled_from([*ODD_TEXTS, "'", "s", " ", "\n", "́"]), max_size=8).map("".join)))
def test_word_ids_equal_the_library(text):
    library = _library()
    assert np.frombuffer(best_fit.token_ids(WORD_BPE, text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_word_ids_of_texts_with_white_space_of_all_kinds():
    library = _library()
    latin = "".join(map(chr, [*range(1, 0x180)]))
    for text in [latin, " ".join(latin), latin[::-1], *ODD_TEXTS, "\n".join(ODD_TEXTS), "word " * 20000, "w" * 5000]:
        assert np.frombuffer(best_fit.token_ids(WORD_BPE, text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60))
def test_sum_of_squares_rule(sizes):
    """Each step against all choices, sums counted anew; bins hold what they can, places have no gaps."""
    capacity = 12
    where, place = best_fit.sum_of_squares(np.array(sizes, np.int64), capacity)
    used = collections.defaultdict(int)
    for s, w, p in zip(sizes, where, place):
        squares = lambda level: sum(n * n for g, n in collections.Counter(capacity - u for u in level.values()).items() if g)
        choices = [squares({**used, b: used[b] + s}) for b in list(used) if used[b] + s <= capacity] + [squares({**used, "new": s})]
        assert p == used[w] and p + s <= capacity
        used[w] += s
        assert squares(used) == min(choices)


def test_best_fit(spark, monkeypatch):
    library = _library()
    texts = [(i, " ".join(rng.choice(["alpha", "beta9", "Gamma's", "delta", "epsilon"], int(n)))) for i, n in enumerate(rng.integers(0, 700, 260))]
    texts += [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(2000, None), (None, "null id"), (None, "null id"), (3, texts[3][1]), (3000, "long one " * 6000)]
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in texts]
    want = collections.Counter((i, k, k * 2048, len(x[k * 2048 :][:2048]), zlib.crc32(np.array(x[k * 2048 :][:2048], "<u4").tobytes())) for i, x in ids for k in range(-(-len(x) // 2048)))
    docs = spark.createDataFrame([(*t, "x", 5) for t in texts], "doc_id long, text string, length string, shard int").repartition(3)
    least = -(-sum(len(x) for _, x in ids) // 2048)
    for shard in (65_536, 60):
        monkeypatch.setattr(best_fit, "SHARD", shard)
        got = best_fit.best_fit(docs, WORD_BPE).collect()
        assert collections.Counter(tuple(r)[:5] for r in got) == want
        bins = collections.defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for b in bins.values():
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n
            assert at <= 2048
        assert len(bins) <= least + (8 if shard > 60 else 30)
    assert best_fit.best_fit(docs.limit(0), WORD_BPE).collect() == []


def test_best_fit_leaves_little():
    """Over lengths like those of documents, about as few bins as the sum needs."""
    sizes = np.clip(rng.lognormal(6, 1, 60_000).astype(np.int64), 1, 2047)
    x = sizes[best_fit.order(sizes, rng.integers(0, 1 << 62, len(sizes)))]
    where, _ = best_fit.sum_of_squares(x, 2048)
    assert where.max() + 1 <= -(-sizes.sum() // 2048) * 1.003
