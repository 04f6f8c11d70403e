"""The training-data operators against brute force, on small fixtures with nulls, ties, repeats and clashing columns."""

import collections
import functools
import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crosspanel.llm import quality_lm
from crosspanel.llm.common import squeeze
from crosspanel.llm.exact_dedup import exact_dedup, golomb_decode, golomb_encode
from crosspanel.llm.html_text import extract_text, main_text
from crosspanel.llm.mixing import fill, mix
from crosspanel.llm.packing import column_generation, encode, encoding, pack
from crosspanel.llm.quality_lm import quality_verdicts
from crosspanel.llm.quality_rules import quality_rules
from crosspanel.llm.sharding import shard_rows
from crosspanel.llm.simhash import simhash_dedup
from crosspanel.llm.substring_words import substring_dedup
from crosspanel.llm.suffix_array import shared_windows, suffix_dedup

TOKENIZER = P.path("byte_bpe_50k.json")
rng = np.random.default_rng(7)
WORDS = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(WORDS, n))


@functools.cache
def fixture():
    shared, base = prose(60), prose(120)
    texts = [None, "", " \n", "one", base, base, base + " more", " " + base.replace(" ", "  "), prose(30) + " " + shared + " " + prose(20), shared + " " + prose(50), "ab " * 300, prose(3000), "ÄÖ ü " * 40]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, i) for i, t in enumerate(texts)]
    return [*rows, (4, base, "en", "s1", 4), (None, base, "en", "s1", 4), (None, "alone", None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns with the names that operators use themselves
    from pyspark.sql import functions as F

    return spark.createDataFrame(fixture(), SCHEMA).withColumns({c: F.lit("x") for c in ("id", "print", "size", "spans", "key", "words", "bucket", "keep_id")}).repartition(3)


def test_golomb_of_an_owners_range():
    """The last of a thousand owners' codes takes no more bits a value than the first one's."""
    step = (1 << 64) // 1000 + 1
    draw = np.sort(rng.integers(0, step // 2, 2000).astype(np.uint64))
    for base in (0, 999 * step):
        v = np.unique(draw + np.uint64(base))
        assert (golomb_decode(golomb_encode(v)) == v).all() and len(golomb_encode(v)) == len(golomb_encode(np.unique(draw)))
    for v in ([5], [0], [(1 << 64) - 1], [0, (1 << 64) - 1], [7, 8, 9]):
        assert golomb_decode(golomb_encode(np.array(v, np.uint64))).tolist() == v


def test_golomb():
    for n in (0, 1, 1000):
        v = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        assert (golomb_decode(golomb_encode(v)) == v).all()


def test_exact(docs):
    groups = collections.defaultdict(list)
    for i, t, *_ in fixture():
        groups[squeeze((t or "").encode())].append((-len(t or ""), i is None, i or 0, i))
    got = exact_dedup(docs).collect()
    assert len(got) == len(fixture())
    by = {hashlib.sha256(k).hexdigest(): (min(v)[3], len(v)) for k, v in groups.items()}
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert all((r["keep_id"], r["group_size"]) == by[r["text_sha256"]] for r in got) and kept == {k: 1 for k in by}


def test_simhash(docs):
    def fp(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {fp(t) for _, t, *_ in fixture()}
    part = {p: p for p in prints}
    for _ in prints:
        for a in prints:
            part[a] = min(part[b] for b in prints if bin(a ^ b).count("1") <= 3)
    least = collections.defaultdict(list)
    for i, t, *_ in fixture():
        least[part[fp(t)]] += [] if i is None else [i]
    want = collections.Counter((i, f"{fp(t):016x}", min(least[part[fp(t)]], default=None)) for i, t, *_ in fixture())
    assert collections.Counter(map(tuple, simhash_dedup(docs).collect())) == want


def _covered(seqs, w):
    count = collections.Counter(tuple(s[i : i + w]) for s in seqs for i in range(len(s) - w + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - w + 1):
            if count[tuple(s[i : i + w])] > 1:
                gone[i : i + w] = [True] * w
        out.append(gone)
    return out


def test_substring_words(docs):
    seqs = [(t or "").encode().split() for _, t, *_ in fixture()]
    want = collections.Counter((f[0], len(s), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(s, g) if not x)).hexdigest()) for f, s, g in zip(fixture(), seqs, _covered(seqs, 35)))
    assert collections.Counter(map(tuple, substring_dedup(docs).collect())) == want


def test_suffix_bytes(docs):
    seqs = [(t or "").encode() for _, t, *_ in fixture()]
    want = collections.Counter()
    for f, s, g in zip(fixture(), seqs, _covered(seqs, 200)):
        spans = sum(x and (i == 0 or not g[i - 1]) for i, x in enumerate(g))
        want[f[0], len(s), sum(g), spans, hashlib.sha256(bytes(b for b, x in zip(s, g) if not x)).hexdigest()] += 1
    assert collections.Counter(map(tuple, suffix_dedup(docs).collect())) == want


def _crowd():
    """Documents around one phrase in ever other company, some of them copies, and null ids with one text."""
    phrase, rows = prose(30), []
    for i in range(120):
        rows.append((i, f"{prose(int(rng.integers(5, 40)))} {phrase} {prose(int(rng.integers(5, 40)))}"))
    rows += [(200 + i, rows[i][1]) for i in range(0, 120, 9)] + [(None, rows[5][1])] * 30 + [(300, None), (301, "")]
    return rows


def test_substring_words_of_cut_keys(spark):
    """Minimizers with more rows than a task may hold have their windows dealt out once more: results stay."""
    rows = _crowd()
    seqs = [(t or "").encode().split() for _, t in rows]
    want = collections.Counter((r[0], len(s), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(s, g) if not x)).hexdigest()) for r, s, g in zip(rows, seqs, _covered(seqs, 35)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (1, 40, None):
        assert collections.Counter(map(tuple, substring_dedup(docs, most=most).collect())) == want


@pytest.mark.parametrize("bounds", [{}, {"room": 2_000}, {"most_runs": 5, "most_parts": 4, "room": 1_500}, {"hot": True}])
def test_suffix_bytes_of_split_shards(spark, monkeypatch, bounds):
    """One minimizer in ever other company: shards split, keys cut, and minimizers taken as very frequent."""
    from crosspanel.llm import suffix_array

    rows = [(i, None if t is None else t.replace(" ", "-")) for i, t in _crowd()]
    seqs = [(t or "").encode() for _, t in rows]
    want = collections.Counter()
    for (i, _), s, g in zip(rows, seqs, _covered(seqs, 120)):
        spans = sum(x and (k == 0 or not g[k - 1]) for k, x in enumerate(g))
        want[i, len(s), sum(g), spans, hashlib.sha256(bytes(b for b, x in zip(s, g) if not x)).hexdigest()] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if bounds.pop("hot", False):
        monkeypatch.setattr(suffix_array, "SAMPLE", 1)
        monkeypatch.setattr(suffix_array, "HOT_ROWS", 3)
        slim = docs.selectExpr("doc_id as id", "xxhash64(text) as print", "text")
        assert len(suffix_array.hot_keys(slim, 120, 60)) > 5
    assert collections.Counter(map(tuple, suffix_dedup(docs, window=120, gram=60, **bounds).collect())) == want


def test_repeated_rows_over_cuts():
    import pyarrow as pa
    from crosspanel.llm.repeats import repeated_rows

    for _ in range(50):
        pairs = sorted((int(rng.integers(0, 3)), int(rng.integers(0, 12))) for _ in range(60))
        batches = [pa.RecordBatch.from_pydict({"key": [k for k, _ in pairs[i : i + 7]], "proof": [p for _, p in pairs[i : i + 7]]}) for i in range(0, 60, 7)]
        got = [(k, p, bool(x)) for t, flags in repeated_rows(iter(batches), 5, 9) for k, p, x in zip(t.column("key").to_pylist(), t.column("proof").to_pylist(), flags)]
        count = collections.Counter(pairs)
        assert sorted(got) == sorted((k, p, count[k, p] > 1) for k, p in pairs)


def test_seen_counts_to_two():
    from crosspanel.llm.repeats import Seen

    seen, count = Seen(), collections.Counter()
    for _ in range(20):
        a, b = rng.integers(0, 4, 30).astype(np.uint64), np.zeros(30, np.uint64)
        sent = seen.keep(a, b)
        for x in a[sent].tolist():
            count[x] += 1
    assert set(count.values()) == {2}
    assert seen.keep(np.array([1], np.uint64), np.array([9], np.uint64)).all()  # another second half: not the same run


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(min_size=8, max_size=40).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=8))
def test_suffix_array(parts):
    hits = shared_windows(parts, np.array([len(p) - 7 for p in parts]), 8)
    count = collections.Counter(p[i : i + 8] for p in parts for i in range(len(p) - 7))
    assert [h.tolist() for h in hits] == [[count[p[i : i + 8]] > 1 for i in range(len(p) - 7)] for p in parts]


def test_mix(docs):
    rows = mix(docs).collect()
    assert len(rows) == len(fixture()) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix(docs.repartition(5)).collect()), key=str)
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.02, abs=4)
    assert fill([100, 1], [1, 5], 3) == [98.0, 3.0]


def test_shards(docs):
    rows = shard_rows(docs).collect()
    assert len(rows) == len(fixture())
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 40) for r in rows)
    text = {(f[0], len((f[1] or "").encode()) + 16, zlib.crc32((f[1] or "").encode())) for f in fixture()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == text


def test_shards_grow_little(spark):
    rows = shard_rows(spark.range(4000).selectExpr("id as doc_id", "'t' as text")).collect()
    assert 50 < sum(r["shard"] != r["grown_shard"] for r in rows) < 150


def test_rules(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in (4, 8, 9, 11)], "doc_id long, quality int, toxic int")
    got = collections.Counter(tuple(r)[:7] for r in quality_rules(docs, labels).collect())
    want = collections.Counter()
    for i, t, *_ in fixture():
        t = t or ""
        w = [x.decode() for x in t.encode().split()]
        lines = [x for x in t.split("\n") if x.encode().split()]
        g = _covered([w], 8)[0]
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(g), len(w) < 20 or 100 * sum(g) > 30 * len(w)] += 1
    assert got == want


def test_language_model(spark, docs):
    good = [(i, prose(60), "en", "s", 1) for i in range(100, 180)]
    bad = [(i, " ".join(f"{w.upper()}%%%" for w in prose(60).split()), "en", "s", 1) for i in range(200, 220)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100, 180)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r["kept"] for r in quality_verdicts(spark.createDataFrame(good + bad, SCHEMA), labels, TOKENIZER).collect()}
    assert sum(rows[i] for i in range(100, 180)) >= 78 and not any(rows[i] for i in range(200, 220))
    odd = quality_verdicts(docs, labels, TOKENIZER).collect()
    assert len(odd) == len(fixture()) and not any(r["kept"] for r in odd if r["n_tokens"] == 0)


def test_tokens_equal_the_library():
    t, e = Tokenizer.from_file(TOKENIZER), encoding(TOKENIZER)
    for x in [prose(50), "it's  2 spaces\n\n\ttab <|endoftext|> ÄÖß 漢字 🙂", "", "a" * 3000, *(f[1] or "" for f in fixture())]:
        assert t.encode(x, add_special_tokens=False).ids == encode(e, x, special=True).tolist()


@pytest.mark.parametrize("unit, n", [(" ", 2_000_000), ("\n", 1_100_000), ("\t ", 150_000), ("\u3000", 150_000), ("x", 200_000)])
def test_tokens_of_very_long_runs(unit, n):
    """Long runs of one kind, at the end and beside words, lines and special tokens."""
    t, e = Tokenizer.from_file(TOKENIZER), encoding(TOKENIZER)
    run = unit * (n // len(unit))
    short = run[:110_000]
    for x in (f"word{run}", f"{short}word {short}!\n{short}a <|endoftext|>{short}<|endoftext|>{short} b"):
        assert t.encode(x, add_special_tokens=False).ids == encode(e, x, special=True).tolist()


def test_very_long_white_space(spark):
    """Packing and the language model take texts with over a million white-space characters in a row."""
    texts = [" " * 1_200_000, "one two" + "\n" * 1_100_000 + "three " * 30, None]
    rows = [(i, x, "en") for i, x in enumerate(texts)] + [(i, "three one two " * 9, "en") for i in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    t = Tokenizer.from_file(TOKENIZER)
    total = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x, _ in rows}
    got = pack(docs, TOKENIZER).select("doc_id", "length").collect()
    sums = collections.Counter()
    for r in got:
        sums[r["doc_id"]] += r["length"]
    assert sums == total
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10, 30)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["n_tokens"] + 1 for r in quality_verdicts(docs, labels, TOKENIZER).collect()} == total


def test_pack(docs):
    rows = pack(docs, TOKENIZER).collect()
    t = Tokenizer.from_file(TOKENIZER)
    want = sum(len(t.encode(f[1] or "", add_special_tokens=False).ids) + 1 for f in fixture())
    assert sum(r["length"] for r in rows) == want
    ids = np.array(t.encode(fixture()[11][1], add_special_tokens=False).ids + [0], "<u4")
    own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 11)
    assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n, _ in own] == [c for *_, c in own] and sum(n for _, n, _ in own) == len(ids)
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_column_generation_is_tight():
    counts = rng.integers(0, 40, 64)
    plan = column_generation(counts, 256)
    assert (sum(p * n for p, n in plan) == counts).all() and all((p * np.arange(1, 65)).sum() <= 256 for p, _ in plan)
    assert sum(n for _, n in plan) <= 1.03 * (counts * np.arange(1, 65)).sum() / 256 + 2


PAGE = """<html><head><title>No</title><style>p{}</style><script>var x = "</p><p>no</p>";</script></head><body><nav><ul><li><a href=/>no</a></li></ul></nav>
<div class="ad banner">no</div><header>no</header><article><h1>Head &amp; line</h1><p>First
 part<br>of it.<p><b>Second</b> part<form><input>no</form><div class="comments"><p>no</p></div><aside>no</aside></article><footer>no</footer>"""


def test_html(spark):
    assert main_text(PAGE) == "Head & line\nFirst part of it.\nSecond part"
    long = "A sentence of some length that is the text of the page, without an article. " * 3
    assert main_text(f"<div id=menu><a href=1>no</a></div><div><p>{long}</p><p>{long}</p></div><p><a href=2>no</a>") == "\n".join([long.strip()] * 2)
    for broken in ("", "<", "<p", "<script>", "<!--", "<p>x</p", "&am", "<nav><p>x", '<a href="'):
        main_text(broken)
    rows = extract_text(spark.createDataFrame([(1, "u", PAGE), (None, None, None), (2, "v", "")], "page_id long, url string, html string")).collect()
    assert [r["n_chars"] for r in sorted(rows, key=lambda r: r["page_id"] or 0)] == [0, len(main_text(PAGE)), 0]


ARTICLE = "<article><h1>Title of it all</h1><p>" + "Long text here. " * 20 + "</p><p>Short.</p></article>"
WANT = "Title of it all\n" + ("Long text here. " * 20).strip() + "\nShort."


@pytest.mark.parametrize("page", [
    f'<div class="content no-sidebar">{ARTICLE}</div>', ARTICLE.replace("<h1>", '<div class="entry has-comments"><h1>').replace("</article>", "</div></article>"), ARTICLE.replace("<h1>", '<p class="share">Tweet<h1>'),
    f'<ul><li class="social">Tweet</ul>{ARTICLE}', f"<form><div>{ARTICLE}</div></form>", f'<div class="page has-sidebar">{ARTICLE}<div class="left-sidebar">no<p>no</div></div>', f'<section class="comments"><article class="comment-body">no</article></section>{ARTICLE}',
    f"<p>Teaser of something else.</p>{ARTICLE}<p>Another one.", f"<header><h1>Site</h1></header>{ARTICLE.replace('<h1>', '<header><h1>').replace('</h1>', '</h1></header>')}",
])
def test_html_keeps_the_article_whole(page):
    assert main_text(page) == WANT


def test_html_without_an_article():
    verse = [f"line {i} of verse" for i in range(9)]
    assert main_text("".join(f"<p>{x}</p>" for x in verse)) == "\n".join(verse)
    assert main_text("<ul>" + "<li><a href=x>menu item</a>" * 6 + "</ul><p>" + "Story. " * 40 + "<p>End.<ul>" + "<li><a href=x>more</a>" * 6 + "</ul>") == ("Story. " * 40).strip() + "\nEnd."
    assert main_text("<form><p>only a form holds the text</p></form>") == "only a form holds the text"


def test_html_generated_pages():
    """Pages put together from known articles and known rest: the article comes back, whatever is around it."""
    for _ in range(200):
        body = [prose(int(rng.integers(1, 60))) for _ in range(rng.integers(2, 8))] + [prose(80)]
        rng.shuffle(body)
        body = [prose(12), *body]
        rest = ["<nav><ul><li><a href=/>x</a></ul></nav>", f"<div class='ad'>{prose(40)}</div>", f"<aside><p>{prose(30)}</aside>", f'<section id="comments"><p>{prose(50)}<p>{prose(9)}</section>', "<script>if (a < b) c();</script>", f"<form><input>{prose(5)}</form>", f"<p>{prose(4)}</p>"]
        before, after = (list(rng.choice(rest, rng.integers(0, 5))) for _ in range(2))
        inner = "".join(f"<p>{p.replace(' ', chr(10), 1)}" + ("</p>" if rng.random() < 0.5 else "") + (rest[int(rng.integers(0, 6))] if rng.random() < 0.2 else "") for p in body[1:])
        shell = rng.choice(["%s", "<div class=content><div>%s</div></div>", "<main>%s</main>", "<body class='has-sidebar'>%s"])
        page = shell % ("".join(before) + f"<article><h1>{body[0]}</h1>{inner}</article>" + "".join(after) + f"<footer>{prose(20)}</footer>")
        assert main_text(page) == "\n".join(body)


SENTENCES = "A sentence of some length that is the text of the page. " * 4
STORY = f"<h1>Title</h1><p>{SENTENCES}</p>%s<p>Short end.</p>"
STORY_TEXT = f"Title\n{SENTENCES.strip()}\nShort end."


@pytest.mark.parametrize("beside", [
    '<ol class="commentlist"><li>Nice post, I agree with all of it and more.</ol>', '<div class="comment-thread"><p>said a reader</div>', '<div class="user-comments">x</div>', '<section id="reader-comments"><article><p>no</article></section>', '<div class="CommentList">x</div>',
    '<div class="related-posts"><p>Another story</div>', '<div class="related-articles">x</div>', '<div class="gdpr-banner">We care</div>', '<ins class="adsbygoogle">Buy</ins>', '<div class="subscribe-now">Get mail</div>', "<ul><li><a>one<li><a>two<li><a>three<li><a>four</ul>", '<aside class="zq">x</aside>',
])
def test_html_leaves_out_what_stands_in_the_article(beside):
    assert main_text(f"<article>{STORY % beside}</article>") == STORY_TEXT
    assert main_text(f"<body><div>{STORY % beside}</div></body>") == STORY_TEXT


@pytest.mark.parametrize("page", [
    '<article><div class="entry share">%s</div></article>', '<body><div class="post widget">%s</div></body>', '<div class="main-content page-menu">%s</div>', "<body><div><a>Home</a> <a>News</a></div><div>%s</div><div><p>&copy; 2024 Site</p><p>Imprint</p></div></body>",
    "<article><p><a>Up</a></p>%s<p><a>Read</a> <a>on</a></p></article>", "<article><a>Teaser one here</a></article><div>%s</div><article><p>Teaser two</p></article>", "<body><ul><li><a>Home</a></li><li><a>News</a></li></ul>%s</body>", '<div id="comments"><article><p>' + SENTENCES * 3 + "</p></article></div><article>%s</article>",
    '<body class="has-sidebar comments-open"><main>%s<ul><li><a>a</a><li><a>b</a><li><a>c</a></ul></main></body>', "<div class=wrap><div><div>%s</div></div><div><div><p>About us</p><p>Contact</p></div></div></div>", '<div class="postContent noSidebar">%s</div><div class="site-footer"><p>x</p></div>',
])
def test_html_finds_the_story(page):
    assert main_text(page % (STORY % "")) == STORY_TEXT == main_text(page % (STORY.replace("Title", "<a href=/>Title</a>") % ""))
    assert main_text(page % (STORY.replace("<p>", "<div><p>").replace("</p>", "</p></div>") % "")) == STORY_TEXT


def test_html_without_names():
    """Pages of divs whose names say nothing: link bars, short boxes and a footer around the story go by their lengths and links alone."""
    for k in range(150):
        word = lambda: "".join(rng.choice(list("qxzvkj"), 5))
        bar = "<div class=%s>%s</div>" % (word(), " ".join(f"<a href=/{i}>{prose(1)}</a>" for i in range(int(rng.integers(2, 8)))))
        listed = "<ul class=%s>%s</ul>" % (word(), "".join(f"<li><a>{prose(2)}</a>" for _ in range(int(rng.integers(3, 8)))))
        small = f"<div id={word()}><p>{prose(2)}</p><p>{prose(1)}</p></div>"
        body = [prose(6), *(prose(int(rng.integers(2, 70))) for _ in range(int(rng.integers(1, 7)))), prose(90)]
        inner = "".join(f"<p>{x}</p>" if k % 3 else f"<div><p>{x}</p></div>" for x in body)
        before, after = ("".join(rng.choice([bar, listed, small], int(rng.integers(0, 4)))) for _ in range(2))
        page = f"<body>{before}<div class={word()}><div>{inner}</div></div>{after}<div class={word()}><p>&copy; {prose(2)}</p><p>{prose(2)}</p></div></body>"
        assert main_text(page) == "\n".join(body)


def test_html_of_a_very_long_page():
    """A million characters in one paragraph, then in a hundred thousand, inside and outside of an article."""
    one, many = "word " * 200_000, [f"line {i}" for i in range(100_000)]
    for shell in ("<article>%s</article>", "<div>%s</div>"):
        assert main_text(shell % f"<p>{one}</p>") == one.strip()
        assert main_text(shell % "".join(f"<p>{x}" for x in many)) == "\n".join(many)


def test_html_deep_nesting_is_linear():
    for page in ("<div>" * 100_000 + "x", "<b>" * 100_000 + "x", "<div class=ad><article>" * 30_000 + "x", "<ul><li>" * 50_000 + "x", "<p><span class=share>" * 50_000):
        main_text(page)


def test_html_rows(spark):
    """Null ids, repeated rows, extra columns with the operator's own names."""
    from pyspark.sql import functions as F

    rows = [(1, "u", ARTICLE), (1, "u", ARTICLE), (None, None, None), (2, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("id", "text", "n_chars")})
    got = collections.Counter(map(tuple, extract_text(pages).collect()))
    assert got == {(1, "u", WANT, len(WANT)): 2, (None, None, "", 0): 1, (2, None, "", 0): 1}
    assert extract_text(pages.filter("page_id = 5")).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (mix(none), simhash_dedup(none), suffix_dedup(none), exact_dedup(none), quality_rules(none, labels), shard_rows(none), substring_dedup(none), quality_verdicts(none, labels, TOKENIZER), pack(none, TOKENIZER)):
        assert out.count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as C

    rows = spark.createDataFrame(fixture(), SCHEMA)
    for stage in (C.exact, C.near, C.mixed):
        out = stage(spark, rows, "")
        assert out.columns == rows.columns
        rows = C.stash(out, "test")
    assert C.exact(spark, rows, "").count() <= rows.count()
    kept = C.exact(spark, spark.createDataFrame(fixture(), SCHEMA), "").collect()
    assert len(kept) == len({squeeze((f[1] or "").encode()) for f in fixture()})


def test_hot_keys_are_spread(spark):
    """A join whose hot keys are broadcast and whose others are shuffled has the rows of a plain one."""
    from crosspanel.llm.common import join_spread

    left = spark.createDataFrame([(i % 3 if i < 90 else i, i) for i in range(100)], "k int, v int")
    right = left.groupBy("k").count().selectExpr("k", "count as n", "k * 2 as w").filter("k <> 95")
    got = sorted(map(tuple, join_spread(left, right, "k", "n", 100, floor=5).collect()))
    assert got == sorted((k, v, 2 * k) for k, v in map(tuple, left.collect()) if k != 95)


@pytest.mark.parametrize("hub", [True, False])
def test_components(spark, hub):
    """A hub of 5,000 leaves, and a path, beside small parts: roots against union-find."""
    from crosspanel.llm.simhash import components

    pairs = [(7, 100 + i) for i in range(5_000)] if hub else [(100 + i, 101 + i) for i in range(300)]
    pairs += [(1, 2), (2, 3), (50, 3), (60, 61), (61, 60)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}


@pytest.mark.parametrize("crowd", [2_000, 12, 2])
def test_fingerprints_in_crowds(spark, monkeypatch, crowd):
    """Fingerprints that share a half and many bits of the other: dealt until no key is crowded, no pair within three bits is lost."""
    from crosspanel.llm import simhash

    monkeypatch.setattr(simhash, "CROWD", crowd)
    base = np.uint64(0x123456789ABCDEF0)
    low = [base ^ np.uint64(sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 6), replace=False))) for _ in range(120)]
    high = [base ^ np.uint64(sum(1 << int(b) for b in 40 + rng.choice(24, rng.integers(0, 5), replace=False))) for _ in range(80)]
    prints = sorted({int(x) for x in [*low, *high, *rng.integers(0, 1 << 63, 40, np.uint64)]})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.near_edges(spark.createDataFrame([(signed(x),) for x in prints], "print long").repartition(3)).collect()
    up = {x: x for x in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    want = {x: x for x in prints}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for b in prints[i + 1 :]:
                if bin(a ^ b).count("1") <= 3 and want[a] != want[b]:
                    want[a] = want[b] = min(want[a], want[b])
                    changed = True
    for r in edges:
        a, b = root(r["a"] & ((1 << 64) - 1)), root(r["b"] & ((1 << 64) - 1))
        up[max(a, b)] = min(a, b)
    assert {x: root(x) for x in prints} == want


CLASHES = ("_id", "_source", "_times", "_copy", "_sha", "_place", "_tokens", "_limit", "_kept", "_many", "id", "text_", "kept")


def _pipeline_docs():
    """Documents with repeated rows, copies, near copies, poor and empty texts, ties that differ in another column only."""
    rows = []
    for i in range(60):
        rows.append((i, prose(60), "en" if i % 2 else "de", f"s{i % 3}" if i % 7 else None, i))
    base = rows[5][1].split()
    rows += [(100, rows[3][1] + " ", "en", "s1", 1), (101, " ".join([*base[:-1], "other"]), "en", "s2", 2), (102, " ".join(f"{w.upper()}%%%" for w in base), "en", "s0", 3), (103, None, "en", None, 4), (104, " ", None, "s1", 5)]
    rows += [rows[8], (*rows[9][:4], 1), (*rows[9][:4], 2), (None, rows[10][1], "en", "s1", 6), (None, prose(50), "en", "s1", 7)]
    return rows


def test_pipeline_run(spark, tmp_path):
    """All five stages through run(), against a brute-force version of each on what the stage before it kept."""
    import corpus_pipeline as C
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(_pipeline_docs(), SCHEMA).withColumns({c: F.lit("x") for c in CLASHES})
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    row = lambda r: (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])
    now, seen = docs, {}
    for name, stage in C.STAGES[:-1]:
        now = C.stash(stage(spark, now, str(tmp_path)), "test")
        assert now.columns == docs.columns and now.filter("_kept <> 'x'").count() == 0
        seen[name] = [row(r) for r in now.collect()]
    again = spark.createDataFrame(seen["quality classifier"], SCHEMA)
    for name, stage in C.STAGES[1:3]:  # ties are broken alike, however rows are dealt out
        again = C.stash(stage(spark, again.repartition(5, F.rand(1)), str(tmp_path)), "test")
        assert collections.Counter(map(row, again.collect())) == collections.Counter(seen[name])
    good = collections.Counter((r["doc_id"], r["lang"], r["kept"]) for r in quality_verdicts(docs, labels, TOKENIZER).collect())
    assert collections.Counter((i, lang) for i, _, lang, _, _ in seen["quality classifier"]) == {(i, lang): n for (i, lang, kept), n in good.items() if kept}
    assert not {102, 103, 104} & {r[0] for r in seen["quality classifier"]}
    groups = collections.defaultdict(list)
    for r in seen["quality classifier"]:
        groups[squeeze(r[1].encode())].append(r)
    best = {k: min((-len(r[1]), r[0] is None, r[0] or 0) for r in v) for k, v in groups.items()}
    assert sorted((-len(r[1]), r[0] is None, r[0] or 0) for r in seen["exact dedup"]) == sorted(best.values())
    words = [(r, frozenset(zip(*(r[1].lower().split()[k:] for k in range(5))))) for r in seen["exact dedup"]]
    gone = {max(a[0], b[0]) for a, x in words for b, y in words if a[0] is not None and b[0] is not None and a[0] < b[0] and 5 * len(x & y) >= 4 * len(x | y)}
    assert gone == {101} and sorted(map(str, seen["near-dedup"])) == sorted(str(r) for r, _ in words if r[0] not in gone)
    taken = {(r["doc_id"], r["source"]): (r["taken"], r["size"]) for r in mix(spark.createDataFrame(seen["near-dedup"], SCHEMA)).collect() if r["doc_id"] is not None}
    times = collections.Counter((r[0], r[3]) for r in seen["mixing"] if r[0] is not None)
    assert times == {k: (2 * t + n) // (2 * n) for k, (t, n) in taken.items() if n and 2 * t >= n}
    packed = C.run(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter()
    for r in seen["mixing"]:
        want[r[0]] += len(t.encode(r[1], add_special_tokens=False).ids) + 1
    got = collections.Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as C

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_pipeline_near_copies(spark):
    """The near stage against all pairs of five-word shingle sets; op2's three bits leave most of these copies."""
    import corpus_pipeline as C

    texts = [(None, ""), (1, ""), (2, " \n"), (3, "one two"), (4, "One  two")]
    for n, edits in ((60, 4), (120, 1), (200, 2), (200, 9), (400, 3), (90, 4)):
        base = prose(n).split()
        for _ in range(4):
            own = list(base)
            for at in rng.choice(n, edits, replace=False):
                own[at] = "changed%d" % rng.integers(1000)
            texts.append((len(texts), " ".join(own)))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := t.lower().split()) else frozenset() for _, t in texts]
    part = list(range(len(texts)))
    pairs = [(a, b) for a in part for b in part if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    for _ in texts:
        for a, b in pairs:
            part[a] = part[b] = min(part[a], part[b])
    want = sorted(min(texts[b][0] for b in range(len(texts)) if part[b] == p and texts[b][0] is not None) for p in set(part))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], SCHEMA).repartition(3)
    assert len(pairs) > 12 and sorted(r["doc_id"] for r in C.near(spark, docs, "").collect()) == want


def test_language_model_reads_all_trusted(spark):
    """A phrase that only trusted documents beyond the 20,000th hold is known."""
    rows = [(i, f"{WORDS[i % 300]} {WORDS[i // 300 % 300]}") for i in range(26_000)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang")
    seen = []
    fit = quality_lm.fit
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality_lm, "fit", lambda texts, *a: (seen.append(texts.count()), fit(texts, *a))[1])
        quality_verdicts(docs, labels, TOKENIZER)
    held = labels.filter("pmod(xxhash64(doc_id), 5) = 0").count()
    assert seen == [26_000 - held] and seen[0] > 20_000


def kneser_ney(texts, order, vocabulary=50_257):
    """Interpolated modified Kneser-Ney by dictionaries: log probability of a token after its predecessors."""
    grams = collections.Counter()
    for t in texts:
        t = (None,) * (order - 1) + tuple(t)
        grams.update(t[i : i + order] for i in range(len(t) - order + 1))
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])

    def discount(k):
        n = [max(1, sum(c == i for c in counts[k].values())) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2])
        d = [min(i, max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)]
        return lambda c: d[min(c, 3) - 1]

    below = {k: discount(k) for k in counts}
    totals, masses = {}, {}
    for k, found in counts.items():
        for g, c in found.items():
            totals[k, g[:-1]] = totals.get((k, g[:-1]), 0) + c
            masses[k, g[:-1]] = masses.get((k, g[:-1]), 0) + below[k](c)

    def prob(g):
        k, context = len(g), g[:-1]
        lower = 1 / vocabulary if k == 1 else prob(g[1:])
        if (k, context) not in totals:
            return lower
        c = counts[k].get(g, 0)
        return ((c - below[k](c) if c else 0) + masses[k, context] * lower) / totals[k, context]

    return lambda t: [np.log(prob(((None,) * (order - 1) + tuple(t))[i : i + order])) for i in range(len(t))]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_perplexity_against_brute_force(spark, docs, order):
    """Every document's perplexity, and the limits and verdicts; sixteen shards and several pieces."""
    words = WORDS[:40]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 60))), "en" if i % 3 else None, "s", 1) for i in range(100, 160)] + fixture() + [(None, "x", "de", None, 1)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100, 150)] + [(150, 0, 0), (151, 1, 1)], "doc_id long, quality int, toxic int")
    held = {r[0] for r in labels.filter("quality = 1 and toxic = 0 and pmod(xxhash64(doc_id), 5) = 0").collect()}
    t = Tokenizer.from_file(TOKENIZER)
    ids = [t.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    model = kneser_ney([x for r, x in zip(rows, ids) if r[0] in range(100, 150) and r[0] not in held], order)
    scores = [-np.mean(model(x)) if x else None for x in ids]
    limits = quality_lm._limits([(r[2], int(np.floor(round(s, 6) / quality_lm.BIN)), 1) for r, s in zip(rows, scores) if r[0] in held], 0.99, 0.3)
    want = sorted(((r[0], r[2], len(x), s and np.exp(s), np.exp(limits.get((r[2], "lang"), limits[("all",)]))) for r, x, s in zip(rows, ids, scores)), key=str)
    every = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, quality_verdicts(every, labels, TOKENIZER, order=order).collect()), key=str)
    key = lambda r: (str(r[0]), r[2], r[3] or 0)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and (a[3] or 0, a[4]) == pytest.approx((b[3] or 0, b[4]), rel=2e-4) and a[5] == (b[3] is not None and a[3] <= a[4])


def test_keep_good_leaves_columns_alone(spark):
    """Input columns with the operator's own names, repeated rows and null languages come through as they are."""
    from pyspark.sql import functions as F

    rows = [(i, prose(40), None if i % 2 else "en") for i in range(60)]
    docs = spark.createDataFrame([*rows, rows[3], (None, None, None)], "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("_tokens", "_limit", "_kept", "id", "tokens", "kept", "text_", "lang_")})
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = quality_lm.keep_good(docs, labels, TOKENIZER)
    verdicts = collections.Counter(r["doc_id"] for r in quality_verdicts(docs, labels, TOKENIZER).collect() if r["kept"])
    assert got.columns == docs.columns and collections.Counter(r["doc_id"] for r in got.collect()) == verdicts and verdicts[3] == 2 and {r["_kept"] for r in got.collect()} == {"x"}


def test_rules_threshold_is_of_all_trusted(spark):
    """``kept`` against the quantile of all trusted scores, though the ratio is fitted to ten of them."""
    rows = [(i, prose(20 + i % 50)) for i in range(150)]
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), labels, trusted_limit=10, quantile=0.3).collect()
    least = np.quantile([r["score"] for r in got if r["doc_id"] < 120], 0.3)
    assert len(got) == 150 and all(r["kept"] == (not r["base_failed"] and r["score"] >= least - 1e-12) for r in got)


def test_near_text_of_crowds(spark, monkeypatch):
    """Crowds cut in blocks find the components of the whole groups: near copies, strangers among them, exact copies, empty texts."""
    from crosspanel.llm import near_text

    base = prose(80).split()
    texts = [None, "", "  "] + [" ".join(base)] * 5
    for i in range(60):  # near copies of one text
        own = list(base)
        own[int(rng.integers(80))] = f"near{i}"
        texts.append(" ".join(own))
    for i in range(40):  # they share half of their words with it, in threes also their own halves
        texts.append(" ".join(base[:40]) + " " + " ".join(f"far{i // 3}x{j}" for j in range(39)) + f" last{i}")
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) if t else frozenset() for t in texts]
    part = list(range(len(texts)))
    for _ in range(3):
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    monkeypatch.setattr(near_text, "CROWD", 7)
    calls = {}
    for name in ("_by_rare_shingles", "_against_all"):
        run = getattr(near_text, name)
        monkeypatch.setattr(near_text, name, lambda *a, run=run, name=name: calls.setdefault(name, run(*a)))
    # bands that all agree make one crowd of everything, so that strangers stand beside a hub
    monkeypatch.setattr(near_text, "bands", lambda found: np.arange(25, dtype=np.uint64))
    for blocks, way in ((20, "_against_all"), (2, "_by_rare_shingles")):  # strangers meet all blocks, or rare shingles are told apart first
        monkeypatch.setattr(near_text, "BLOCKS", blocks)
        calls.clear()
        got = {r["doc_id"]: r["component_id"] for r in near_text.near_text_dedup(rows).collect()}
        assert got == dict(enumerate(part)) and way in calls
        if "_against_all" in calls:
            assert max(r["count"] for r in calls["_against_all"].groupBy("key").count().collect()) <= 40


def test_rare_shingles_meet():
    """Whatever counts say, the rarest shingles of two similar sets have one in common."""
    from crosspanel.llm import near_text

    for _ in range(300):
        n = int(rng.integers(1, 60))
        both = rng.choice(1 << 40, n + 20, replace=False).astype(np.uint64)
        out = int(n * rng.random() * 0.25)
        a, b = np.sort(both[:n]), np.sort(np.concatenate([both[out:n], both[n : n + int(rng.integers(0, 1 + n // 5))]]))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            counts = rng.integers(0, 5, near_text.BINS)
            assert len(np.intersect1d(near_text.rarest(a, counts, 0.8), near_text.rarest(b, counts, 0.8)))
    assert len(near_text.rarest(np.zeros(0, np.uint64), np.zeros(near_text.BINS, np.int64), 0.8)) == 0


def test_near_text_of_many_strangers_is_linear(spark, monkeypatch):
    """1,500 unlike texts around one frequent passage under one key, some of them near copies: no block meets another, groups stay small."""
    from crosspanel.llm import near_text

    passage = prose(40)
    own = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(1500)]
    texts = [f"{x} {passage}" for x in own] + [f"{x} changed {passage}" for x in own[:100]]
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    monkeypatch.setattr(near_text, "CROWD", 100)
    monkeypatch.setattr(near_text, "BLOCKS", 8)
    monkeypatch.setattr(near_text, "bands", lambda found: np.arange(25, dtype=np.uint64))
    kept = {}
    run = near_text._by_rare_shingles
    monkeypatch.setattr(near_text, "_by_rare_shingles", lambda *a: kept.setdefault("pairs", run(*a)))
    monkeypatch.setattr(near_text, "_against_all", None)  # must not be needed
    got = {r["doc_id"]: r["component_id"] for r in near_text.near_text_dedup(rows).collect()}
    assert got == {i: i if i < 1500 else i - 1500 for i in range(1600)}
    assert kept["pairs"].count() <= 1600 * 25 and max(r["count"] for r in kept["pairs"].groupBy("key").count().collect()) <= 4


def _xx(value, seed=42):
    """Spark's xxhash64 of an int, a long or a text, unsigned."""
    raw = value.encode() if isinstance(value, str) else value
    return xxhash.xxh64_intdigest(raw, seed)


def test_shards_against_brute_force(spark):
    """The published jump loop, with a generator of its own key and step; 40 shards, 41 shards, and what the first says of the second."""

    def jump(key, shards):
        shard, target, i = -1, 0, 0
        while target < shards:
            i += 1
            shard = target
            seed = 42 if key is None else _xx(struct.pack("<q", key))
            unit = ((_xx(struct.pack("<i", i), seed) >> 11) + 1) / 2**53
            target = int((shard + 1) / unit)
        return shard

    keys = [None, 0, -1, 2**62, *range(7, 3000, 3), 10, 10]
    table = spark.createDataFrame([(k, "t") for k in keys], "doc_id long, text string")
    at, more = ([(r["doc_id"], r["shard"], r["grown_shard"]) for r in shard_rows(table, n).collect()] for n in (40, 41))
    assert collections.Counter(at) == collections.Counter((k, jump(k, 40), jump(k, 41)) for k in keys)
    assert collections.Counter((k, s) for k, s, _ in more) == collections.Counter((k, g) for k, _, g in at)


def test_rules_verdict_against_brute_force(spark):
    """``score`` and ``kept`` by counting hashed words and word pairs in Python; every document above or below the limit is told apart."""
    draw = np.random.default_rng(11)
    good, poor = WORDS[:200], WORDS[100:]
    rows = [(i, " ".join(draw.choice(good if i % 2 else poor, 25 + i % 40))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "few words"), (83, "same words " * 40), (84, rows[0][1]), (None, rows[1][1]), (3, rows[3][1]), (85, "é ü x " + rows[5][1])]
    trusted = {i for i in range(1, 80, 4)} | {82}
    labels = [(i, 1, 0) for i in trusted] + [(2, 1, 1), (4, 0, 0), (None, 1, 0), (1, 1, 0)]
    buckets = 1 << 12

    def features(text):
        words = [w.decode() for w in (text or "").encode().split()]
        half = buckets // 2
        return [_xx(w) % half * 2 for w in words] + [_xx(b, _xx(a)) % half * 2 + 1 for a, b in zip(words, words[1:])]

    target, raw = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(features(t))
        if i in trusted:
            target.update(features(t))
    t, r = target.total() + buckets / 2, raw.total() + buckets / 2
    score = {text: sum(round(np.log((target[f] + 0.5) / t) - np.log((raw[f] + 0.5) / r), 6) for f in features(text)) / max(1, len(features(text))) for _, text in rows}
    least = np.quantile([score[text] for i, text in rows if i in trusted], 0.12)

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), buckets=buckets, quantile=0.12)
    texts = collections.defaultdict(set)
    for i, text in rows:
        texts[i].add(text)
    verdicts = collections.Counter()
    for x in got.collect():
        (text,) = texts[x["doc_id"]]
        assert abs(x["score"] - score[text]) < 3e-6
        assert abs(score[text] - least) > 3e-6 and x["kept"] == (not x["base_failed"] and score[text] >= least)
        verdicts[x["base_failed"], x["kept"]] += 1
    assert sum(verdicts.values()) == len(rows) and verdicts[False, False] > 5 and verdicts[False, True] > 5 and verdicts[True, False] >= 4


def test_packed_pieces_are_the_librarys(docs):
    """Every piece's ids by its checksum, against the tokenizers library over the whole fixture."""
    library = Tokenizer.from_file(TOKENIZER)
    ids = [(f[0], library.encode(f[1] or "", add_special_tokens=False).ids + [0]) for f in fixture()]
    known = collections.defaultdict(list)
    for i, x in ids:
        known[i, len(x)].append(np.array(x, "<u4"))
    pieces = pack(docs, TOKENIZER).collect()
    assert sum(r["length"] for r in pieces) == sum(len(x) for _, x in ids)
    for r in pieces:
        a, b = r["start"], r["start"] + r["length"]
        assert any(zlib.crc32(x[a:b].tobytes()) == r["ids_crc32"] for x in known[r["doc_id"], r["doc_tokens"]])


def test_very_long_texts(spark):
    """Two equal texts of 300,000 words and one of a million characters without white space, among small ones, in every operator on documents."""
    from crosspanel.llm.near_text import near_text_dedup

    words = [f"{WORDS[int(i)]}{int(j)}" for i, j in zip(rng.integers(0, len(WORDS), 300_000), rng.integers(0, 50, 300_000))]
    long = " ".join(words)
    rows = [(1, long, "en", "a", 0), (2, long, "en", "b", 0), (3, "x" * 1_000_000, "en", "a", 0), (4, "short one", "en", "a", 0), (5, None, None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    mixed = by(mix(docs))
    assert [mixed[i]["size"] for i in range(1, 6)] == [300_000, 300_000, 1, 2, 0]
    prints = by(simhash_dedup(docs))
    assert prints[1]["fingerprint"] == prints[2]["fingerprint"] and prints[2]["component_id"] == 1 and prints[3]["component_id"] == 3
    gone = by(suffix_dedup(docs))
    assert gone[1]["n_removed"] == gone[2]["n_removed"] == len(long.encode()) and gone[3]["n_removed"] == 1_000_000 and gone[4]["n_removed"] == 0
    exact = by(exact_dedup(docs))
    assert exact[2]["keep_id"] == 1 and exact[1]["group_size"] == 2
    shards = by(shard_rows(docs))
    assert shards[3]["size"] == 1_000_016 and shards[1]["text_crc32"] == shards[2]["text_crc32"]
    cut = by(substring_dedup(docs))
    assert cut[1]["n_removed"] == cut[2]["n_removed"] == 300_000 and cut[3]["n_removed"] == 0
    near = by(near_text_dedup(docs))
    assert near[2]["component_id"] == 1 and near[4]["component_id"] == 4
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    ruled = by(quality_rules(docs, labels))
    assert ruled[1]["n_words"] == 300_000 and ruled[3]["word_chars"] == 1_000_000 and ruled[4]["base_failed"]


def test_near_text_proposes_by_fingerprints(spark, monkeypatch):
    """With bands that never agree, texts whose SimHash fingerprints are within three bits still meet, and link by their similarity alone."""
    from crosspanel.llm import near_text
    from crosspanel.llm.simhash import majority

    words = [f"w{i * 7919 % 3001}" for i in range(2000)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(words[::-1]), ""]
    prints = [majority(near_text.shingles(t.encode())) for t in texts]
    assert 0 <= (prints[0] ^ prints[1]).bit_count() <= 3 < (prints[0] ^ prints[2]).bit_count()
    monkeypatch.setattr(near_text, "bands", lambda found: np.arange(near_text.BANDS, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(near_text.node_of(found) >> 32))
    got = near_text.near_text_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
