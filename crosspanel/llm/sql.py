"""SQL twins of the queries, for DuckDB."""

WORDS = r"[^\x20\x09-\x0D]+"

OP4 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), r AS (
  SELECT doc_id, n, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size
  FROM t WINDOW w AS (PARTITION BY n ORDER BY length(x) DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, place = 1 AS kept, sha256(n) AS text_sha256 FROM r
"""

OP1 = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][(no % 3 + 1)::INT]::DOUBLE AS w, 3.0::DOUBLE * n AS cap FROM totals
), filled AS (
  SELECT *, (sum(n) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS mass
  FROM weighed WINDOW b AS (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(rest / mass, (cap / w, no)) AS lam, min((cap / w, no)) AS edge FROM filled WHERE rest * w / mass <= cap
), targets AS (
  SELECT f.*, CASE WHEN (cap / w, no) >= edge THEN lam * w ELSE cap END AS target, least(1024, greatest(1, n // 1024)) AS b FROM filled f, level
), slotted AS (
  SELECT *, sum(target / b) OVER (ORDER BY no) / sum(target / b) OVER () AS run, ceil(sum(target / b) OVER ())::BIGINT AS slots FROM targets
), shares AS (
  SELECT *, floor(run * 4294967296)::BIGINT AS high, lag(floor(run * 4294967296)::BIGINT, 1, 0) OVER (ORDER BY no) AS low, (n + b - 1) // b AS blocks FROM slotted
), points AS (
  SELECT i, (i::HUGEINT * 2654435769 % 4294967296)::BIGINT AS p FROM (SELECT unnest(range((SELECT max(slots) FROM shares))) AS i)
), ranked AS (
  SELECT no, blocks, row_number() OVER (PARTITION BY no ORDER BY i) - 1 AS k FROM points JOIN shares ON p >= low AND p < high
), times AS (
  SELECT no, k % blocks AS block, count(*) AS times FROM ranked WHERE k < 3 * blocks GROUP BY ALL
), placed AS (
  SELECT d.doc_id, d.size, s.no, s.b, s.n AS source_size, s.target, row_number() OVER () AS uid,
         sum(d.size) OVER (PARTITION BY s.no ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - d.size AS a
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source
), pieces AS (
  SELECT *, unnest(CASE WHEN size = 0 THEN [0::BIGINT] ELSE range((a // b)::BIGINT, ((a + size - 1) // b + 1)::BIGINT) END) AS block FROM placed
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       sum(CASE WHEN size = 0 THEN 0 ELSE (least(a + size, (block + 1) * p.b) - greatest(a, block * p.b)) * coalesce(times, 0) END)::BIGINT AS taken
FROM pieces p LEFT JOIN times USING (no, block) GROUP BY uid, doc_id, size, source_size, target
"""

OP7 = rf"""
WITH t AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents
), windows AS (
  SELECT uid, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT uid, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35)
), twice AS (
  SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY h) AS c FROM windows) WHERE c > 1
), gone AS (
  SELECT DISTINCT uid, i + j AS p FROM twice, (SELECT unnest(range(35)) AS j)
), listed AS (
  SELECT uid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM t
), kept AS (
  SELECT l.uid, string_agg(word, ' ' ORDER BY l.p) FILTER (g.uid IS NULL) AS words, count(g.uid) AS n_removed
  FROM listed l LEFT JOIN gone g ON l.uid = g.uid AND l.p = g.p GROUP BY l.uid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (uid)
"""

OP3 = """
WITH t AS (
  SELECT row_number() OVER () AS uid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), windows AS (
  SELECT uid, i, md5(substr(x, (2 * i + 1)::BIGINT, 400)) AS h FROM (SELECT uid, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM t WHERE length(x) >= 400)
), twice AS (
  SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY h) AS c FROM windows) WHERE c > 1
), islands AS (
  SELECT uid, i, sum(fresh) OVER (PARTITION BY uid ORDER BY i) AS island
  FROM (SELECT uid, i, CASE WHEN i - lag(i) OVER (PARTITION BY uid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM twice)
), spans AS (
  SELECT uid, min(i) AS b, max(i) + 200 AS e FROM islands GROUP BY uid, island
), gaps AS (
  SELECT uid, coalesce(lag(e) OVER (PARTITION BY uid ORDER BY b), 0) AS f, b AS u FROM spans
  UNION ALL SELECT uid, coalesce(max(e), 0), any_value(length(x) // 2) FROM t LEFT JOIN spans USING (uid) GROUP BY uid
), kept AS (
  SELECT uid, string_agg(substr(x, (2 * f + 1)::BIGINT, (2 * (u - f))::BIGINT), '' ORDER BY f) AS k FROM gaps JOIN t USING (uid) GROUP BY uid
)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, ((length(x) - length(k)) // 2)::BIGINT AS n_removed,
       (SELECT count(*) FROM spans s WHERE s.uid = t.uid)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM t JOIN kept USING (uid)
"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH words AS (
  SELECT uid, doc_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS uid, doc_id, text FROM documents)
), tfs AS (
  SELECT uid, doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), sizes AS (
  SELECT uid, sum(tf)::BIGINT AS n FROM tfs GROUP BY uid
), stats AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, stats GROUP BY term, docs
), items AS (
  SELECT DISTINCT uid AS item, item_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS uid, item_id, text FROM benchmark)
), scored AS (
  SELECT item, item_id, uid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (uid), stats GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP13 = """
WITH t AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.vec_id, b.label = a.label AS alike, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM t a JOIN t b ON a.uid <> b.uid WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS slot FROM scored WHERE alike QUALIFY slot <= 5
), hard AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor, p.slot ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM positives p JOIN scored s ON p.anchor = s.anchor AND NOT s.alike AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score QUALIFY rank <= 5
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM hard
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1, "op3_suffix_dedup": OP3, "op4_exact_dedup": OP4, "op7_substring_words": OP7, "op12_ranked_search": OP12, "op13_hard_negatives": OP13}
