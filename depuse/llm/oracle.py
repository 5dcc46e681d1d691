"""DuckDB SQL for the queries that SQL can express, from their definitions."""

from __future__ import annotations

_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

URL_FILTERS = f"""
WITH rules(h, p, v) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (
  SELECT row_number() OVER () AS r, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t
  FROM pages),
parts AS (
  SELECT r, page_id, translate(coalesce(regexp_extract(t, '^[^/?#]*'), ''), {_FOLD}) AS host,
         coalesce(regexp_extract(regexp_replace(t, '^[^/?#]*', ''), '^[^?#]*'), '') AS path
  FROM rest)
SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule,
       coalesce(arg_max(v, length(h || p)), 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY r, page_id, host, path"""

VECTOR_SEARCH = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY rank <= 5"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(src, dst) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.src, l.b FROM reach r JOIN links l ON r.dst = l.a),
least_ AS (SELECT src, min(dst) AS d FROM reach GROUP BY src)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(l.d, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(l.d, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_ l ON l.src = d.doc_id"""

# crc32 by its table; the list of 256 entries follows from the polynomial.
IMPORTANCE = f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
words AS (
  SELECT r, 0 AS aim, unnest(regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w
  FROM (SELECT row_number() OVER () AS r, text FROM documents)
  UNION ALL
  SELECT NULL, 1, unnest(regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))
  FROM benchmark),
held AS (SELECT r, aim, w, count(*) AS c FROM words GROUP BY r, aim, w),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM held)),
hashed AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2),
           lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1]))) % 10000 AS bucket
  FROM hexed, crc_table),
counts AS (
  SELECT bucket, sum(CASE WHEN aim = 0 THEN c ELSE 0 END) AS s, sum(CASE WHEN aim = 1 THEN c ELSE 0 END) AS t
  FROM held JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE))) AS g
  FROM counts, totals),
per_doc AS (
  SELECT r, sum(c) AS n, sum(c * g) AS total
  FROM held JOIN hashed USING (w) JOIN gains USING (bucket) WHERE aim = 0 GROUP BY r),
scored AS (
  SELECT r, doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) LEFT JOIN per_doc USING (r)),
placed AS (
  SELECT doc_id, n_features, weight, weight + noise AS score,
         row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id, r) AS p,
         sum(CASE WHEN n_features >= 20 THEN 1 ELSE 0 END) OVER () AS pool
  FROM scored)
SELECT doc_id, n_features AS n_words, n_features, weight, score,
       CASE WHEN n_features >= 20 AND p <= pool * 10 // 100 THEN p END AS rank
FROM placed"""

COLLOCATIONS = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), {_FOLD}), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, 1 AS k, unnest(w) AS p FROM lists
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lists
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM lists),
f AS (SELECT lang, k, p, count(*) AS n FROM runs GROUP BY lang, k, p),
cand AS (SELECT lang, k, p, n AS a, string_split(p, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
longer AS (
  SELECT lang, p, max(a) AS m FROM (
    SELECT lang, w[1] || ' ' || w[2] AS p, a FROM cand WHERE k = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM cand WHERE k = 3) GROUP BY lang, p),
left_ AS (SELECT c.* FROM cand c LEFT JOIN longer o ON o.lang = c.lang AND o.p = c.p WHERE o.m IS NULL OR 100 * o.m < 50 * c.a),
cuts AS (
  SELECT lang, p, a, 1 AS cut, w[1] AS x, CASE k WHEN 2 THEN w[2] ELSE w[2] || ' ' || w[3] END AS y FROM left_
  UNION ALL SELECT lang, p, a, 2, w[1] || ' ' || w[2], w[3] FROM left_ WHERE k = 3),
scored AS (
  SELECT c.lang, c.p, c.a, c.cut, x.n AS l, y.n AS r,
         CAST((1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.x JOIN f y ON y.lang = c.lang AND y.p = c.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
sizes AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, s.n, score
FROM best b JOIN sizes s ON s.lang = b.lang
QUALIFY rank <= 2000"""

ORACLE = {
    "op1_url_filters": URL_FILTERS,
    "op2_vafile": VECTOR_SEARCH,
    "op10_bbit_minhash": NEAR_DUPLICATES,
    "op11_importance": IMPORTANCE,
    "op12_collocations": COLLOCATIONS,
}
