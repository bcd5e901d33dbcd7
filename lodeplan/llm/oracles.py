"""DuckDB SQL for the queries that SQL can express, written from the definitions and not from the operators."""

DECONTAMINATE = r"""
WITH word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_window AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS g
  FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(k) WHERE len(w) > 0
), doc_window AS (
  SELECT doc_id, k, s.size, array_to_string(w[k:k + s.size - 1], ' ') AS g
  FROM word, (SELECT DISTINCT size FROM item_window) s, unnest(range(1, len(w) - s.size + 2)) AS u(k) WHERE len(w) >= s.size
), hit AS (
  SELECT d.doc_id, d.k, d.size, i.item_id FROM doc_window d JOIN item_window i ON d.g = i.g AND d.size = i.size
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + size)) AS u(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM word w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_DIGIT = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_CHUNK = " || ".join(f"({_DIGIT})[(CAST('0x' || h[{5 * k + 1}:{5 * k + 5}] AS BIGINT) >> {s}) % 32 + 1]" for k in range(8) for s in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY page_id NULLS LAST) AS n, first_value(page_id) OVER (PARTITION BY b ORDER BY page_id NULLS LAST) AS best FROM p)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, {_CHUNK} AS payload_digest,
  CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN best END AS refers_to
FROM r
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + least(len(w), 4) - 1], ' ') AS s
  FROM word, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS u(k) WHERE len(w) > 0
), size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN size m ON m.doc_id = p.a JOIN size q ON q.doc_id = p.b WHERE 100 * p.n >= 80 * (m.n + q.n - p.n)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM documents d JOIN reach USING (doc_id) LEFT JOIN size s USING (doc_id) GROUP BY d.doc_id, s.n
"""

_RULES = (
    ("assign", 0, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", 2, r"[0-9a-f]+", 0, 16),
)


def _spans(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, {place} AS k, '{kind}' AS kind, a - length(m) AS a, a AS b, v FROM (
      SELECT doc_id, m, v, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS a FROM (
        SELECT doc_id, i, pieces[i] AS g, hits[i] AS m, vals[i] AS v FROM (
          SELECT doc_id, string_split_regex(t, '{p}') AS pieces, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {group}) AS vals
          FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)), unnest(range(1, len(hits) + 1)) AS u(i)))
    WHERE length(v) >= {least}"""


SECRETS = f"""
WITH span AS ({" UNION ALL ".join(_spans(*r) for r in _RULES)}),
own AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS s FROM span GROUP BY doc_id
)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans
FROM documents LEFT JOIN own USING (doc_id)
"""
