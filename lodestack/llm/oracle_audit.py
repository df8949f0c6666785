"""DuckDB SQL for line dedup, dominance counting and the filter audit."""

from __future__ import annotations

OP11 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, r, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d
), k AS (
  SELECT doc_id, r, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), own AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.*, coalesce(k.doc_id > own.owner, false) AS gone FROM k LEFT JOIN own USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id, r
"""

#: crc32 is not among DuckDB's functions: a table of 256 steps, then one look-up for each character.
OP12 = r"""
WITH steps AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda acc, i: xor(acc >> 1, 3988292384 * (acc & 1))) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)
), s AS (
  SELECT sale_id, CAST(date_diff('day', DATE '1970-01-01', CAST(sold_at AS DATE)) AS BIGINT) AS slot,
         CAST(floor(floor(100 * total + 0.5) / 1000) AS BIGINT) AS level,
         1 + xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                             lambda acc, c: xor(acc >> 8, t[(xor(acc, c) & 255) + 1])), 4294967295) % 3 AS w
  FROM sales, steps
), cell AS (
  SELECT slot, level, count(*) AS n, CAST(sum(w) AS BIGINT) AS w FROM s WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY ALL
), above AS (
  SELECT y.slot, y.level, coalesce(sum(x.n), 0) AS n, coalesce(sum(x.w), 0) AS w
  FROM cell y LEFT JOIN cell x ON x.slot <= y.slot AND x.level > y.level GROUP BY ALL
)
SELECT sale_id, s.slot, s.level, CAST(above.n AS BIGINT) AS n_sales, CAST(above.w AS BIGINT) AS n_rows
FROM s LEFT JOIN above ON above.slot = s.slot AND above.level = s.level
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), m AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), letters(x) AS (
  VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, k, o[k] AS x, string_split(o[1:k - 1], '') AS before, string_split(o[1:k], '') AS upto FROM (SELECT o, unnest(range(1, 6)) AS k FROM orders)
), r AS (
  SELECT part, o, k, x,
         sum(n) FILTER (NOT list_has_any(string_split(fails, ''), upto) OR fails = '') AS kept,
         sum(n) FILTER (contains(fails, x) AND NOT (k > 1 AND list_has_any(string_split(fails, ''), before))) AS removed,
         sum(n) FILTER (contains(fails, x) AND k > 1 AND list_has_any(string_split(fails, ''), before)) AS redundant,
         sum(n) FILTER (fails = x) AS alone,
         sum(good) FILTER (contains(fails, x) AND NOT (k > 1 AND list_has_any(string_split(fails, ''), before))) AS good_lost,
         sum(toxic) FILTER (contains(fails, x) AND NOT (k > 1 AND list_has_any(string_split(fails, ''), before))) AS toxic_lost
  FROM m, steps GROUP BY ALL
)
SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(alone, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""

SQL = {"op11_line_dedup": OP11, "op12_dominance_counting": OP12, "op13_filter_audit": OP13}
