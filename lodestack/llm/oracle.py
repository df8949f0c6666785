"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP3 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), own AS (
  SELECT k, min(doc_id) AS owner FROM win GROUP BY k
), gone AS (
  SELECT DISTINCT win.doc_id, unnest(range(win.i, win.i + 50)) AS p FROM win JOIN own USING (k) WHERE win.doc_id > own.owner
), per AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), cut AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
         CASE WHEN ps IS NULL THEN ws
              ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]) END AS kept
  FROM w LEFT JOIN per ON w.doc_id = per.doc_id
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM cut
"""

#: Words of op10: A-Z in lower case, then runs of digits, letters and characters beyond ASCII.
_WORDS10 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = rf"""
WITH d AS (
  SELECT doc_id, {_WORDS10} AS ws FROM documents
), b AS (
  SELECT item_id, {_WORDS10} AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, len(ws[i:i + 9]) AS n, array_to_string(ws[i:i + 9], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (
  SELECT DISTINCT n FROM win
), spot AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)
), hit AS (
  SELECT doc_id, item_id, i, spot.n FROM spot JOIN win ON spot.k = win.k AND spot.n = win.n
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)
), both_ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT a AS node, a AS seen FROM both_ways
  UNION
  SELECT node, b FROM reach JOIN both_ways ON seen = a
), least AS (
  SELECT node, min(seen) AS c FROM reach GROUP BY node
), deg AS (
  SELECT a, count(*) AS n_links FROM both_ways GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.c, w.doc_id) AS component_id, coalesce(n_links, 0) AS n_links
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.node = w.doc_id LEFT JOIN deg ON deg.a = w.doc_id
"""

SQL = {"op7_ngram_jaccard_join": OP7, "op3_substring_dedup": OP3, "op10_benchmark_decontamination": OP10}
