"""DuckDB SQL for search, extraction, licence scans and quotations."""

from __future__ import annotations

from .licenses import TEMPLATES, needs


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP2 = f"""
WITH w AS (
  SELECT doc_id, {_words('text')} AS ws FROM documents
), t AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM w) GROUP BY ALL
), n AS (
  SELECT count(*) AS n, avg(len(ws)) AS mean FROM w
), df AS (
  SELECT term, count(*) AS df FROM t GROUP BY term
), s AS (
  SELECT q.doc_id AS query_id, t.doc_id, sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * len(w.ws) / n.mean))) AS score
  FROM t q JOIN df USING (term) JOIN t ON t.term = q.term JOIN w ON w.doc_id = t.doc_id, n WHERE q.doc_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank, doc_id, round(score, 6) AS score
FROM s QUALIFY rank <= 10
"""

#: For pages of the stored kind: one article element of headings and paragraphs.
OP5 = r"""
WITH a AS (
  SELECT page_id, url, unnest(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>')) AS b,
         unnest(range(10000)) AS i
  FROM pages
), c AS (
  SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g'),
         '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS b FROM a WHERE b IS NOT NULL
), t AS (
  SELECT page_id, string_agg(b, chr(10) ORDER BY i) AS text FROM c WHERE b <> '' GROUP BY page_id
)
SELECT p.page_id, p.url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM pages p LEFT JOIN t USING (page_id)
"""

_TEMPLATE_ROWS = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))

_NEEDED = ", ".join(f"({t}, {k}, '{w}')" for k, (t, words) in enumerate(needs(TEMPLATES)) for w in words)

OP8 = f"""
WITH t(tid, name, text) AS (VALUES {_TEMPLATE_ROWS}),
tw AS (SELECT tid, w, count(*) AS tf FROM (SELECT tid, unnest({_words('text')}) AS w FROM t) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT w, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_words('text')}) AS w FROM documents) WHERE w IN (SELECT w FROM tw) GROUP BY w),
idf AS (SELECT DISTINCT tw.w, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM tw LEFT JOIN df ON df.w = tw.w, n),
tv AS (SELECT tid, w, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY tid)) AS v FROM tw JOIN idf USING (w)),
lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, text FROM documents),
one AS (SELECT doc_id, i - 1 AS line, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM lines)),
worded AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM one WHERE len({_words('text')}) > 0),
units AS (
  SELECT doc_id, 0 AS kind, line, text FROM one
  UNION ALL SELECT doc_id, 1, min(line), string_agg(text, chr(10) ORDER BY line) FROM worded GROUP BY doc_id, run HAVING count(*) > 1
  UNION ALL SELECT doc_id, 2, -1, text FROM lines
),
uw AS (SELECT doc_id, kind, line, w, count(*) AS tf FROM (SELECT doc_id, kind, line, unnest({_words('text')}) AS w FROM units) GROUP BY ALL),
uv AS (SELECT doc_id, kind, line, uw.w, tf * coalesce(idf, ln(n + 1) + 1) AS v FROM uw LEFT JOIN idf ON idf.w = uw.w, n),
norm AS (SELECT doc_id, kind, line, sqrt(sum(v * v)) AS norm FROM uv GROUP BY ALL),
cos AS (SELECT uv.doc_id, uv.kind, uv.line, tid, sum(uv.v * tv.v) / any_value(norm) AS c FROM uv JOIN tv ON tv.w = uv.w JOIN norm USING (doc_id, kind, line) GROUP BY ALL),
need(tid, nid, w) AS (VALUES {_NEEDED}),
needed AS (SELECT tid, count(DISTINCT nid) AS k FROM need GROUP BY tid),
has AS (SELECT doc_id, kind, line, tid, count(DISTINCT nid) AS k FROM uw JOIN need USING (w) GROUP BY ALL),
best AS (
  SELECT doc_id, CASE WHEN kind < 2 THEN line END AS line, name, c FROM cos JOIN t USING (tid) LEFT JOIN needed USING (tid) LEFT JOIN has USING (doc_id, kind, line, tid)
  WHERE c >= 0.6 AND coalesce(has.k, 0) = coalesce(needed.k, 0) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(c, 9) DESC, kind, line, tid) = 1
),
files AS (
  SELECT d.doc_id, coalesce(source, 'unknown') || '/' || d.doc_id // 1000 || '/' || d.doc_id // 100 AS dir,
         CASE WHEN d.doc_id % 100 = 0 THEN 'LICENSE' ELSE d.doc_id || '.txt' END AS file, name, c, line
  FROM documents d LEFT JOIN best USING (doc_id)
),
holders AS (SELECT dir, name FROM files WHERE file = 'LICENSE' AND name IS NOT NULL),
above AS (
  SELECT DISTINCT f.dir, h.dir AS up, h.name FROM (SELECT DISTINCT dir FROM files) f JOIN holders h ON f.dir = h.dir OR starts_with(f.dir, h.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY f.dir ORDER BY length(h.dir) DESC) = 1
)
SELECT f.doc_id, f.dir || '/' || file AS path, f.name AS own_license, coalesce(round(c, 6), 0.0) AS own_score, CAST(line AS BIGINT) AS in_line,
       coalesce(f.name, a.name) AS license, CASE WHEN f.name IS NOT NULL THEN f.dir || '/' || file ELSE up END AS license_from
FROM files f LEFT JOIN above a ON a.dir = f.dir
"""


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[[:space:][:punct:]]+', ' ', 'g'))"


_MARK = r"^[ \t]*(?:>[ \t]?)+"
_SAID = r"(?i)^(on|am|le|el)\b.*\b(wrote|schrieb|écrit|escribió)\s*:\s*$"
_DEPTH = rf"length(regexp_replace(regexp_extract(l, '{_MARK}'), '[^>]', '', 'g'))"

def quotation_sql(conversations: str = "conversations") -> str:
    return _OP9.replace("CONVERSATIONS", conversations)


_OP9 = rf"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text FROM CONVERSATIONS
), ln AS (
  SELECT id, conv_id, turn, i, l, {_DEPTH} AS depth FROM (
    SELECT id, conv_id, turn, unnest(range(len(ls))) AS i, unnest(ls) AS l FROM (SELECT *, regexp_split_to_array(text, '\r\n|\r|\n') AS ls FROM m))
), kept AS (
  SELECT *, depth = 0 AND NOT (regexp_matches(l, '{_SAID}') AND coalesce(lead(depth) OVER (PARTITION BY id ORDER BY i), 0) > 0) AS mine,
         CASE WHEN depth IS DISTINCT FROM lag(depth) OVER (PARTITION BY id ORDER BY i) THEN 1 ELSE 0 END AS fresh FROM ln
), own AS (
  SELECT m.id, m.conv_id, m.turn, m.role, CASE WHEN regexp_matches(text, '(?m)^[ \t]*>')
    THEN regexp_replace(regexp_replace(coalesce(o, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') ELSE text END AS own
  FROM m LEFT JOIN (SELECT id, string_agg(l, chr(10) ORDER BY i) AS o FROM kept WHERE mine GROUP BY id) USING (id)
), quoted AS (
  SELECT id, conv_id, turn, passage, depth, {_norm(f"regexp_replace(l, '{_MARK}', '')")} AS said, i
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY i) AS passage FROM kept) WHERE depth > 0
), passages AS (
  SELECT id, conv_id, turn, passage, depth, list(said ORDER BY i) AS ls FROM quoted WHERE said <> '' GROUP BY ALL
), held AS (
  SELECT DISTINCT conv_id, turn, {_norm('x')} AS k FROM (
    SELECT conv_id, turn, unnest([own] || regexp_split_to_array(own, '\n\s*\n') || regexp_split_to_array(own, '\r\n|\r|\n')) AS x FROM own) WHERE k <> ''
), probes AS (
  SELECT id, conv_id, turn, passage, array_to_string(ls, ' ') AS k, len(ls) + 1 AS weight, 1 AS whole, len(ls) AS n FROM passages
  UNION ALL SELECT id, conv_id, turn, passage, unnest(ls), 1, 0, len(ls) FROM passages
), votes AS (
  SELECT p.id, p.passage, h.turn AS source, sum(p.weight) AS votes, max(p.whole) AS whole, any_value(n) AS n
  FROM probes p JOIN held h ON h.conv_id = p.conv_id AND h.k = p.k AND h.turn < p.turn GROUP BY ALL
), best AS (
  SELECT id, passage, votes, source FROM votes WHERE votes * 2 > n
  QUALIFY row_number() OVER (PARTITION BY id, passage ORDER BY whole DESC, CASE WHEN whole = 1 THEN source END DESC, votes DESC, source DESC) = 1
), links AS (
  SELECT p.id, count(*) AS n_quotes, count(source) AS n_linked, arg_max(source, (votes, source)) FILTER (depth = 1) AS answers
  FROM passages p LEFT JOIN best b ON b.id = p.id AND b.passage = p.passage GROUP BY p.id
), placed AS (
  SELECT own.*, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, answers,
         (SELECT max(o.turn) FROM m o WHERE o.conv_id = own.conv_id AND o.turn < own.turn) AS prev FROM own LEFT JOIN links USING (id)
), starts AS (
  SELECT conv_id, turn AS f, max(answers) AS s FROM placed WHERE answers IS NOT NULL GROUP BY conv_id, turn, prev HAVING max(answers) <> prev
), up AS (
  SELECT a.conv_id, a.f, a.s, max(b.f) AS u FROM starts a LEFT JOIN starts b ON b.conv_id = a.conv_id AND b.f <= a.s GROUP BY ALL
), prefix AS (
  SELECT conv_id, f, [s, f] AS p FROM up WHERE u IS NULL
  UNION ALL SELECT up.conv_id, up.f, prefix.p || [up.s, up.f] FROM up JOIN prefix ON up.conv_id = prefix.conv_id AND up.u = prefix.f
), branch AS (
  SELECT placed.*, (SELECT max(f) FROM starts s WHERE s.conv_id = placed.conv_id AND s.f <= placed.turn) AS b FROM placed
)
SELECT x.conv_id, turn, role, n_quotes, n_linked, coalesce(answers, prev) AS reply_to, array_to_string(coalesce(p, []) || [turn], '.') AS reply_path, sha256(own) AS own_sha256
FROM branch x LEFT JOIN prefix ON prefix.conv_id = x.conv_id AND prefix.f = x.b
"""

#: Every message quotes the one before it (as ``queries.quoting`` makes it), so that there is something to link.
QUOTING = r"""(SELECT conv_id, turn, role, CASE WHEN before IS NULL THEN text ELSE '> ' || regexp_replace(before, '\r\n|\r|\n', chr(10) || '> ', 'g') || chr(10) || coalesce(text, '') END AS text
  FROM (SELECT conv_id, turn, role, text, (SELECT min(o.text) FROM conversations o WHERE o.conv_id = c.conv_id AND o.turn = c.turn - 1 - c.turn % 2) AS before FROM conversations c))"""

SQL = {"op2_exact_topk_search": OP2, "op5_html_extraction": OP5, "op8_license_scan": OP8, "op9_quotation_linking": quotation_sql(), "quotation_linking_of_replies": quotation_sql(QUOTING)}
