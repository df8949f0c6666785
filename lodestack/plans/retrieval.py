"""Queries over search text, indexes, rankings and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import dates
from lodestack.functions import text as words
from lodestack.operators import index, search
from lodestack.sources.staging import new_path
from lodestack.sources.tables import read, stream
from lodestack.streaming import sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _tokens(text: str) -> str:
    clean = f"lower(regexp_replace(regexp_replace({text}, '<[^>]*>', '', 'g'), '[[:punct:]]', ' ', 'g'))"
    return rf"list_filter(regexp_split_to_array({clean}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"


_INDEX = f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY ALL"
#: Words of the headline query over ``documents``.
WORDS = "The and whst, der"
PAGE_WORDS = "thereou eauou erntion stion"


def _index(spark, d):
    return index.whole_index(read(spark, d, "documents"))


@query(f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct({_tokens('text')})), ' ') AS tokens FROM conversations")
def query_tokens(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(words.unique_tokens(F.col("text"))), " ").alias("tokens"))


@query(f"{_INDEX}")
def inverted_index(spark, d):
    return _index(spark, d)


@query(f"SELECT term, CAST(doc_id AS VARCHAR) AS doc_id, tf FROM ({_INDEX})")
def posting_parse(spark, d):
    return index.from_posting_lists(index.posting_lists(_index(spark, d)))


@query(f"SELECT term, string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id) AS acc FROM ({_INDEX}) GROUP BY term")
def posting_lists(spark, d):
    return index.posting_lists(_index(spark, d))


@query(r"""
SELECT page_id AS doc_id, url AS acc, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS title,
  trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS body FROM pages
""")
def doc_table(spark, d):
    return index.doc_table(read(spark, d, "pages"))


@query(f"SELECT term, count(*) AS df, round(log10((SELECT count(*) FROM documents) / count(*)), 6) AS idf FROM ({_INDEX}) GROUP BY term")
def idf(spark, d):
    docs = read(spark, d, "documents")
    return index.weights(index.frequencies(docs), docs.agg(F.count("*").alias("n"))).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"SELECT term, doc_id, round(1 + log10(tf), 6) AS weight FROM ({_INDEX})")
def tf_weight(spark, d):
    return _index(spark, d).select("term", "doc_id", F.round(words.tf_weight(F.col("tf")), 6).alias("weight"))


def _scores(index_sql: str, n: str, terms: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""SELECT doc_id, sum(log10({n} / df) * (1 + log10(tf))) AS s FROM ({index_sql}) JOIN
  (SELECT term, count(*) AS df FROM ({index_sql}) GROUP BY term) USING (term) WHERE term IN ({listed}) GROUP BY doc_id HAVING s > 0.3"""


_TOP = f"SELECT doc_id, s FROM ({_scores(_INDEX, '(SELECT count(*) FROM documents)', ('the', 'and', 'whst', 'der'))}) ORDER BY s DESC, doc_id LIMIT 301"


@query(f"SELECT doc_id, round(s, 6) AS rank_score FROM ({_TOP})")
def search_topk(spark, d):
    docs = read(spark, d, "documents")
    scored = search.scores(index.inverted_index(docs), search.query_terms(spark, WORDS), docs.agg(F.count("*").alias("n")))
    return search.top(scored).select("doc_id", F.round("rank_score", 6).alias("rank_score"))


@query(f"SELECT doc_id, round(s, 6) AS rank_score FROM ({_TOP})")
def search_stored_index(spark, d):
    """The same search served from an index on disk."""
    docs, path = read(spark, d, "documents"), new_path(spark, "index")
    index.save(index.whole_index(docs), path)
    terms = search.query_terms(spark, WORDS)
    stored = index.load(spark, path, [r.term for r in terms.collect()])  # the words of one query
    scored = search.scores(stored, terms, docs.agg(F.count("*").alias("n")))
    return search.top(scored).select("doc_id", F.round("rank_score", 6).alias("rank_score"))


_BODY = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_PAGE_INDEX = f"SELECT term, doc_id, count(*) AS tf FROM (SELECT page_id AS doc_id, unnest({_tokens(_BODY)}) AS term FROM pages) GROUP BY ALL"
_PAGE_TOP = f"SELECT doc_id, s FROM ({_scores(_PAGE_INDEX, '(SELECT count(*) FROM pages)', tuple(PAGE_WORDS.split()))}) ORDER BY s DESC, doc_id LIMIT 301"


def page_search(spark, d, words_of_query: str = PAGE_WORDS):
    docs = index.doc_table(read(spark, d, "pages"))
    return search.search(spark, words_of_query, index.inverted_index(docs, "doc_id", "body"), docs)


@query(rf"""
SELECT t.doc_id, url, round(s, 6) AS rank_score, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS title, {_BODY} AS body
FROM ({_PAGE_TOP}) t JOIN pages ON page_id = t.doc_id
""")
def search_results(spark, d):
    return page_search(spark, d).withColumn("rank_score", F.round("rank_score", 6))


@query(rf"""
SELECT t.doc_id, url, round(s, 6) AS rank_score, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '[ \t\n\x0B\f\r]+', ' ', 'g')), ''), url) AS title,
  coalesce(nullif({_BODY}, ''), 'Not available for descriptions') AS body, CAST(floor((row_number() OVER (ORDER BY s DESC, t.doc_id) - 1) / 10) AS INTEGER) AS page
FROM (SELECT * FROM ({_PAGE_TOP}) ORDER BY s DESC, doc_id LIMIT 100) t JOIN pages ON page_id = t.doc_id
""")
def search_ui_page(spark, d):
    return search.ui_page(page_search(spark, d)).withColumn("rank_score", F.round("rank_score", 6))


@query(rf"""
SELECT CAST(count(*) AS INTEGER) AS n, coalesce(string_agg(url, ' ' ORDER BY round(s, 9) DESC, t.doc_id), '') AS urls FROM (SELECT * FROM ({_PAGE_TOP}) ORDER BY s DESC, doc_id LIMIT 301) t JOIN pages ON page_id = t.doc_id
""")
def search_json(spark, d):
    ranked = page_search(spark, d).withColumn("rank_score", F.round("rank_score", 9))
    parsed = search.as_json(ranked).select(F.from_json("value", "array<struct<url:string,rank_score:double,title:string,body:string>>").alias("v"))
    return parsed.select(F.size("v").alias("n"), F.array_join(F.transform("v", lambda x: x["url"]), " ").alias("urls"))


_GAPS = """
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n_hits FROM (
  SELECT user_id, ts, sum(CASE WHEN epoch_us(ts) - epoch_us(p) > %s THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s
  FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY user_id, s
"""


@query(_GAPS % (300 * 1_000_000))
def sessions_gap(spark, d):
    return sessions.sessions(read(spark, d, "events"))


@query(_GAPS % (3600 * 1_000_000))
def sessions_window(spark, d):
    return sessions.session_windows(read(spark, d, "events"), idle=3600)


@query("SELECT user_id, max(ts) AS last_ping, epoch_ms(TIMESTAMP '2024-01-30 12:00:00') - epoch_ms(max(ts)) <= 43200000 AS active FROM events GROUP BY user_id")
def liveness(spark, d):
    return sessions.liveness(read(spark, d, "events"), "2024-01-30 12:00:00", "user_id", alive=43200)


_PAUSE = 6 * 3600 * 1000


@query(f"""
WITH RECURSIVE ok AS (
  SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
  UNION ALL SELECT user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = ok.user_id AND epoch_ms(e.ts) >= epoch_ms(ok.ts) + {_PAUSE}) FROM ok WHERE ts IS NOT NULL
)
SELECT CAST(user_id AS VARCHAR) AS host, (SELECT count(*) FROM events e WHERE e.user_id = ok.user_id) AS n_hits, count(ts) AS n_allowed FROM ok GROUP BY user_id
""")
def throttle_stream(spark, d):
    """Attempts of a stream that keep a pause, by the state of their host."""
    events = stream(spark, d, "events")
    hits = events.select(F.col("user_id").cast("string").alias("host"), F.col("ts").cast("timestamp").alias("ts"))
    path, checkpoint = new_path(spark, "throttled"), new_path(spark, "checkpoint")
    done = sessions.throttled(hits, pause_ms=_PAUSE, forget_ms=None).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    done.awaitTermination()
    return spark.read.parquet(path).groupBy("host").agg(F.count("*").alias("n_hits"), F.count_if("allowed").alias("n_allowed"))


@query("""
SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS http, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS stamp, date_trunc('second', ts) AS back, true AS unmodified FROM events
""")
def http_dates(spark, d):
    made = read(spark, d, "events").select("event_id", "ts", dates.http_date(F.col("ts")).alias("http"), dates.stamp(F.col("ts")).alias("stamp"))
    return made.select("event_id", "http", "stamp", dates.from_http_date(F.col("http")).alias("back"), dates.unmodified(F.col("ts"), F.col("http")).alias("unmodified"))
