"""Queries over URLs, links, robots rules and crawls."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import urls
from lodestack.operators import crawl, robots
from lodestack.sources import web
from lodestack.sources.tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _host(u: str) -> str:
    return f"regexp_extract({u}, '^([^/]*//[^/]*)', 1)"


def _ported(u: str) -> str:
    rest = f"substr({u}, length({_host(u)}) + 1)"
    port = f"CASE WHEN regexp_matches({_host(u)}, ':[0-9]+$') THEN '' WHEN starts_with({u}, 'https') THEN ':443' ELSE ':80' END"
    return f"{_host(u)} || {port} || CASE WHEN {rest} = '' THEN '/' ELSE {rest} END"


_SEED = "SELECT url, CASE WHEN ends_with(f, '/') THEN f ELSE f || '/' END AS s FROM (SELECT url, CASE WHEN starts_with(lower(url), 'http') THEN lower(url) ELSE 'http://' || lower(url) END AS f FROM pages)"
_BASE = f"SELECT page_id, {_ported('url')} AS base, html FROM pages"
_ANCHORS = f"SELECT page_id, base, unnest(regexp_extract_all(html, '(?i)(<a[^>]+>.+?</a>)', 1)) AS anchor FROM ({_BASE})"
_HREFS = f"""SELECT page_id, base, regexp_extract(anchor, '(?s)href[^"]*"([^"]*)', 1) AS href FROM ({_ANCHORS}) WHERE contains(anchor, 'href')"""
_CUT = r"regexp_replace(href, '(?s)#.*$', '')"
#: Links of the stored pages are absolute, rooted, or below the page's folder without climbing.
_FULL = f"SELECT page_id, base, href, CASE WHEN {_CUT} = '' AND contains(href, '#') THEN base WHEN starts_with({_CUT}, 'http') THEN href WHEN starts_with({_CUT}, '/') THEN {_host('base')} || {_CUT} ELSE regexp_replace(regexp_extract(base, '(?s)^(.*/)', 1) || {_CUT}, '/+$', '') END AS u FROM ({_HREFS})"
_TARGETS = f"SELECT page_id, base AS source, href, {_ported('u')} AS target FROM ({_FULL})"


def _pages(spark, d):
    return read(spark, d, "pages").select("page_id", urls.with_port(F.col("url")).alias("url"), "html")


@query(f"SELECT url, {_ported('s')} AS seed, {_ported('url')} AS ported FROM ({_SEED})")
def url_normalize(spark, d):
    return read(spark, d, "pages").select("url", urls.seed(F.col("url")).alias("seed"), urls.with_port(F.col("url")).alias("ported"))


@query(f"SELECT url, {_host('url')} AS host FROM pages")
def url_host(spark, d):
    return read(spark, d, "pages").select("url", urls.host(F.col("url")).alias("host"))


@query(r"""
SELECT url, substr(url, 1, instr(url, '//') - 2) AS scheme, split_part(a, ':', 1) AS host, nullif(split_part(a, ':', 2), '') AS port, p AS path
FROM (SELECT url, regexp_extract(url, '//([^/]*)', 1) AS a, coalesce(nullif(regexp_extract(url, '//[^/]*(/.*)$', 1), ''), '/') AS p FROM pages)
""")
def url_parts(spark, d):
    return read(spark, d, "pages").select("url", urls.parts(F.col("url")).alias("p")).select("url", "p.scheme", "p.host", "p.port", "p.path")


@query("SELECT url, replace(to_base64(unhex(sha1(url))), '/', '@') AS row_key FROM pages")
def url_hash(spark, d):
    return read(spark, d, "pages").select("url", urls.row_key(F.col("url")).alias("row_key"))


@query(f"SELECT page_id, href, count(*) AS n FROM ({_HREFS}) GROUP BY ALL")
def link_extract(spark, d):
    anchors = read(spark, d, "pages").select("page_id", F.explode(urls.anchors(F.col("html"))).alias("a"))
    return anchors.select("page_id", urls.href(F.col("a")).alias("href")).where("href is not null").groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT source, href, target FROM ({_TARGETS})")
def link_resolve(spark, d):
    hrefs = _pages(spark, d).select(F.col("url").alias("source"), F.explode(urls.anchors(F.col("html"))).alias("a")).select("source", urls.href(F.col("a")).alias("href")).where("href is not null").distinct()
    return hrefs.select("source", "href", urls.resolve(F.col("source"), F.col("href")).alias("target"))


@query(f"SELECT source, target FROM ({_TARGETS}) WHERE regexp_matches(target, '^https?://') AND NOT regexp_matches(target, '[.](jpg|jpeg|gif|png|txt)$')")
def link_filter(spark, d):
    return crawl.links(_pages(spark, d), html="html")


@query("""
WITH h AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS url, doc_id % 7 AS round, replace(to_base64(unhex(sha1(text))), '/', '@') AS content_hash FROM documents),
     f AS (SELECT content_hash, arg_min(url, (round, url)) AS u FROM h GROUP BY ALL)
SELECT h.doc_id, h.content_hash, CASE WHEN u <> url THEN u END AS canonical_url FROM h JOIN f USING (content_hash)
""")
def content_dedup(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("url"), (F.col("doc_id") % 7).alias("round"), "text")
    return crawl.deduplicated(docs, html="text").select("doc_id", "content_hash", "canonical_url")


#: Every host has a rule file of its own, made of the least and the greatest path that it has.
_PATHS = f"SELECT page_id, u, h, substr(u, length(h) + 1) AS p FROM (SELECT page_id, u, {_host('u')} AS h FROM (SELECT page_id, {_ported('url')} AS u FROM pages))"
_ENDS = f"SELECT h, lower(min(p)) AS lo, lower(max(p)) AS hi FROM ({_PATHS}) GROUP BY h"
_DECIDED = f"""SELECT page_id, u, CASE WHEN starts_with(p, lo[:5]) THEN true WHEN starts_with(p, hi[:5]) THEN false WHEN starts_with(p, lo[:2]) THEN false ELSE true END AS allowed
  FROM ({_PATHS}) JOIN ({_ENDS}) USING (h)"""


def _rule_files(pages):
    path = urls.path_of(F.col("url"))
    ends = pages.groupBy(urls.host(F.col("url")).alias("host")).agg(F.min(path).alias("lo"), F.max(path).alias("hi"))
    cut = lambda name, n: F.substring(name, 1, n)
    lines = ["User-agent: other", "Disallow: /", "User-agent: *", F.concat(F.lit("Disallow: "), cut("lo", 2)), "User-agent: Lodebot"]
    lines += [F.concat(F.lit("Allow: "), cut("lo", 5)), F.concat(F.lit("Disallow: "), cut("hi", 5)), "Disallow:", ""]
    return ends.select("host", F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines]).alias("body"))


def _decided(spark, d):
    pages = _pages(spark, d).select("page_id", "url")
    return robots.decide(pages, robots.parse(_rule_files(pages)), "lodebot")


@query(f"SELECT page_id, u AS url, allowed FROM ({_DECIDED})")
def robots_decide(spark, d):
    return _decided(spark, d)


@query(f"SELECT replace(to_base64(unhex(sha1(u))), '/', '@') AS row_key, u AS url, 'True' AS banned FROM ({_DECIDED}) WHERE NOT allowed")
def banned(spark, d):
    return robots.banned(_decided(spark, d))


@query(f"""
SELECT h AS host, agent, CAST(pos AS INTEGER) AS pos, flag, CASE n WHEN 0 THEN '/' WHEN 1 THEN lo[:2] WHEN 2 THEN lo[:5] WHEN 3 THEN hi[:5] ELSE '' END AS prefix FROM ({_ENDS}),
  (VALUES ('other', 1, 'disallow', 0), ('*', 3, 'disallow', 1), ('lodebot', 5, 'allow', 2), ('lodebot', 6, 'disallow', 3), ('lodebot', 7, 'disallow', 4)) r(agent, pos, flag, n)
""")
def robots_parse(spark, d):
    return robots.parse(_rule_files(_pages(spark, d)))


@query(f"SELECT u AS url, h AS host, CAST(row_number() OVER (PARTITION BY h ORDER BY u) - 1 AS INTEGER) AS slot FROM (SELECT DISTINCT u, {_host('u')} AS h FROM (SELECT {_ported('url')} AS u FROM pages))")
def crawl_schedule(spark, d):
    return crawl.schedule(_pages(spark, d).select("url").distinct())


#: A small web: two redirects, a page behind robots rules, a copy, a page nothing links to.
_MINI = (
    ("", '<a href="/b">b</a> <a href="c">c</a>'), ("b", '<a href="/">a</a><a href="/d#x">d</a>'), ("c", '<a href="f">f</a><a href="g">g</a><a href="h">h</a><a href="x.jpg">x</a>'),
    ("d", "same"), ("e", "never"), ("g", "hidden"), ("h", "same"),
)
_SITE = "http://mini.example:80/"


def mini_web(spark):
    pages = web.from_pages(spark.createDataFrame([(_SITE + k, v) for k, v in _MINI], "url string, html string"))
    moved = spark.createDataFrame([(_SITE + "f", 301, None, "/", None), (_SITE + "i", 302, None, "/", None)], web.SCHEMA)
    return pages.unionByName(moved)


def mini_rules(spark):
    return robots.parse(spark.createDataFrame([("http://mini.example:80", "User-agent: *\nDisallow: /g\n")], "host string, body string"))


#: Links of a page of the large web below.
FAN = 16


def page_web(pages):
    """A web of the stored pages, on five hosts: page n links to the pages from 16 n + 1 to 16 n + 16.

    Every eleventh is a redirect to the next page, every seventh one of three
    texts without links, and host 3 has rules.
    """
    address = lambda n: F.when(n == 0, "http://h0.example:80/").otherwise(F.concat(F.lit("http://h"), (n % 5).cast("string"), F.lit(".example:80/p"), n.cast("string")))
    n = F.col("page_id")
    anchors = F.array_join(F.transform(F.sequence(n * FAN + 1, n * FAN + FAN), lambda k: F.concat(F.lit('<a href="'), address(k), F.lit('">next</a>'))), "")
    html = F.when(n % 7 == 6, F.concat(F.lit("copy "), (n % 3).cast("string"))).otherwise(F.concat(F.coalesce("html", F.lit("")), anchors))
    moved = n % 11 == 10
    return pages.select(
        address(n).alias("url"),
        F.when(moved, 301).otherwise(200).alias("status"),
        F.lit("text/html").alias("content_type"),
        F.octet_length(html).cast("long").alias("content_length"),
        F.when(moved, address(n + 1)).alias("location"),
        F.when(~moved, html).alias("page"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetched"),
    )


def _address(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 'http://h0.example:80/' ELSE 'http://h' || {n} % 5 || '.example:80/p' || {n} END"


_RULE = "User-agent: *\nDisallow: /p1\n"
_WALK = f"""
WITH RECURSIVE node AS (SELECT page_id AS n, page_id % 11 = 10 AS moved, page_id % 7 = 6 AS leaf FROM pages WHERE NOT (page_id % 5 = 3 AND starts_with(CAST(page_id AS VARCHAR), '1'))),
edge AS (
  SELECT n AS a, n + 1 AS b FROM node WHERE moved
  UNION ALL SELECT n, unnest(range(n * {FAN} + 1, n * {FAN} + {FAN + 1})) FROM node WHERE NOT moved AND NOT leaf
), walk(n, r) AS (
  SELECT n, 0 FROM node WHERE n = 0 UNION SELECT b, r + 1 FROM walk JOIN edge ON walk.n = a
), first AS (SELECT {_address('n')} AS url, n, min(r) AS r FROM walk GROUP BY n), met AS (SELECT * FROM first JOIN node USING (n))
"""


def _crawled_pages(spark, d):
    pages = page_web(read(spark, d, "pages"))
    rule = spark.createDataFrame([("http://h3.example:80/robots.txt", 200, "text/plain", None, None, _RULE, None)], web.SCHEMA)
    fetch = crawl.stored(pages.unionByName(rule))
    start = read(spark, d, "pages").where("page_id = 0").select(F.lit("http://H0.example/").alias("url"))
    return crawl.crawl(spark, start, fetch, robots_of=robots.fetched(fetch))


@query(f"""{_WALK}, html AS (SELECT met.*, CASE WHEN moved THEN NULL WHEN leaf THEN 'copy ' || n % 3 ELSE 'own ' || n END AS body FROM met),
  canon AS (SELECT body, arg_min(url, (r, url)) AS c FROM html WHERE leaf AND NOT moved GROUP BY body)
SELECT url, CAST(r AS INTEGER) AS round, CAST(CASE WHEN moved THEN 301 ELSE 200 END AS INTEGER) AS "responseCode", NOT moved AND coalesce(c, url) = url AS has_page,
  CASE WHEN NOT moved AND c <> url THEN c END AS "canonicalURL", CASE WHEN NOT moved THEN TIMESTAMP '2024-01-01' END AS "TimeStamp" FROM html LEFT JOIN canon USING (body)
""")
def crawl_bfs(spark, d):
    """The web of all stored pages, from its root: rules, redirects, copies."""
    return _crawled_pages(spark, d)[0].select("url", "round", "responseCode", F.col("page").isNotNull().alias("has_page"), "canonicalURL", "TimeStamp")


@query(f"{_WALK} SELECT replace(to_base64(unhex(sha1(url))), '/', '@') AS row_key, url, 'True' AS banned FROM first WHERE n % 5 = 3 AND starts_with(CAST(n AS VARCHAR), '1')")
def crawl_banned(spark, d):
    return _crawled_pages(spark, d)[1]


@query(f"SELECT {_address('page_id')} AS source, {_address('(page_id + 1)')} AS target FROM pages WHERE page_id % 11 = 10")
def redirects(spark, d):
    return crawl.redirects(page_web(read(spark, d, "pages")))


@query(f"SELECT DISTINCT {_ported('s')} AS url, CAST(200 AS INTEGER) AS \"responseCode\" FROM ({_SEED}) JOIN (SELECT {_ported('url')} AS u FROM pages) ON {_ported('s')} = u")
def crawl_pages(spark, d):
    """The whole crawl of the stored pages, with every page as a seed that is written as a start address is."""
    pages = web.from_pages(_pages(spark, d))
    rows, _ = crawl.crawl(spark, read(spark, d, "pages").select("url"), crawl.stored(pages))
    return rows.select("url", "responseCode").distinct()


#: What is climbed from each page: none, one or two folders, and for some more than there are.
_UP = "(page_id % 4)"


@query(f"""
WITH b AS (SELECT page_id, base, {_host('base')} AS h, list_filter(string_split(regexp_extract(substr(base, length({_host('base')}) + 1), '(?s)^(.*/)', 1), '/'), lambda x: x <> '') AS dirs FROM ({_BASE}))
SELECT page_id, base AS source, CASE WHEN {_UP} <= len(dirs) THEN h || '/' || array_to_string(dirs[:len(dirs) - {_UP}] || ['y' || page_id], '/') END AS target FROM b
""")
def url_dots(spark, d):
    """Links that climb out of the page's folder."""
    pages = _pages(spark, d)
    link = F.concat(F.lit("x/../"), F.repeat(F.lit("../"), (F.col("page_id") % 4).cast("int")), F.lit("y"), F.col("page_id").cast("string"))
    return pages.select("page_id", F.col("url").alias("source"), urls.resolve(F.col("url"), link).alias("target"))


@query(f"SELECT base AS source, {_host('base')} || '/ok' || page_id AS target FROM ({_BASE})")
def link_errors(spark, d):
    """A link that cannot be resolved goes alone; the page's other links stay."""
    made = F.concat(F.lit('<a href="' + "../" * 30 + 'up">u</a> <a href="/ok'), F.col("page_id").cast("string"), F.lit('">ok</a>'))
    return crawl.links(_pages(spark, d).select("url", made.alias("page")))
