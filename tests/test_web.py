"""URLs, links, robots rules and crawls."""

import inspect

import pytest
from pyspark.sql import functions as F

from lodestack.functions import urls
from lodestack.operators import crawl, robots
from lodestack.plans import web as web_plans
from lodestack.sources import web


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first().v


BASE = "https://foo.example:8000/bar/xyz.html"


@pytest.mark.parametrize(
    ("base", "link", "want"),
    [
        (BASE, "#abc", BASE),
        (BASE, "blah.html#test", "https://foo.example:8000/bar/blah.html"),
        (BASE, "../blubb/123.html", "https://foo.example:8000/blubb/123.html"),
        (BASE, "/one/two.html", "https://foo.example:8000/one/two.html"),
        (BASE, "http://elsewhere.example/some.html", "http://elsewhere.example:80/some.html"),
        ("https://foo.example:443/bar/xyz.html", "a/b.html", "https://foo.example:443/bar/a/b.html"),
        ("https://foo.example:443/bar/xyz.html", "/123.html", "https://foo.example:443/123.html"),
        (BASE, "http://foo.example", "http://foo.example:80/"),
        (BASE, "http://foo.example/a#b", "http://foo.example:80/a#b"),
        (BASE, "../../../x", None),
        (BASE, "sub/./a//b/", "https://foo.example:8000/bar/sub/./a//b"),
        (BASE, "..", "https://foo.example:8000/"),
        (BASE, None, None),
    ],
)
def test_resolve(spark, base, link, want):
    assert one(spark, urls.resolve(F.col("b"), F.col("l")), b=base, l=link) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("Start.Example", "http://start.example:80/"), ("http://simple.example/", "http://simple.example:80/"), ("https://A.example/B", "https://a.example:443/b/"), ("http://a.example:81", "http://a.example:81/")],
)
def test_seed(spark, text, want):
    assert one(spark, urls.seed(F.col("u")), u=text) == want
    assert one(spark, urls.with_port(F.col("u")), u=want) == want


def test_url_parts(spark):
    of = lambda u: tuple(one(spark, urls.parts(F.col("u")), u=u))
    assert of("http://a.example:80/x?y") == ("http", "a.example", "80", "/x?y")
    assert of("https://a.example") == ("https", "a.example", None, "/")
    assert of("/only/path") == (None, None, None, "/only/path") and of("//x/y") == (None, None, None, "//x/y")


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<a href="/U.html">his!"He</a>', ["/U.html"]), ('<A HREF="/x" href="/y">t</A>', ["/y"]), ('<a href="d"></a>', []), ("<a href='c'>u</a>", [""]), ("<a name=x>u</a>", [None]),
        ('<a href="1">a</a><a href="2">b</a>', ["1", "2"]), ('<a href="1">a\nb</a>', []), (None, None),
    ],
)
def test_anchors(spark, html, want):
    got = one(spark, F.transform(urls.anchors(F.col("h")), urls.href), h=html)
    assert got == want


def test_followed(spark):
    for url, want in [("http://a/x.html", True), ("https://a/x.JPG", True), ("http://a/x.jpg", False), ("ftp://a/x", False), ("http://a/robots.txt", False)]:
        assert one(spark, urls.followed(F.col("u")), u=url) is want


def test_row_key(spark):
    assert one(spark, urls.row_key(F.col("u")), u="http://a.example:80/") == one(spark, F.translate(F.base64(F.unhex(F.sha1("u"))), "/", "@"), u="http://a.example:80/")
    assert "/" not in one(spark, urls.row_key(F.col("u")), u="7")


@pytest.mark.parametrize(
    ("rules", "path", "want"),
    [
        ("Allow: /abc\nDisallow: /a", "/abcdef", True), ("Allow: /abc\nDisallow: /a", "/xyz", True), ("Allow: /abc\nDisallow: /a", "/alpha", False),
        ("Disallow: /a\nallow: /abc", "/abcdef", False), ("Disallow: /a\nallow: /abc", "/xyz", True), ("Disallow:", "/alpha", True), ("", "/abcdef", True), ("Disallow: *", "/x", True),
    ],
)
def test_robots(spark, rules, path, want):
    files = spark.createDataFrame([("http://h:80", f"User-Agent: Mine\r\n{rules}")], "host string, body string")
    pages = spark.createDataFrame([("http://h:80" + path,)], "url string")
    assert robots.decide(pages, robots.parse(files), "MINE").first().allowed is want


def test_own_rules_come_first(spark):
    body = "Disallow: /orphan\nUser-agent: *\nDisallow: /\nUser-agent: mine\nAllow: /ok\nUser-agent: other\nDisallow: /ok"
    rules = robots.parse(spark.createDataFrame([("http://h:80", body)], "host string, body string"))
    pages = spark.createDataFrame([("http://h:80/ok/1",), ("http://h:80/no",), ("http://else:80/no",)], "url string")
    decided = robots.decide(pages, rules, "mine")
    assert {r.url: r.allowed for r in decided.collect()} == {"http://h:80/ok/1": True, "http://h:80/no": False, "http://else:80/no": True}
    assert [r.url for r in robots.banned(decided).collect()] == ["http://h:80/no"]


SITE = "http://mini.example:80/"

#: A small web: a redirect that is followed and one that is not, a page behind robots rules, a copy, a page nothing links to.
MINI = {
    "": '<a href="/b">b</a> <a href="c">c</a>',
    "b": '<a href="/">a</a><a href="/d#x">d</a>',
    "c": '<a href="f">f</a><a href="g">g</a><a href="h">h</a><a href="x.jpg">x</a>',
    "d": "same",
    "e": "never",
    "g": "hidden",
    "h": "same",
}


def mini_web(spark):
    pages = web.from_pages(spark.createDataFrame([(SITE + k, v) for k, v in MINI.items()], "url string, html string"))
    moved = [(SITE + "f", 301, None, 7, "/", None, None), (SITE + "i", 302, None, None, "/", None, None)]
    rules = [(SITE + "robots.txt", 200, "text/plain", None, None, "User-agent: *\nDisallow: /g\n", None)]
    return pages.unionByName(spark.createDataFrame(moved + rules, web.SCHEMA))


def mini_rules(spark):
    return robots.parse(spark.createDataFrame([("http://mini.example:80", "User-agent: *\nDisallow: /g\n")], "host string, body string"))


def test_crawl(spark):
    start = spark.createDataFrame([("mini.example",)], "url string")
    rows, banned = crawl.crawl(spark, start, crawl.stored(mini_web(spark)), mini_rules(spark))
    got = {r.url.removeprefix(SITE): r for r in rows.collect()}
    assert {k: r.round for k, r in got.items()} == {"": 0, "b": 1, "c": 1, "d": 2, "f": 2, "h": 2}
    assert got["h"].canonicalURL == SITE + "d" and got["h"].page is None and got["d"].page == "same" and got["f"].responseCode == 301
    assert [r.url for r in banned.collect()] == [SITE + "g"]
    assert got["b"].contentLength == len(MINI["b"]) and got["f"].contentLength == 7 and str(got["b"].TimeStamp) == "2024-01-01 00:00:00" and got["f"].TimeStamp is None
    fetch = crawl.stored(mini_web(spark))
    again, refused = crawl.crawl(spark, start, fetch, robots_of=robots.fetched(fetch))
    assert {r.url for r in again.collect()} == {r.url for r in rows.collect()} and [r.url for r in refused.collect()] == [SITE + "g"]


def test_crawl_with_politeness_visits_the_same(spark):
    start = spark.createDataFrame([("mini.example",)], "url string")
    rows, _ = crawl.crawl(spark, start, crawl.stored(mini_web(spark)), mini_rules(spark), per_host=1)
    got = {r.url.removeprefix(SITE): r.round for r in rows.collect()}
    assert set(got) == {"", "b", "c", "d", "f", "h"} and len(set(got.values())) == 6
    none, _ = crawl.crawl(spark, start.limit(0), crawl.stored(mini_web(spark)))
    assert none.collect() == []


def test_crawl_ends_only_when_nothing_is_left(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(crawl, "MERGED", 3, raising=False)
    site = "http://chain.example:80/"
    pages = spark.createDataFrame([(k, f"{site}{k or ''}", f'<a href="/{k + 1}">x</a>') for k in range(5)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = web_plans.crawl_pages(spark, str(tmp_path)).collect()
    assert {r.url.removeprefix(site) for r in got} == {"", "1", "2", "3", "4"}


def test_crawl_tells_what_a_limit_leaves(spark):
    start = spark.createDataFrame([("mini.example",)], "url string")
    with pytest.raises(RuntimeError, match="2 URLs are left"):
        crawl.crawl(spark, start, crawl.stored(mini_web(spark)), max_rounds=1)
    assert inspect.signature(crawl.crawl).parameters["max_rounds"].default is None


def test_a_host_with_all_urls_is_ranked_by_many_tasks(spark):
    many = spark.range(40_000).select(F.format_string("http://one.example:80/%06d", F.col("id")).alias("url"), F.lit("clash").alias("n")).repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = crawl.schedule(many, 3)
        assert got.where("slot <> floor(cast(substring(url, -6) as int) / 3)").count() == 0 and got.count() == 40_000
        held = got.groupBy(F.spark_partition_id()).count().collect()
        assert len(held) > 1 and max(r["count"] for r in held) < 30_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_schedule_and_redirects(spark):
    urls_ = spark.createDataFrame([("http://a:80/1",), ("http://a:80/2",), ("http://a:80/3",), ("http://b:80/1",)], "url string")
    assert sorted((r.url, r.slot) for r in crawl.schedule(urls_, 2).collect()) == [("http://a:80/1", 0), ("http://a:80/2", 0), ("http://a:80/3", 1), ("http://b:80/1", 0)]
    assert [r.target for r in crawl.redirects(mini_web(spark)).collect()] == [SITE]


def test_live_fetch(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):
            asked.append((self.command, self.path))
            self.send_response({"/r": 301, "/e": 404}.get(self.path, 200))
            self.send_header("Content-Type", "text/html")
            self.send_header("Content-Length", "2")
            if self.path == "/r":
                self.send_header("Location", "/ok")
            self.end_headers()

        def do_GET(self):
            self.do_HEAD()
            self.wfile.write("é".encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    frontier = spark.createDataFrame([(f"{at}/ok",), (f"{at}/r",), (f"{at}/e",), ("http://127.0.0.1:9/",)], "url string")
    got = {r.url.removeprefix(at): (r.status, r.location, r.page, r.content_length) for r in web.fetch(frontier, "test", 2).collect()}
    server.shutdown()
    assert got == {"/ok": (200, None, "é", 2), "/r": (301, "/ok", None, 2), "/e": (404, None, None, 2)}
    assert sorted(asked) == [("GET", "/ok"), ("HEAD", "/e"), ("HEAD", "/ok"), ("HEAD", "/r")]
