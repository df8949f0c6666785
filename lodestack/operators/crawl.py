"""Breadth-first crawling of a stored or live web, one DataFrame plan a round."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import urls
from lodestack.operators import robots
from lodestack.operators.seen import SeenSet
from lodestack.sources.staging import staged

REDIRECTS = (301, 307, 308)
#: What a fetch answers.
ANSWER = "url string, status int, content_type string, content_length long, location string, page string, fetched timestamp"
#: Rounds whose tables are read side by side before they become one.
MERGED = 50


def links(pages: DataFrame, url: str = "url", html: str = "page") -> DataFrame:
    """``source, target`` of every followed link, repeats included; a link that cannot be resolved is dropped alone."""
    found = pages.select(F.col(url).alias("source"), F.explode(urls.anchors(F.col(html))).alias("anchor")).select("source", urls.href(F.col("anchor")).alias("href")).where("href is not null")
    return found.select("source", urls.resolve(F.col("source"), F.col("href")).alias("target")).where(urls.followed(F.col("target")))


def redirects(answers: DataFrame) -> DataFrame:
    """``source, target`` of the redirects."""
    moved = answers.where(F.col("status").isin(*REDIRECTS) & F.col("location").isNotNull())
    return moved.select(F.col("url").alias("source"), urls.resolve(F.col("url"), F.col("location")).alias("target")).where("target is not null")


def schedule(frontier: DataFrame, per_host: int = 1) -> DataFrame:
    """``frontier`` with ``host`` and ``slot``: the round, counted from 0, in which politeness lets a URL be fetched (``per_host`` each round).

    URLs are ranked by host in their order. The whole frontier is sorted by
    range, and each task ranks the stretch of a host that it holds; what the
    stretches before it hold is added, one row for each host and stretch. So
    one host with most of the frontier is ranked by many tasks.
    """
    hosted = frontier.withColumn("host", urls.host(F.col("url")))
    placed = staged(hosted.repartitionByRange("host", "url").withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("host", "_part").agg(F.count("*").alias("_held"))
    earlier = Window.partitionBy("host").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(sizes.withColumn("_start", F.coalesce(F.sum("_held").over(earlier), F.lit(0))).drop("_held"))
    within = Window.partitionBy("host", "_part").orderBy("url")
    ranked = placed.withColumn("_n", F.row_number().over(within)).join(starts.hint("merge"), ["host", "_part"])
    return ranked.select(*frontier.columns, "host", F.floor((F.col("_start") + F.col("_n") - 1) / per_host).cast("int").alias("slot"))


def deduplicated(pages: DataFrame, url: str = "url", html: str = "page", order: str = "round") -> DataFrame:
    """``pages`` with ``content_hash`` and ``canonical_url``: the first page (by ``order``, url) of the same content; null on that page itself.

    The first page is a partial aggregate by content; contents of several pages are
    staged and joined back, so the pages of a content that a third of all share
    are a plain shuffle and can be split.
    """
    hashed = pages.withColumn("content_hash", urls.row_key(F.col(html)))
    first = hashed.where("content_hash is not null").groupBy("content_hash").agg(F.min(F.struct(F.col(order).alias("o"), F.col(url).alias("u")))["u"].alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return hashed.join(staged(first).hint("merge"), "content_hash", "left").withColumn("canonical_url", F.when(F.col("_first") != F.col(url), F.col("_first"))).drop("_first")


def crawl_rows(answers: DataFrame) -> DataFrame:
    """The stored form of a crawl: metadata of every answer, the page only where its content is new HTML.

    ``contentLength`` is what the answer's header said (null if it said
    nothing), ``TimeStamp`` when the page was fetched, of successful HTML
    answers alone.
    """
    html = (F.col("status") == 200) & F.coalesce(F.col("content_type").startswith("text/html"), F.lit(False))
    known = deduplicated(answers.withColumn("page", F.when(html, F.col("page"))))
    return known.select(
        urls.row_key(F.col("url")).alias("row_key"),
        "url",
        "round",
        F.col("status").alias("responseCode"),
        F.col("content_type").alias("contentType"),
        F.col("content_length").alias("contentLength"),
        F.when(F.col("canonical_url").isNull(), F.col("page")).alias("page"),
        F.col("canonical_url").alias("canonicalURL"),
        F.when(F.col("page").isNotNull(), F.col("fetched")).alias("TimeStamp"),
    )


class _Log:
    """A table that grows by parts, each staged as it comes; its parts become one when they are many, so plans stay small."""

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self.empty, self.parts = spark.createDataFrame([], schema), []

    def add(self, rows: DataFrame) -> DataFrame:
        part = staged(rows)
        self.parts.append(part)
        if len(self.parts) == MERGED:
            self.parts = [staged(self.read())]
        return part

    def read(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts, self.empty)


def crawl(
    spark: SparkSession,
    seeds: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    rules: DataFrame | None = None,
    agent: str = "*",
    max_rounds: int | None = None,
    per_host: int | None = None,
    robots_of: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(crawl rows, banned rows) of everything reachable from ``seeds(url)``.

    ``fetch`` turns a frontier ``(url)`` into answers (``sources.web.SCHEMA``).
    Each round drops the URLs seen before, asks the robots rules, fetches, and
    resolves redirects and links into the next frontier, until that is empty.
    The rules are ``rules`` (``robots.parse``), or those that ``robots_of``
    gives for a table of hosts: it is asked once for each host, when the crawl
    first meets it. With ``per_host``, URLs beyond it wait for later rounds.

    What a round adds (answers, refusals, rules) is staged and
    appended, nothing is written twice but for a merge every ``MERGED`` rounds.
    URLs seen are a ``SeenSet``: a round looks up only those of its links that the set's
    filter does not know as new, in their buckets. The driver holds that filter and counts. A crawl that is not over after ``max_rounds``
    raises ``RuntimeError``.
    """
    frontier = staged(seeds.select(urls.seed(F.col("url")).alias("url")).distinct())
    seen, done = SeenSet(spark), _Log(spark, f"{ANSWER}, round int")
    banned, known, hosts = _Log(spark, "row_key string, url string, banned string"), _Log(spark, robots.RULES), _Log(spark, "host string")
    for n in count():
        left = frontier.limit(1).count()
        if not left:
            break
        if max_rounds is not None and n >= max_rounds:
            raise RuntimeError(f"{frontier.count()} URLs are left to crawl after {max_rounds} rounds")
        if robots_of is not None:
            new = hosts.add(frontier.select(urls.host(F.col("url")).alias("host")).distinct().join(hosts.read(), "host", "left_anti"))
            known.add(robots.parse(robots_of(new)))
            rules = known.read()
        allowed = frontier
        if rules is not None:
            checked = staged(robots.decide(frontier, rules, agent))
            banned.add(robots.banned(checked))
            allowed = checked.where("allowed").select("url")
        now, later = allowed, None
        if per_host is not None:
            slots = staged(schedule(allowed, per_host).select("url", "slot"))
            now, later = slots.where("slot = 0").select("url"), slots.where("slot > 0").select("url")
        answers = done.add(fetch(now).withColumn("round", F.lit(n)))
        seen.add(frontier if later is None else staged(frontier.join(later, "url", "left_anti")))
        found = seen.unseen(links(answers.where("status = 200")).unionByName(redirects(answers)).select(F.col("target").alias("url")).distinct())
        frontier = staged(found if later is None else found.unionByName(later).distinct())
    return crawl_rows(done.read()), banned.read()


def stored(web: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetch that looks URLs up in a stored web."""
    return lambda frontier: frontier.join(web, "url").select("url", "status", "content_type", "content_length", "location", "page", "fetched")
