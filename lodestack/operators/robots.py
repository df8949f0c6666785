"""Robots rules: parsing and deciding, for many hosts at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import urls
from lodestack.operators import ranges
from lodestack.sources.staging import staged


#: What ``parse`` gives.
RULES = "host string, agent string, pos int, flag string, prefix string"


def files(answers: DataFrame) -> DataFrame:
    """``host, body`` of the rule files among ``answers``: those of ``/robots.txt`` that came with status 200."""
    found = answers.where((urls.path_of(F.col("url")) == "/robots.txt") & (F.col("status") == 200) & F.col("page").isNotNull())
    return found.select(urls.host(F.col("url")).alias("host"), F.col("page").alias("body"))


def fetched(fetch: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """What a crawl asks for the rule files of hosts: ``/robots.txt`` of each, by the fetch that it gets its pages with. A host without one has no rules."""
    return lambda hosts: files(fetch(hosts.select(F.concat("host", F.lit("/robots.txt")).alias("url"))))


def parse(files: DataFrame) -> DataFrame:
    """``host, agent, pos, flag, prefix`` from ``files(host, body)``, in lower case and file order.

    A rule belongs to the latest user-agent line above it; rules before any
    are ignored. The value is the text between the first and the second colon.
    """
    lines = files.select("host", F.posexplode(F.split(F.lower("body"), r"[\r\n]+")).alias("pos", "line"))
    above = Window.partitionBy("host").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.trim(F.coalesce(F.try_element_at(F.split("line", ":"), F.lit(2)), F.lit("")))
    named = lines.withColumn("agent", F.last(F.when(F.col("line").startswith("user-agent"), value), ignorenulls=True).over(above))
    flag = F.when(F.col("line").startswith("allow"), "allow").when(F.col("line").startswith("disallow"), "disallow")
    return named.select("host", "agent", "pos", flag.alias("flag"), value.alias("prefix")).where("flag is not null and agent is not null")


def decide(pages: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """``pages`` with ``allowed``.

    The first rule whose prefix starts the path decides, the agent's own rules
    before those for ``*``; without one the page is allowed. Rules whose value
    does not start with a slash are skipped.

    A rule is a range of paths: a range join finds the rules of each path of a
    host once, by stretches of sorted paths, so a host with most of the pages
    is decided by many tasks and no page carries its host's rules. The pages join what was found.
    """
    own = F.when(F.col("agent") == agent.lower(), 0).otherwise(1)
    usable = rules.where(F.col("agent").isin(agent.lower(), "*") & F.col("prefix").startswith("/") & F.col("flag").isin("allow", "disallow"))
    # The number of a rule orders the rules of a host, and its last bit says what the rule does.
    number = F.shiftleft(F.shiftleft(own.cast("long"), 32) + F.col("pos"), 1) + F.when(F.col("flag") == "allow", 1).otherwise(0)
    low, high = ranges.prefix_range(F.col("prefix"))
    first = usable.groupBy("host", "prefix").agg(F.min(number).alias("id"))
    spans = first.select(F.col("host").alias("key"), low.alias("low"), high.alias("high"), "id")
    placed = pages.withColumn("_host", urls.host(F.col(url))).withColumn("_path", urls.path_of(F.col(url)).cast("binary"))
    asked = placed.select(F.col("_host").alias("key"), F.col("_path").alias("value")).distinct()
    decided = staged(ranges.range_pairs(asked, spans).groupBy("key", "value").agg(F.min("id").alias("_rule")))
    joined = placed.join(decided.withColumnsRenamed({"key": "_host", "value": "_path"}).hint("merge"), ["_host", "_path"], "left")
    return joined.select(*pages.columns, F.coalesce(F.col("_rule").bitwiseAND(1) == 1, F.lit(True)).alias("allowed"))


def banned(decided: DataFrame, url: str = "url") -> DataFrame:
    """``row_key, url, banned`` of the pages that are not allowed."""
    return decided.where(~F.col("allowed")).select(urls.row_key(F.col(url)).alias("row_key"), F.col(url).alias("url"), F.lit("True").alias("banned"))
