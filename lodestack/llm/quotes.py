"""Quotation linking in conversations, with DataFrame functions alone.

A line that begins with ``>`` signs is quoted, as deep as it has signs.
Consecutive lines of one depth are a passage. Passages and their lines are
normalised (lower case, punctuation and white space to one space) and hashed;
so are the unquoted paragraphs and lines of every message. A quoted passage
belongs to the latest earlier message of its conversation that holds it as a
whole; or else to the one that holds most of its lines, which must be more than
half of them (the latest of several). A message answers the source of its
passages of depth one, and the message before it if it quotes nothing known.

Conversations of any length are cut into buckets of turns. What a bucket needs
from those before it (the last turn, the last holder of a line, the open
branch) is one row, so no task sees a whole conversation but for one row a
bucket. The order is worked out on ids alone; the texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Turns in one bucket of a conversation.
BUCKET = 512
_MARKS = r"^[ \t]*(?:>[ \t]?)+"
_SAID = r"(?i)^(on|am|le|el)\b.*\b(wrote|schrieb|écrit|escribió)\s*:\s*$"


def _depth(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Punct}]+", " "))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", -1)


def own_text(text: Column) -> Column:
    """The lines of a message that are not quoted, without the lines that introduce a quotation."""
    lines = _lines(text)
    keep = F.filter(lines, lambda line, i: (_depth(line) == 0) & ~(line.rlike(_SAID) & (_depth(F.coalesce(F.try_element_at(lines, i + 2), F.lit(""))) > 0)))
    joined = F.regexp_replace(F.array_join(keep, "\n"), r"\n{3,}", "\n\n")
    return F.when(F.coalesce(text, F.lit("")).rlike(r"(?m)^[ \t]*>"), F.regexp_replace(joined, r"^\s+|\s+$", "")).otherwise(F.coalesce(text, F.lit("")))


def quoted_passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, h, passage (number), depth, lines (normalised, in order) of the messages that quote."""
    quoting = messages.where(F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id", "turn", "h", "text").dropDuplicates(["conv_id", "turn", "h"])
    lines = quoting.select("conv_id", "turn", "h", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    lines = lines.select("conv_id", "turn", "h", "at", _depth(F.col("line")).alias("depth"), normal(F.regexp_replace("line", _MARKS, "")).alias("said"))
    by_message = Window.partitionBy("conv_id", "turn", "h").orderBy("at")
    marked = lines.withColumn("new", (F.col("depth") != F.coalesce(F.lag("depth").over(by_message), F.lit(-1))).cast("int"))
    numbered = marked.withColumn("passage", F.sum("new").over(by_message)).where("depth > 0 and said <> ''")
    return numbered.groupBy("conv_id", "turn", "h", "passage", "depth").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]).alias("lines"))


def originals(messages: DataFrame) -> DataFrame:
    """conv_id, turn, key of the unquoted text, paragraphs and lines of every message."""
    lines = F.filter(_lines(F.col("own")), lambda x: normal(x) != "")
    paragraphs = F.split("own", r"\n\s*\n")
    keys = F.array_distinct(F.transform(F.filter(F.concat(F.array("own"), paragraphs, lines), lambda x: normal(x) != ""), lambda x: F.xxhash64(normal(x))))
    return messages.select("conv_id", "turn", F.explode(keys).alias("key")).distinct()


def _bucket(turn: str) -> Column:
    return F.floor(F.col(turn) / BUCKET).cast("long")


def _held_before(held: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """For every ``keys, bucket`` of ``asked``: ``turns``, the turns of ``held(keys, at)`` within the bucket, and how many (``n_before``) and which last (``last_before``) there are before it."""
    spans = held.groupBy(*keys, _bucket("at").alias("bucket")).agg(F.collect_set("at").alias("turns"))
    every = spans.unionByName(asked.select(*keys, "bucket").distinct(), allowMissingColumns=True).groupBy(*keys, "bucket").agg(F.first("turns", ignorenulls=True).alias("turns"))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce("turns", F.array().cast("array<long>"))
    return every.select(*keys, "bucket", turns.alias("turns"), F.coalesce(F.sum(F.size(turns)).over(earlier), F.lit(0)).alias("n_before"), F.max(F.array_max("turns")).over(earlier).alias("last_before"))


def _sources(messages: DataFrame, passages: DataFrame) -> DataFrame:
    """conv_id, turn, h, passage, depth, n_lines, votes, source: the turn that each passage comes from, or null.

    The latest holders of the whole or of each line are counted first. A turn
    that holds more lines than the best of them, or as many and is later, and
    more than half of all, holds one of the passage's rarer lines too, so only
    the holders of those are counted besides: the result is that of counting
    every earlier turn.
    """
    ids = ["conv_id", "turn", "h", "passage"]
    whole = F.array(F.struct(F.xxhash64(F.array_join("lines", " ")).alias("key"), (F.size("lines") + 1).alias("weight"), F.lit(True).alias("whole")))
    probes = passages.select(*ids, F.size("lines").alias("n_lines"), F.explode(F.concat(whole, F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("key"), F.lit(1).alias("weight"), F.lit(False).alias("whole"))))).alias("p"))
    probes = scratch.table(probes.groupBy(*ids, "n_lines", "p.key", "p.whole").agg(F.sum("p.weight").alias("weight")).withColumn("bucket", _bucket("turn")))
    if not probes.limit(1).count():  # nothing is quoted
        return passages.select(*ids, "depth", F.size("lines").alias("n_lines"), F.lit(None).cast("long").alias("votes"), F.lit(None).cast("long").alias("source"))
    asked = scratch.table(probes.select("conv_id", "key").distinct()).hint("merge")  # staged, so that a common line's rows can be split
    held = scratch.table(originals(messages).join(asked, ["conv_id", "key"], "left_semi").select("conv_id", "key", F.col("turn").alias("source")))
    before = scratch.table(_held_before(held.select("conv_id", "key", F.col("source").alias("at")), probes, ["conv_id", "key"]))
    near = F.filter("turns", lambda t: t < F.col("turn"))
    found = probes.join(before.hint("merge"), ["conv_id", "key", "bucket"])
    found = found.withColumn("holders", F.col("n_before") + F.size(near)).withColumn("source", F.coalesce(F.array_max(near), "last_before")).where("source is not null")
    found = scratch.table(found.select(*ids, "n_lines", "key", "whole", "weight", "holders", "source"))

    def counted(turns: DataFrame) -> DataFrame:
        votes = turns.join(found.select(*ids, "key", "weight"), ids).join(held, ["conv_id", "key", "source"])
        return votes.groupBy(*ids, "source").agg(F.sum("weight").alias("votes"))

    latest = found.groupBy(*ids).agg(F.max(F.when(F.col("whole"), F.col("source"))).alias("as_whole"), F.collect_set("source").alias("by_line"))
    latest = latest.select(*ids, F.explode(F.when(F.col("as_whole").isNotNull(), F.array("as_whole")).otherwise(F.col("by_line"))).alias("source"))
    best = scratch.table(counted(latest).groupBy(*ids).agg(F.max(F.struct("votes", "source")).alias("best")))
    rarer = Window.partitionBy(*ids).orderBy("holders", "key").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rare = found.where("not whole").withColumn("most", F.sum("weight").over(rarer)).drop("source").join(best, ids).where("most >= best.votes and most * 2 > n_lines")
    rivals = rare.join(held, ["conv_id", "key"]).where("source < turn and (most > best.votes or source > best.source)").select(*ids, "source").distinct()
    best = best.unionByName(counted(rivals).select(*ids, F.struct("votes", "source").alias("best"))).groupBy(*ids).agg(F.max("best").alias("best"))
    placed = passages.join(best, ids, "left").withColumn("n_lines", F.size("lines"))
    enough = F.col("best.votes") * 2 > F.col("n_lines")
    return placed.select(*ids, "depth", "n_lines", F.when(enough, F.col("best.votes")).alias("votes"), F.when(enough, F.col("best.source")).alias("source"))


def linked_passages(conversations: DataFrame, **names: str) -> DataFrame:
    """Every quoted passage with the turn it comes from: ``conv_id, turn, passage, depth, n_lines, source``."""
    messages = _messages(conversations, **names)
    return _sources(messages, quoted_passages(messages)).select("conv_id", "turn", "passage", "depth", "n_lines", "source")


def _messages(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    src = scratch.columns(conversations, conv_id=conv_id, turn=turn, role=role, text=text)
    return src.withColumn("h", F.xxhash64("role", "text")).withColumn("own", own_text(F.col("text")))


def _prefixes(starts: DataFrame) -> DataFrame:
    """conv_id, first, prefix of every branch: where it hangs, from the root of its conversation.

    ``starts``: conv_id, first (turn of the branch), source (turn answered).
    Pointer doubling: rounds grow with the logarithm of the nesting.
    """
    asks = starts.withColumn("bucket", _bucket("source"))
    opened = _held_before(starts.select("conv_id", F.col("first").alias("at")), asks, ["conv_id"])
    near = F.filter("turns", lambda t: t <= F.col("source"))
    now = asks.join(opened.hint("merge"), ["conv_id", "bucket"]).withColumn("up", F.coalesce(F.array_max(near), "last_before"))
    now = scratch.table(now.select("conv_id", "first", "up", F.array("source", "first").alias("prefix")))
    while now.where("up is not null").limit(1).count():
        above = now.select("conv_id", F.col("first").alias("up"), F.col("up").alias("next"), F.col("prefix").alias("head"))
        now = scratch.table(now.join(above, ["conv_id", "up"], "left").select("conv_id", "first", F.col("next").alias("up"), F.concat(F.coalesce("head", F.array().cast("array<bigint>")), "prefix").alias("prefix")))
    return now.select("conv_id", "first", "prefix")


def _branched(turns: DataFrame, spans: DataFrame, starts: DataFrame) -> DataFrame:
    """conv_id, turn, prev, reply_path of every turn, given where branches start; a turn stands on the latest branch begun."""
    of_conv = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("conv_id", "bucket").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    branches = _prefixes(starts).withColumn("bucket", _bucket("first"))
    leaves = spans.join(branches.groupBy("conv_id", "bucket").agg(F.max(F.struct("first", "prefix"))["prefix"].alias("leaf")), ["conv_id", "bucket"], "left")
    carried = leaves.select("conv_id", "bucket", F.last("leaf", ignorenulls=True).over(of_conv).alias("carried"))
    opened = turns.join(branches.select("conv_id", F.col("first").alias("turn"), "prefix"), ["conv_id", "turn"], "left").withColumn("open", F.last("prefix", ignorenulls=True).over(upto))
    path = F.concat(F.coalesce("open", "carried", F.array().cast("array<bigint>")), F.array("turn"))
    return opened.join(carried, ["conv_id", "bucket"]).select("conv_id", "turn", "prev", path.alias("reply_path"))


def threads(conversations: DataFrame, **names: str) -> DataFrame:
    """Every message without its quotations, placed in its conversation's reply order.

    Returns ``conv_id, turn, role, own_text, n_quotes, n_linked, reply_to,
    reply_path``. Sorted by ``conv_id, reply_path`` a conversation reads in
    reply order: an answer to an earlier message, with what follows it, comes
    right after that message. ``reply_to`` is null for a first message.

    A null text is an empty message. Rows with equal ``conv_id`` and ``turn``
    are messages of one turn and share their place; repeated rows stay. Rows
    with a null ``conv_id`` or ``turn`` are alone: no links, no place (an empty
    path). Quotations of other conversations are not linked.
    """
    messages = _messages(conversations, **names)
    placed = messages.where("conv_id is not null and turn is not null")
    sources = scratch.table(_sources(placed, quoted_passages(placed)))
    firsts = F.max(F.when(F.col("depth") == 1, F.struct("votes", "source")))["source"]
    links = sources.groupBy("conv_id", "turn", "h").agg(F.count("*").alias("n_quotes"), F.count("source").alias("n_linked"), firsts.alias("answers"))

    in_bucket = Window.partitionBy("conv_id", "bucket").orderBy("turn")
    turns = scratch.table(placed.select("conv_id", "turn").distinct().withColumn("bucket", _bucket("turn")))
    spans = turns.groupBy("conv_id", "bucket").agg(F.max("turn").alias("last")).withColumn("before", F.lag("last").over(Window.partitionBy("conv_id").orderBy("bucket")))
    turns = turns.withColumn("prev", F.lag("turn").over(in_bucket)).join(spans.select("conv_id", "bucket", "before"), ["conv_id", "bucket"])
    turns = scratch.table(turns.select("conv_id", "turn", "bucket", F.coalesce("prev", "before").alias("prev")))

    answered = links.where("answers is not null").groupBy("conv_id", "turn").agg(F.max("answers").alias("answers"))
    starts = answered.join(turns, ["conv_id", "turn"]).where("answers <> prev").select("conv_id", F.col("turn").alias("first"), F.col("answers").alias("source"))
    starts = scratch.table(starts)
    if starts.limit(1).count():
        places = _branched(turns, spans, starts)
    else:  # every message answers the one before it
        places = turns.select("conv_id", "turn", "prev", F.array("turn").alias("reply_path"))

    none = F.lit(0).cast("long")
    about = placed.select("conv_id", "turn", "h").distinct().join(places, ["conv_id", "turn"]).join(links, ["conv_id", "turn", "h"], "left")
    about = about.select("conv_id", "turn", "h", F.coalesce("n_quotes", none).alias("n_quotes"), F.coalesce("n_linked", none).alias("n_linked"), F.coalesce("answers", "prev").alias("reply_to"), "reply_path")
    out = placed.join(scratch.table(about).hint("merge"), ["conv_id", "turn", "h"]).select("conv_id", "turn", "role", F.col("own").alias("own_text"), "n_quotes", "n_linked", "reply_to", "reply_path")
    alone = messages.where("conv_id is null or turn is null").select("conv_id", "turn", "role", F.col("own").alias("own_text"), none.alias("n_quotes"), none.alias("n_linked"), F.lit(None).cast("long").alias("reply_to"), F.array().cast("array<bigint>").alias("reply_path"))
    return out.unionByName(alone)


def ordered(messages: DataFrame) -> DataFrame:
    """The messages of ``threads`` in reply order."""
    return messages.orderBy("conv_id", "reply_path", "role", "own_text")


def digests(messages: DataFrame) -> DataFrame:
    return messages.select("conv_id", "turn", "role", "n_quotes", "n_linked", "reply_to", F.array_join(F.col("reply_path").cast("array<string>"), ".").alias("reply_path"), F.sha2("own_text", 256).alias("own_sha256"))
