"""Removal of lines that many documents hold, by DataFrame functions alone.

1. Each text is exploded into lines; a line's key is the line in small letters
   without white space at its ends, hashed to 128 bits.
2. The distinct documents of each key are counted (distinct pairs of key and
   document first, then one partial count a task, so a line of every document
   is not gathered), with the smallest document. Keys over the threshold are
   staged.
3. The lines meet those keys again; all but those of the smallest document are
   to go. The keys come from a table, so adaptive execution can split the rows
   of a very common line.
4. What goes of a document is a list of positions. It joins the documents, and
   the text is put together from the runs of lines between them.

Only hashes and positions are shuffled up to there; the texts move once, in the
last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: ``[\x20\x09-\x0D]``
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Makes the second hash of a value another function than the first.
SALT = 0x5851F42D


def lines_of(text: Column) -> Column:
    """The lines of a text as an array; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line without ASCII white space at its ends, with A-Z as small letters and all other letters as they are."""
    bare = F.btrim(line, F.lit(SPACE))
    # Spark's lower() is quick and right for ASCII; translate() looks each character up.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(value: Column, a: str, b: str) -> list[Column]:
    return [F.xxhash64(value).alias(a), F.xxhash64(F.lit(SALT), value).alias(b)]


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, t1, t2 (hash of the text), pos, h1, h2 (hash of the key) of the lines whose key has ``min_chars`` code points or more."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.where("doc_id is not null").select("doc_id", *_hashes(text, "t1", "t2"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = rows.select("doc_id", "t1", "t2", "pos", key_of(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "t1", "t2", "pos", *_hashes(F.col("key"), "h1", "h2"))


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, owner: keys of ``min_docs`` documents or more, with the smallest of them."""
    counted = lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("owner"))
    return counted.where(F.col("n") >= min_docs).select("h1", "h2", "owner")


def without(lines: Column, gone: Column) -> Column:
    """The lines whose positions (from 0) are not in the sorted array ``gone``, joined by a line break. Linear in the lines."""

    def joined(ls: Column) -> Column:
        first, end = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1)), F.concat(gone, F.array(F.size(ls)))
        runs = F.zip_with(first, end, lambda a, z: F.slice(ls, a + 1, z - a))
        return F.array_join(F.flatten(runs), "\n")

    # Bound by a lambda, so that the split is made once and not for each run.
    return F.transform(F.array(lines), joined)[0]


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` for every row of ``docs``.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with
    A-Z lower-cased. Keys of at least ``min_chars`` code points that at least
    ``min_docs`` distinct documents hold lose all their lines, except those in
    the smallest ``doc_id`` that holds the key (all of them, if it repeats the line).
    ``n_lines`` counts the lines before that. The other lines stay in order,
    joined by ``\\n``; if none is left, the text is empty.

    A null or empty text is one empty line. Repeated rows, and rows that share a
    ``doc_id``, are one document when documents are counted, and each is cut by
    its own text. Rows without a ``doc_id`` are no documents: they do not count
    and lose nothing. An empty table gives an empty result; other columns play no part.
    """
    src = scratch.columns(docs, doc_id=doc_id, text=text)
    lines = keyed_lines(src, min_chars)
    owners = scratch.table(repeated_keys(lines, min_docs))
    dropped = lines.join(owners.hint("merge"), ["h1", "h2"]).where(F.col("doc_id") > F.col("owner"))
    gone = scratch.table(dropped.groupBy("doc_id", "t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("gone")))
    whole = src.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = whole.select("doc_id", "text", *_hashes(F.col("text"), "t1", "t2")).join(gone.hint("merge"), ["doc_id", "t1", "t2"], "left")
    return cut.select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(without(lines_of(F.col("text")), F.col("gone"))).alias("kept_text"),
    )


def digests(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
