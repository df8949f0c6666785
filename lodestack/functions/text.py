"""Search text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Markup out, ASCII punctuation to spaces, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), r"\p{Punct}", " "))


def tokens(text: Column) -> Column:
    """Array of the words, repeats included; empty tokens are dropped."""
    return F.filter(F.split(normalized(text), r"\s+"), lambda x: x != "")


def unique_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def postings(acc: Column) -> Column:
    """Array of ``struct(doc_id, tf)`` from a posting list ``id:...:tf,id:...:tf``, repeats included.

    The id ends at the first colon, tf follows the last; a tf that is no
    integer counts as 1.
    """
    items = F.filter(F.split(acc, ","), lambda x: x != "")
    return F.transform(items, lambda p: F.struct(F.substring_index(p, ":", 1).alias("doc_id"), F.coalesce(F.substring_index(p, ":", -1).try_cast("int"), F.lit(1)).cast("long").alias("tf")))


def tf_weight(tf: Column) -> Column:
    return 1 + F.log10(tf.cast("double"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log10(n_docs.cast("double") / df)
