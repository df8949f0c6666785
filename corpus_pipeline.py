"""From raw documents to token ids: five stages, each on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. Its result is written as Parquet and read again as the
next one's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import byte_bpe, decontaminate, jaccard_join, scratch, substring_dedup, toxicity
from lodestack.sources import staging
from lodestack.sources.tables import read


#: A column of no document.
KEY = "_pipeline_key"


def _key() -> Column:
    """What tells documents apart: the id, or without one a number from 2**62 on made of the text."""
    return F.coalesce("doc_id", F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.7 go. The model learns from the training fold of ``labels``."""
    model = toxicity.train_on_labels(docs, read(spark, sf_dir, "labels"))
    return toxicity.keep_below(docs, model)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by 5-word shingle similarity of 0.8 or more, the one with the smallest id stays.

    Rows that share an id, or have none and share their text, are one document
    and share its fate; one without an id goes rather than one with an id.
    """
    keyed = docs.withColumn(KEY, _key())
    classes = jaccard_join.similarity_classes(keyed, size=5, threshold=(80, 100), doc_id=KEY)
    kept = classes.where("doc_id = component_id").select(F.col("doc_id").alias(KEY))
    return keyed.join(kept.hint("merge"), KEY, "left_semi").drop(KEY)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has are cut; every row stays, with what is left of its text."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = substring_dedup.dedup_passages(docs, carry=rest, as_is=True).withColumn("text", F.col("kept_text"))
    if "n_chars" in rest:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return cut.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go, with all rows of their id (of their text, without an id)."""
    keyed = docs.withColumn(KEY, _key())
    found = decontaminate.decontaminate(keyed, read(spark, sf_dir, "benchmark"), doc_id=KEY)
    hit = scratch.table(found.where("contaminated").select(F.col("doc_id").alias(KEY)).distinct())
    return keyed.join(hit.hint("merge"), KEY, "left_anti").drop(KEY)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


_open: dict[tuple[int, str], list[scratch.Scope]] = {}


def _stage(k: int, function: Callable) -> Callable:
    """The stage with its scratch tables. When a stage starts, the one before it has been written, so what that one left is deleted.

    Of one thread and one folder: pipelines side by side do not meet.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.configure(spark)
        mine = _open.setdefault((threading.get_ident(), sf_dir), [])
        while k and mine:
            mine.pop().release()
        with scratch.scope() as opened:
            mine.append(opened)
            return function(spark, docs, sf_dir)

    run_stage.__doc__ = function.__doc__
    return run_stage


_FUNCTIONS = (
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("token_ids", to_token_ids),
)
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [(name, _stage(k, f)) for k, (name, f) in enumerate(_FUNCTIONS)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each result but the last is staged in the shared folder until the next one is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = staging.new_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            staging.delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
