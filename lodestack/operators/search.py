"""Ranked retrieval: TF-IDF with a threshold, a cap, and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import text as words

# Fixed values of the search service.
THRESHOLD = 0.3
RESULTS = 301
SHOWN = 100
PAGE = 10
NO_BODY = "Not available for descriptions"


def query_terms(spark: SparkSession, query: str) -> DataFrame:
    """``term``: the distinct words of a query."""
    return spark.createDataFrame([(query,)], "q string").select(F.explode(words.unique_tokens(F.col("q"))).alias("term"))


def scores(index: DataFrame, terms: DataFrame, n_docs: DataFrame) -> DataFrame:
    """``doc_id, rank_score`` of the documents above the threshold.

    ``terms`` are one query's words, a bounded table: broadcast as a semi-join,
    it goes below the aggregation of an index that is built on the fly. Unknown
    words add nothing. The frequency of a term is counted from the matched
    postings, in partial aggregates.
    """
    matched = index.join(F.broadcast(terms), "term", "left_semi")
    df = matched.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))  # reads tf, so that both uses of the matched postings share one shuffle
    idf = df.select("term", words.idf(n_docs.select("n").scalar(), F.col("df")).alias("idf"))
    weighted = matched.join(F.broadcast(idf), "term").select("doc_id", (F.col("idf") * words.tf_weight(F.col("tf"))).alias("w"))
    return weighted.groupBy("doc_id").agg(F.sum("w").alias("rank_score")).where(F.col("rank_score") > THRESHOLD)


def top(scored: DataFrame, n: int = RESULTS) -> DataFrame:
    """The best documents; ties by document. A partial top-n in every task, so nothing is sorted in full."""
    return scored.orderBy(F.desc("rank_score"), "doc_id").limit(n)


def described(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """``url, rank_score, title, body``: results with their documents; unknown documents keep null fields. The results are capped, so they are broadcast."""
    found = docs.join(F.broadcast(ranked.select("doc_id")), "doc_id", "left_semi")
    return ranked.join(F.broadcast(found), "doc_id", "left").select("doc_id", F.col("acc").alias("url"), "rank_score", "title", "body")


def as_json(results: DataFrame) -> DataFrame:
    """``value``: the answer of the service, one JSON array in rank order."""
    row = F.struct("url", "rank_score", "title", "body")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("rank_score")).alias("o"), "doc_id", row.alias("r"))))
    return results.agg(F.to_json(F.transform(listed, lambda x: x["r"]), {"ignoreNullFields": "false"}).alias("value"))


def ui_page(results: DataFrame) -> DataFrame:
    """The first ``SHOWN`` results with ``page`` (from 0) and what is displayed for missing titles and bodies.

    The rows are capped before the window, so its single partition is bounded.
    """
    shown = results.orderBy(F.desc("rank_score"), "doc_id").limit(SHOWN)
    place = F.row_number().over(Window.orderBy(F.desc("rank_score"), "doc_id"))
    return shown.select("doc_id", "url", "rank_score", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), F.coalesce(F.nullif("body", F.lit("")), F.lit(NO_BODY)).alias("body"), F.floor((place - 1) / PAGE).cast("int").alias("page"))


def search(spark: SparkSession, query: str, index: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, url, rank_score, title, body`` of a query over an index and its document table."""
    n_docs = docs.agg(F.count("*").alias("n"))
    return described(top(scores(index, query_terms(spark, query), n_docs)), docs)
