"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources.tables import read

from . import bm25, byte_bpe, decontaminate, dominance, filter_audit, html_extract, jaccard_join, licenses, line_dedup, oracle, oracle_audit, oracle_more, quotes, scratch, substring_dedup, toxicity, warc


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return bm25.top_k(docs, docs.where("doc_id % 50 = 0"), k=10).withColumn("score", F.round("score", 6))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.dedup_passages(read(spark, sf_dir, "documents")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.derive(warc.responses_of(read(spark, sf_dir, "pages"))))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(read(spark, sf_dir, "documents"), size=3, threshold=(90, 100))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    files = docs.select(licenses.example_path(F.col("doc_id"), F.col("source")).alias("path"), "text")
    return licenses.scan(files).select(licenses.example_id(F.col("path")).alias("doc_id"), "path", "own_license", F.round("own_score", 6).alias("own_score"), "in_line", "license", "license_from")


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.digests(quotes.threads(read(spark, sf_dir, "conversations")))


def quoting(conversations: DataFrame) -> DataFrame:
    """The conversations with an earlier message quoted in each: the one before, or for odd turns the one before that."""
    earlier = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("before"))
    turn = F.col("turn") - 1 - F.col("turn") % 2
    joined = conversations.withColumn("of", turn).join(earlier.withColumnRenamed("turn", "of"), ["conv_id", "of"], "left")
    quoted = F.concat(F.lit("> "), F.regexp_replace("before", r"\r\n|\r|\n", "\n> "), F.lit("\n"), F.coalesce("text", F.lit("")))
    return joined.select("conv_id", "turn", "role", F.when(F.col("before").isNull(), F.col("text")).otherwise(quoted).alias("text"))


def quotation_linking_of_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored conversations hold no quotations; here every message quotes an earlier one."""
    return quotes.digests(quotes.threads(quoting(read(spark, sf_dir, "conversations"))))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.dedup_lines(read(spark, sf_dir, "documents")))


def op12_dominance_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = dominance.dominance_counts(dominance.sales_points(read(spark, sf_dir, "sales")), id="sale_id")
    return counted.withColumnsRenamed({"id": "sale_id", "n_above": "n_sales", "w_above": "n_rows"})


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_ALL = (op1_toxicity, op2_exact_topk_search, op3_substring_dedup, op4_byte_bpe, op5_html_extraction, op6_warc_derivatives, op7_ngram_jaccard_join, op8_license_scan, op9_quotation_linking, op10_benchmark_decontamination, op11_line_dedup, op12_dominance_counting, op13_filter_audit, quotation_linking_of_replies)


def _registered(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scratch.configure(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: _registered(f) for f in _ALL}
SQL: dict[str, str] = {name: sql for name, sql in (oracle.SQL | oracle_more.SQL | oracle_audit.SQL).items() if name in QUERIES}
