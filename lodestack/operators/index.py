"""Inverted index and document table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as words
from lodestack.session import make_importable
from lodestack.sources.staging import staged

#: Words that are counted at once; a longer text is counted alone.
COUNTED = 1 << 20


def inverted_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``term, doc_id, tf``. Counted where the text is read, then combined by term and document. A search on it prunes the words before they are counted; for all of them see ``whole_index``."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(words.tokens(F.col(text))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def whole_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``term, doc_id, tf`` of all words.

    A text's words lie together, so they are counted there, text by text, and
    nothing is shuffled or aggregated. Only the texts of an id that several rows have are
    combined by term and document.
    """
    make_importable(docs.sparkSession)
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    repeated = staged(known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id")))
    if repeated.isEmpty():
        return _counted(known)
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    return _counted(known.join(repeated, same, "left_anti")).unionByName(inverted_index(known.join(repeated, same, "left_semi")))


def _counted(docs: DataFrame) -> DataFrame:
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", words.tokens(F.col("text")).alias("words")).mapInArrow(_count, f"term string, doc_id {key}, tf long")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
        ends, lo = np.cumsum(sizes, dtype=np.int64), 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + COUNTED, "right")))
            coded = batch.column(1).slice(lo, hi - lo).flatten().dictionary_encode()
            if n := len(coded.dictionary):
                rows = np.repeat(np.arange(lo, hi, dtype=np.int64), sizes[lo:hi])
                cells, tf = np.unique(rows * n + coded.indices.to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(cells % n)), batch.column(0).take(pa.array(cells // n)), pa.array(tf.astype(np.int64))], names=["term", "doc_id", "tf"])
            lo = hi


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def doc_table(pages: DataFrame, doc_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``doc_id, acc, title, body``: address, title and visible text of stored pages."""
    page = F.col(html)
    body = F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style|title)\b.*?</\1>|<!--.*?-->", " "), "<[^>]*>", " ")
    return pages.select(F.col(doc_id).alias("doc_id"), F.col(url).alias("acc"), _one_line(F.regexp_extract(page, r"(?is)<title>(.*?)</title>", 1)).alias("title"), _one_line(body).alias("body"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def posting_lists(index: DataFrame) -> DataFrame:
    """``term, acc``: the stored form ``doc:tf,doc:tf``, by document. A term's list is one cell; the relational form has no such limit."""
    return index.groupBy("term").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))), lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["tf"].cast("string"))), ",").alias("acc"))


def from_posting_lists(lists: DataFrame) -> DataFrame:
    """``term, doc_id, tf`` of stored posting lists; of a document's repeated postings in a list the last holds."""
    placed = lists.select("term", F.posexplode(words.postings(F.col("acc"))).alias("pos", "p")).select("term", "pos", "p.doc_id", "p.tf")
    return placed.groupBy("term", "doc_id").agg(F.max_by("tf", "pos").alias("tf"))


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term, df`` straight from the texts: a document's distinct words are counted by term, in partial aggregates and one shuffle."""
    return docs.select(F.explode(words.unique_tokens(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def weights(frequency: DataFrame, n_docs: DataFrame) -> DataFrame:
    """``term, df, idf`` of every term of ``frequency(term, df)``; ``n_docs`` is one row with ``n``."""
    return frequency.select("term", "df", words.idf(n_docs.select("n").scalar(), F.col("df")).alias("idf"))


#: Buckets of a stored index; a search reads those of its terms.
BUCKETS = 64


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def save(index: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store ``term, doc_id, tf`` for searching: folders by bucket of the term, files sorted by term within.

    A bucket is dealt by term and a slice of the document id, so that a term
    which most documents have is written by many tasks.
    """
    placed = index.withColumn("bucket", _bucket(F.col("term"), buckets)).withColumn("_slice", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    dealt = placed.repartition("bucket", "_slice").drop("_slice").sortWithinPartitions("bucket", "term")
    dealt.write.mode("errorifexists").partitionBy("bucket").parquet(path)


def load(spark: SparkSession, path: str, terms: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``term, doc_id, tf`` of a stored index; with the ``terms`` of a query only their folders, and of those only their row groups, are read."""
    stored = spark.read.parquet(path)
    if terms is not None:
        found = spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"), buckets).alias("b")).distinct().collect()  # a row for each word of a query
        stored = stored.where(F.col("bucket").isin([r.b for r in found]) & F.col("term").isin(list(terms)))
    return stored.select("term", "doc_id", "tf")
