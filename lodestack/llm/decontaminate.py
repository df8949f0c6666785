"""Benchmark decontamination by a prefix-filtered join of shingle sets.

An item's text is cut into windows of ``size`` words; a document is hit where
it holds a whole window, so the containment asked for is one and the
necessary prefix of a window (n - ceil(1 * n) + 1 tokens) is its single rarest
shingle.

1. Shingles of the windows are counted over all documents, behind a bitmap of
   fixed size, and ordered by rarity.
2. A second pass over the documents keeps the positions whose shingle is in
   the bitmap of prefix tokens, each with the words around it.
3. They join the windows on the token. The length bound (the document has
   room for the window) and the positional bound (the window neither starts
   before the document nor ends after it) come next, then the comparison of
   the window's own words: hashes never decide.
4. A window that many items share is one window up to here. Windows of the same
   items are one set of items, and a document's items follow from its distinct sets.

Documents stay where they are: only matching positions are shuffled.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .textkernel import ALNUM, U64, chunks, gram_starts, grams, split

#: Cells of the bitmaps that are broadcast: 2 MB whatever the size of the benchmark.
BITMAP = 1 << 24


#: Windows in one Arrow batch: a long item leaves its windows in several.
BATCH = 4096


def windows_of(items: DataFrame, size: int, shingle: int) -> DataFrame:
    """item_id, words, start-relative shingles of each window of each item, some more than once."""

    def cut(batches):
        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int32()), strict=True)], names=["item_id", "words", "tokens", "k"])

        out = []
        for batch in batches:
            ids = batch.column(0)
            for lo, _, data, offsets in chunks(batch.column(1)):
                found = split(data, offsets, ALNUM, lower=True)
                for i, (a, z) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)):
                    n = min(size, z - a)
                    k = min(shingle, n)
                    for s in range(a, z - n + 1) if n else ():
                        out.append((ids[lo + i].as_py(), [found.word(x).decode() for x in range(s, s + n)], grams(found.hashes[0][s : s + n], k).view(np.int64).tolist(), k))
                        if len(out) == BATCH:
                            yield made()
                            out = []
        if out:
            yield made()

    return items.mapInArrow(cut, "item_id long, words array<string>, tokens array<long>, k int")


def contaminated_spans(docs: DataFrame, items: DataFrame, size: int = 10, shingle: int = 4, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, hits, sets) of the exact occurrences of item windows in documents.

    ``documents``: ``row, doc_id, n_words`` for every row of ``docs``.
    ``hits``: ``row, doc_id, items, start, stop``, one for each window that a
    document holds (word positions, ``stop`` beyond the last), however many
    items share it. ``sets``: ``items, item_id``, the items of each set that hits name.

    Words are runs of digits, letters a-z after lower-casing A-Z, and
    characters beyond ASCII. An item of fewer than ``size`` words is one
    window; an item without words has none. Null texts have no words. Rows
    with equal ids are kept apart by ``row``.
    """
    spark = docs.sparkSession
    src = scratch.columns(docs, doc_id=doc_id, text=doc_text)
    owned = scratch.table(windows_of(scratch.columns(items, item_id=item_id, text=item_text), size, shingle))
    windows, sets = _shared(owned)
    ks = sorted(r.k for r in windows.select("k").distinct().collect())  # at most ``shingle`` of them
    tokens = windows.select(F.explode("tokens").alias("token")).distinct()
    wanted = spark.sparkContext.broadcast(scratch.bitmap(tokens, BITMAP))

    def counted(batches):
        for batch in batches:
            found = []
            for _, _, data, offsets in chunks(batch.column(0)):
                words = split(data, offsets, ALNUM, lower=True)
                for k in ks:
                    keys = grams(words.hashes[0], k)[gram_starts(words.first, k)]
                    found.append(keys[scratch.bit(wanted.value, scratch.cell_of(keys, BITMAP))])
            keys, counts = np.unique(np.concatenate(found) if found else np.zeros(0, U64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["token", "n"])

    seen = src.select("text").mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    placed = windows.select("window", "items", "words", "k", F.posexplode("tokens").alias("offset", "token"))
    ranked = placed.join(seen, "token").withColumn("rank", F.row_number().over(Window.partitionBy("window").orderBy("n", "token", "offset")))
    prefix = scratch.table(ranked.where("rank = 1").select("token", "items", "words", "k", "offset"))
    chosen = spark.sparkContext.broadcast(scratch.bitmap(prefix.select("token").distinct(), BITMAP))

    def positions(batches):
        for batch in batches:
            n_words, cands = [], []
            for _, _, data, offsets in chunks(batch.column(1)):
                words = split(data, offsets, ALNUM, lower=True)
                first, mine = words.first, [[] for _ in range(len(words.first) - 1)]
                doc_of = words.doc_of()
                for k in ks:
                    at = gram_starts(first, k)
                    keys = grams(words.hashes[0], k)[at]
                    take = scratch.bit(chosen.value, scratch.cell_of(keys, BITMAP))
                    for p, key in zip(at[take].tolist(), keys[take].view(np.int64).tolist(), strict=True):
                        d = doc_of[p]
                        a, z = max(first[d], p - size + k), min(first[d + 1], p + size)
                        mine[d].append({"token": key, "pos": int(p - first[d]), "from": int(a - first[d]), "around": [words.word(x).decode("utf-8", "replace") for x in range(a, z)]})
                n_words.append(np.diff(first))
                cands += mine
            n = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cands, CANDS)], names=["doc_id", "n_words", "cands"])

    rows = scratch.table(src.mapInArrow(positions, "doc_id long, n_words long, cands array<struct<token:long,pos:int,from:int,around:array<string>>>").withColumn("row", F.monotonically_increasing_id()))
    found = rows.where(F.size("cands") > 0).select("row", "doc_id", "n_words", F.explode("cands").alias("c")).select("row", "doc_id", "n_words", "c.token", "c.pos", "c.from", "c.around")
    pairs = found.join(prefix, "token").withColumn("start", F.col("pos") - F.col("offset")).withColumn("stop", F.col("start") + F.size("words"))
    bounded = pairs.where("start >= 0 and stop <= n_words and start >= `from`")
    hits = bounded.where(F.slice("around", F.col("start") - F.col("from") + 1, F.size("words")) == F.col("words"))
    return rows.select("row", "doc_id", "n_words"), hits.select("row", "doc_id", "items", "start", "stop"), sets


def _shared(owned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(window, words, k, tokens, items) of each distinct window, and (items, item_id) of each set of items that share one.

    A set is known by its size and 128 bits of its items, so no window gathers its items.
    """
    pairs = owned.groupBy("words", "item_id").agg(F.first("k").alias("k"), F.first("tokens").alias("tokens"))
    sign = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("item_id")).alias("a"), F.bit_xor(F.xxhash64(F.lit(0x5851F42D), F.col("item_id"))).alias("b"))
    distinct = pairs.groupBy("words").agg(F.first("k").alias("k"), F.first("tokens").alias("tokens"), sign.alias("items"))
    windows = scratch.table(distinct.withColumn("window", F.monotonically_increasing_id()))
    # Any window of a set names its items; the one with the least number does.
    chosen = scratch.table(windows.groupBy("items").agg(F.min_by("words", "window").alias("words")))
    named = owned.select("words", "item_id").where("item_id is not null").join(chosen.hint("merge"), "words").select("items", "item_id").distinct()
    return windows, scratch.table(named)


CANDS = pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32()), ("from", pa.int32()), ("around", pa.list_(pa.string()))]))


def covered(spans) -> F.Column:
    """Words in the union of the sorted array of ``struct(start, stop)``."""
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], acc["end"]))).cast("long").alias("n"), F.greatest(acc["end"], s["stop"]).alias("end"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step)["n"]


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, shingle: int = 4, **names: str) -> DataFrame:
    """Every row of ``docs``: ``doc_id, n_words, n_hit, item_ids`` (sorted as strings), ``contaminated``.

    See ``contaminated_spans`` for words, windows, nulls and repeated rows.
    An item without an id contaminates like any other and is not among the
    ``item_ids``. An empty ``items`` table leaves every document clean.
    """
    rows, hits, sets = contaminated_spans(docs, items, size, shingle, **names)
    found = scratch.table(hits.select("row", "items", "start", "stop"))
    words = found.groupBy("row").agg(covered(F.collect_list(F.struct("start", "stop"))).alias("n_hit"))
    owners = found.select("row", "items").distinct().join(sets.hint("merge"), "items")
    named = owners.select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    out = rows.join(words, "row", "left").join(named, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def digests(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


