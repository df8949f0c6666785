"""Bags: DataFrames of one column ``value`` in which repeats count.

Functions are given as Columns, so Catalyst sees through every operator; the
two exceptions, ``map_partitions`` and ``fold_ordered``, say why.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources.staging import staged


def parallelize(spark: SparkSession, items: Iterable[str]) -> DataFrame:
    """A bag of local items; an empty list is an empty bag."""
    return spark.createDataFrame([(x,) for x in items], "value string")


def from_table(rows: DataFrame, value: Column) -> DataFrame:
    """One item for each row whose ``value`` is not null."""
    return rows.select(value.alias("value")).where("value is not null")


def flat_map(bag: DataFrame, items: Column) -> DataFrame:
    """Each item becomes the items of an array; a null or empty array adds nothing."""
    return bag.select(F.explode(items).alias("value"))


def map_to_pair(bag: DataFrame, key: Column, value: Column) -> DataFrame:
    """One pair for each item; items with a null key are dropped."""
    return bag.select(key.alias("key"), value.alias("value")).where(F.col("key").isNotNull())


def flat_map_to_pair(bag: DataFrame, pairs: Column) -> DataFrame:
    """``pairs`` is an array of ``struct(key, value)``; all of them are kept, repeats too."""
    return bag.select(F.explode(pairs).alias("p")).select(F.col("p.key").alias("key"), F.col("p.value").alias("value"))


def keep(bag: DataFrame, condition: Column) -> DataFrame:
    """Items for which the condition is true; false and null go."""
    return bag.where(condition)


def map_partitions(bag: DataFrame, function: Callable[[Iterable[pd.DataFrame]], Iterable[pd.DataFrame]], schema: str = "value string") -> DataFrame:
    """Host code over whole partitions, Arrow batch by batch: for what Columns cannot say. Runs for empty partitions as well."""
    return bag.mapInPandas(function, schema)


def sample(bag: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    """Each item stays with probability ``fraction``."""
    return bag.sample(False, fraction, seed)


def sample_hashed(rows: DataFrame, key: Column, fraction: float) -> DataFrame:
    """Like ``sample``, but a key always meets the same fate: runs and engines agree on it."""
    below = f"{int(fraction * 2**32):08x}" if fraction < 1 else "g"
    return rows.where(F.substring(F.md5(key.cast("string")), 1, 8) < below)


#: Cells of the histogram of random keys by which an exact sample finds its cut.
CELLS = 1 << 12


def sample_exact(bag: DataFrame, fraction: float, seed: int = 0, replace: bool = False) -> DataFrame:
    """Exactly ``ceil(count * fraction)`` items, with or without replacement.

    The items are staged with a random key, so a task that runs again meets
    the same keys. Without replacement the items of the least keys stay: a
    histogram of the keys tells the cell of the cut, all cells below it are
    kept where they lie, and only that cell, a share of ``1 / CELLS`` of the
    bag, is sorted. With replacement each draw picks a uniform rank; ranks are
    dense within a partition (offsets by partition), so no task holds the bag.
    """
    tagged = staged(bag.withColumn("_r", F.rand(seed)).withColumn("_id", F.monotonically_increasing_id()))
    cell = F.floor(F.col("_r") * CELLS).cast("int")
    part = F.shiftright("_id", 33)
    sizes = tagged.groupBy(cell.alias("c")) if not replace else tagged.groupBy(part.alias("c"))
    counts = sorted((r.c, r.n) for r in sizes.agg(F.count("*").alias("n")).collect())  # a row for each cell or partition
    n = sum(size for _, size in counts)
    want = -(-int(n * fraction * 10**9) // 10**9)
    if not n or not want:
        return bag.limit(0)
    starts, total = [], 0
    for c, size in counts:
        starts.append((c, total))
        total += size
    if not replace:
        cut, before = max((x for x in starts if x[1] < want), key=lambda x: x[1])
        edge = tagged.where(cell == cut).orderBy("_r", "_id").limit(want - before)
        return tagged.where(cell < cut).unionByName(edge).select(*bag.columns)
    offsets = bag.sparkSession.createDataFrame(starts, "_p long, _start long")
    rank = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = tagged.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn("_rank", rank)
    draws = bag.sparkSession.range(want).select(F.floor(F.rand(seed) * n).cast("long").alias("_rank"))
    return draws.join(ranked, "_rank").select(*bag.columns)


def count(bag: DataFrame) -> DataFrame:
    return bag.agg(F.count("*").alias("n"))


def distinct(bag: DataFrame) -> DataFrame:
    return bag.distinct()


def take(bag: DataFrame, n: int) -> DataFrame:
    """Any ``n`` items; order the bag first to say which."""
    return bag.limit(n)


def fold_sum(bag: DataFrame, zero: int = 0) -> DataFrame:
    """Integer fold with addition; partial sums are combined before the shuffle. The zero counts once."""
    return bag.agg((F.coalesce(F.sum(F.col("value").cast("long")), F.lit(0)) + F.lit(zero)).cast("long").alias("result"))


def fold_ordered(bag: DataFrame, zero: str, op: Callable[[Column, Column], Column]) -> DataFrame:
    """Left fold in the order of the items, for an ``op(acc, item)`` that is not associative.

    A sequential fold is one chain of calls, so the items end in one array on
    one task: meant for bags of bounded size. Use an aggregate otherwise.
    """
    return bag.agg(F.aggregate(F.array_sort(F.collect_list("value")), F.lit(zero), op).alias("result"))


def group_by(bag: DataFrame, key: Column) -> DataFrame:
    """``key, values``: the items of each key, sorted and joined by commas. The text of a group is the result, so a group must fit a row."""
    return bag.groupBy(key.alias("key")).agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("values"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items of both bags, each once."""
    return a.intersect(b)


def output(lines: Iterable[str]) -> str:
    """What a job reports: its lines one after another."""
    return "".join(lines) or "No Output."
