"""Joins and look-ups by order: range join, as-of join.

Both sort by range over the whole cluster, so a key with most of the rows is
cut into many stretches. What one stretch owes to those before it is one small row for
each key and stretch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.session import make_importable
from lodestack.sources.staging import staged

#: Order of what stands at one value: a range ends, then others start, then points are looked up.
END, START, POINT = 0, 1, 2
#: Pairs in a batch of output.
PAIRS = 1 << 16


def range_pairs(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """``key, value, id`` of each point in each range: equal keys and ``low <= value < high``.

    ``points(key, value)`` has no repeated rows; ``ranges(key, low, high, id)``
    has a long ``id``, need not be distinct, and a null ``high`` is no bound.
    Rows with other nulls and empty ranges meet nothing.

    Points, starts and ends are sorted by (key, value) into stretches. A range
    is copied to the stretches between its start and its end, which follow
    from where those two fell, so neither the bounds of the stretches nor the
    ranges go through the driver. A stretch is swept once in order: what is
    held is the ranges that are open, what is written is the pairs.
    """
    make_importable(points.sparkSession)
    key, kind = points.schema["key"].dataType, points.schema["value"].dataType
    whole = ranges.where("key is not null and low is not null and id is not null and (high is null or low < high)")
    marks = F.explode(F.array(F.struct(F.lit(START).alias("kind"), F.col("low").alias("value")), F.struct(F.lit(END).alias("kind"), F.col("high").alias("value")))).alias("m")
    events = whole.select("key", "id", "low", "high", marks).select("key", "m.value", "m.kind", "id", "low", "high")
    none = lambda t: F.lit(None).cast(t)
    stops = points.where("key is not null and value is not null").select("key", "value", F.lit(POINT).alias("kind"), none("long").alias("id"), none(kind).alias("low"), none(kind).alias("high"))
    # An end without a bound stands behind all values of its key.
    beyond = ("value is null", "value", "kind")
    order = ["key", *map(F.expr, beyond)]
    placed = staged(stops.unionByName(events).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    spans = placed.where(F.col("kind") != POINT).groupBy("key", "low", "high", "id").agg(F.min("part").alias("a"), F.max("part").alias("z"))
    copies = spans.select("key", "low", "high", "id", F.explode(F.sequence("a", "z")).alias("part"))
    open_close = copies.select("key", "part", "id", marks).select("part", "key", "m.value", "m.kind", "id")
    swept = placed.where(F.col("kind") == POINT).select("part", "key", "value", "kind", "id").unionByName(open_close)
    sorted_ = swept.repartition("part").sortWithinPartitions("part", *order)
    return sorted_.select("key", "value", "kind", "id").mapInArrow(_sweep, f"key {key.simpleString()}, value {kind.simpleString()}, id long")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_: dict[int, int] = {}  # copies of each open range
    for batch in batches:
        kinds, ids = batch.column(2).to_numpy(), batch.column(3).fill_null(0).to_numpy()
        at, taken, n = [], [], 0
        edges = np.concatenate(([0], np.flatnonzero(np.diff(kinds == POINT)) + 1, [len(kinds)])).tolist()
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            if a == z:
                continue
            if kinds[a] != POINT:
                for kind, k in zip(kinds[a:z].tolist(), ids[a:z].tolist(), strict=True):
                    now = open_.get(k, 0) + (1 if kind == START else -1)
                    if now:
                        open_[k] = now
                    else:
                        del open_[k]
            elif open_:
                held = np.fromiter(open_, np.int64, len(open_))
                step = max(1, PAIRS // len(held))
                for lo in range(a, z, step):
                    hi = min(z, lo + step)
                    at.append(np.repeat(np.arange(lo, hi), len(held)))
                    taken.append(np.tile(held, hi - lo))
                    n += len(at[-1])
                    if n >= PAIRS:
                        yield _pairs(batch, at, taken)
                        at, taken, n = [], [], 0
        if n:
            yield _pairs(batch, at, taken)


def _pairs(batch: pa.RecordBatch, at: list[np.ndarray], taken: list[np.ndarray]) -> pa.RecordBatch:
    rows = pa.array(np.concatenate(at))
    return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(taken))], names=["key", "value", "id"])


def range_join(points: DataFrame, ranges: DataFrame, key: str, value: str, low: str, high: str) -> DataFrame:
    """Rows of ``points`` with the columns of every row of ``ranges`` (all but its ``key``) for which the keys are equal and ``low <= value < high``.

    ``key`` is a column of both; else the sides' columns have different names.
    A null ``high`` is no bound; rows with other nulls meet nothing. Repeated
    rows of either side give repeated rows. The values are searched once each
    (``range_pairs``), and the rows join what was found, both sides as plain shuffles that can be split.
    """
    numbered = staged(ranges.withColumn("_id", F.monotonically_increasing_id()))
    wanted = points.select(F.col(key).alias("key"), F.col(value).alias("value")).distinct()
    found = staged(range_pairs(wanted, numbered.select(F.col(key).alias("key"), F.col(low).alias("low"), F.col(high).alias("high"), F.col("_id").alias("id"))))
    rest = [c for c in ranges.columns if c != key]
    met = staged(found.join(numbered.select(F.col("_id").alias("id"), *rest).hint("merge"), "id").select(F.col("key").alias(key), F.col("value").alias("_value"), *rest))
    left = points.withColumn("_value", F.col(value))
    return left.join(met.hint("merge"), [key, "_value"]).select(*points.columns, *rest)


def prefix_range(prefix: Column) -> tuple[Column, Column]:
    """The range of the byte strings that start with a text: no byte of UTF-8 is 255."""
    raw = prefix.cast("binary")
    return raw, F.concat(raw, F.lit(b"\xff"))


def spread_distinct(rows: DataFrame) -> DataFrame:
    """The distinct rows, found by as many tasks as the session shuffles to.

    Adaptive execution goes by compressed bytes and gives millions of small rows to one task, whose hash table holds them all.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *rows.columns).distinct()


def as_of_join(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, tie: Sequence[str] = (), forward: bool = False, strict: bool = False, within: Column | None = None) -> DataFrame:
    """Rows of ``left`` with the columns of the row of ``right`` (all but ``by``) that holds at their time.

    That is the latest row of ``right`` with equal ``by`` columns and its ``on`` not
    after that of ``left``; of several at one time the one with the greatest ``tie``
    columns (by default all its columns). ``forward``: the earliest not before
    it. ``strict``: not at the same time. ``within``: the greatest distance, an
    interval. Without such a row the columns are null. Both sides have the
    ``on`` column, the right one is returned as ``<on>_right``; other columns
    have different names. Rows of ``right`` with a null in ``by`` or ``on`` hold
    for nothing, such rows of ``left`` get nulls. Repeated rows of ``left`` stay.

    Each time of a key is looked up once, and the rows join what was found. The
    times of both sides are sorted together by range. Within a stretch the last
    row of ``right`` is carried on; each later stretch of a key starts with
    what those before it leave, one row for each key and stretch.
    """
    by, rest = list(by), [c for c in right.columns if c not in (*by, on)]
    known = [*by, on]
    full = " and ".join(f"`{c}` is not null" for c in known)
    held = right.where(full).groupBy(*known).agg(F.max_by(F.struct(on, *rest), F.struct(on, *(tie or rest))).alias("_row"))
    asked = spread_distinct(left.where(full).select(*known)).select(*known, F.lit(None).cast(held.schema["_row"].dataType).alias("_row"), F.lit(True).alias("_asked"))
    both = held.withColumn("_asked", F.lit(False)).unionByName(asked)
    placed = staged(both.repartitionByRange(*known).withColumn("_part", F.spark_partition_id()))
    way = F.desc if forward else F.asc
    # At one time, what holds comes before what asks, unless it has to be another time.
    order = [way(on), F.desc("_asked") if strict else F.asc("_asked")]
    here = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = placed.withColumn("_here", F.last("_row", ignorenulls=True).over(here)).where("_asked").select(*known, "_part", "_here")
    leaves = placed.where("not _asked").groupBy(*by, "_part").agg(_furthest(on, forward).alias("_last"))
    stretches = placed.select(*by, "_part").distinct().join(leaves, [*by, "_part"], "left")
    earlier = Window.partitionBy(*by).orderBy(way("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = staged(stretches.select(*by, "_part", F.last("_last", ignorenulls=True).over(earlier).alias("_before")).where("_before is not null"))
    met = staged(found.join(carried.hint("merge"), [*by, "_part"], "left").select(*known, F.coalesce("_here", "_before").alias("_found")).where("_found is not null"))
    out = left.join(met.hint("merge"), known, "left")
    if within is not None:
        gap = F.col(f"_found.{on}") - F.col(on) if forward else F.col(on) - F.col(f"_found.{on}")
        out = out.withColumn("_found", F.when(gap <= within, F.col("_found")))
    return out.select(*left.columns, F.col(f"_found.{on}").alias(f"{on}_right"), *[F.col(f"_found.{c}") for c in rest])


def _furthest(on: str, forward: bool) -> Column:
    """What holds at the end of a stretch: the row of its greatest time, or of its least going backwards."""
    return F.min_by("_row", on) if forward else F.max_by("_row", on)
