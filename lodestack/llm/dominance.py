"""Dominance counting: for each row, the rows of no later slot and a strictly higher level.

1. Rows are counted by (slot, level) first, so a cell of a third of all rows is
   one row from here on.
2. Cells are put in the order (slot, level from the top): what is above a cell
   comes before it. The order is cut into strips of bounded size. A task
   sweeps one strip by slot, with the sums of the levels so far in square-root
   blocks (``LevelSums``).
3. What earlier strips add is scanned on a coarser grid. Cells are summed by
   (strip, level) and dealt out by blocks of levels. The task of a block sweeps
   it strip by strip, which gives what lies above within the block, and leaves
   the block's cumulative array: its sums before each strip. Summed over the
   blocks from the top, these arrays are what a strip starts from.
4. The cells' counts join the rows. They come from a table, so adaptive
   execution can split the rows of a hot cell.

No task holds more than one strip or block, and nothing goes to the driver or is
broadcast. Strips and blocks are as many as the shuffle has partitions, or more where
they would exceed ``CELLS``; the grid has a row for each strip and block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Cells of a strip.
CELLS = 1 << 18


class LevelSums:
    """Sums of pairs of weights by level, for the sums above a level.

    Levels lie in blocks of about the square root of their number. ``inner``
    holds for each level the sum from it to the end of its block, ``outer`` for
    each block the sum from it on: a query adds two numbers, an update touches
    one block and the list of blocks.
    """

    def __init__(self, levels: np.ndarray) -> None:
        self.levels = np.unique(levels)
        self.width = max(1, math.isqrt(len(self.levels)))
        blocks = -(-len(self.levels) // self.width)
        self.inner = np.zeros((2, blocks, self.width + 1), np.int64)  # the last column stays zero
        self.outer = np.zeros((2, blocks + 1), np.int64)

    def ranks(self, levels: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.levels, levels)

    def above(self, ranks: np.ndarray) -> np.ndarray:
        block, at = ranks // self.width, ranks % self.width
        return self.outer[:, block + 1] + self.inner[:, block, at + 1]

    def add(self, ranks: np.ndarray, weights: np.ndarray) -> None:
        """``weights``: an array (2, len(ranks))."""
        block, at = ranks // self.width, ranks % self.width
        if len(ranks) <= self.width:
            for k, (b, i) in enumerate(zip(block.tolist(), at.tolist(), strict=True)):
                self.inner[:, b, : i + 1] += weights[:, k, None]
                self.outer[:, : b + 1] += weights[:, k, None]
            return
        for row, (inner, outer) in enumerate(zip(self.inner, self.outer, strict=True)):
            more = np.zeros_like(inner)
            np.add.at(more, (block, at), weights[row])
            inner += more[:, ::-1].cumsum(axis=1)[:, ::-1]
            outer[:-1] += more.sum(axis=1)[::-1].cumsum()[::-1]


def _whole(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    """The columns of a task's rows, all long."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    return [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(held[0].num_columns)]


def _runs(values: np.ndarray) -> Iterator[slice]:
    edges = np.concatenate(([0], np.flatnonzero(np.diff(values)) + 1, [len(values)])).tolist()
    return (slice(a, z) for a, z in zip(edges[:-1], edges[1:], strict=True))


_STRIPS = "strip long, slot long, level long, n long, w long, own_n long, own_w long"


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells (slot, level, n, w) of a strip in order, with what lies above each in the strip."""
    columns = _whole(batches)
    if columns is None:
        return
    slot, level, *weights = columns
    sums, weights = LevelSums(level), np.stack(weights)
    ranks, own = sums.ranks(level), np.empty_like(weights)
    for run in _runs(slot):
        mine = weights[:, run]
        # Levels of a slot descend: those before a cell are above it.
        own[:, run] = sums.above(ranks[run]) + mine.cumsum(axis=1) - mine
        sums.add(ranks[run], mine)
    strip = np.full(len(slot), TaskContext.get().partitionId())
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (strip, slot, level, *weights, *own)], names=["strip", "slot", "level", "n", "w", "own_n", "own_w"])


_BLOCKS = "block long, strip long, level long, n long, w long"


def _block_of(strips: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For the sums (strip, level, n, w) of a block by strip: what earlier strips have above each, and with null levels the cumulative array."""
        columns = _whole(batches)
        if columns is None:
            return
        strip, level, *weights = columns
        sums, weights = LevelSums(level), np.stack(weights)
        ranks, above = sums.ranks(level), np.empty_like(weights)
        total = np.zeros((2, strips), np.int64)
        for run in _runs(strip):
            above[:, run] = sums.above(ranks[run])
            sums.add(ranks[run], weights[:, run])
            total[:, int(strip[run][0])] = weights[:, run].sum(axis=1)
        before = total.cumsum(axis=1) - total
        block = TaskContext.get().partitionId()
        strip, level = pa.array(np.concatenate((strip, np.arange(strips)))), pa.concat_arrays([pa.array(level), pa.nulls(strips, pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(strip), block)), strip, level, *map(pa.array, np.concatenate((above, before), axis=1))], names=["block", "strip", "level", "n", "w"])

    return run


def cell_counts(cells: DataFrame) -> DataFrame:
    """slot, level, n_above, w_above of each cell of ``cells(slot, level, n, w)``, a staged table without repeated or null cells."""
    parts = max(scratch.partitions_of(cells.sparkSession), -(-cells.count() // CELLS))
    ordered = cells.select("slot", "level", "n", "w").repartitionByRange(parts, "slot", F.desc("level")).sortWithinPartitions("slot", F.desc("level"))
    strips = scratch.table(ordered.mapInArrow(_swept, _STRIPS))
    sums = strips.groupBy("strip", "level").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    dealt = sums.select("strip", "level", "n", "w").repartitionByRange(parts, "level").sortWithinPartitions("strip")
    # The task's number is the strip: at least as many as asked for, whatever raises that number.
    most = strips.agg(F.max("strip").alias("n")).first().n
    blocks = scratch.table(dealt.mapInArrow(_block_of((most or 0) + 1), _BLOCKS))
    higher = Window.partitionBy("strip").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.where("level is null").select("strip", "block", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"up_{c}") for c in ("n", "w")])
    within = blocks.where("level is not null").join(scratch.table(starts).hint("merge"), ["strip", "block"])
    begun = scratch.table(within.select("strip", "level", (F.col("n") + F.col("up_n")).alias("start_n"), (F.col("w") + F.col("up_w")).alias("start_w")))
    counted = strips.join(begun.hint("merge"), ["strip", "level"])
    return counted.select("slot", "level", (F.col("own_n") + F.col("start_n")).alias("n_above"), (F.col("own_w") + F.col("start_w")).alias("w_above"))


def dominance_counts(rows: DataFrame, id: str = "id", slot: str = "slot", level: str = "level", weight: str = "weight") -> DataFrame:
    """``id, slot, level, n_above, w_above`` for every row of ``rows``: how many rows have no later slot and a higher level, and their weight.

    ``slot``, ``level`` and ``weight`` are whole numbers. Equal slots count,
    equal levels do not, so a row is never above itself or its copies. Repeated
    rows, also of one ``id``, count each. A row whose slot or level is null is
    above none, and its own counts are null. A null weight is zero. An empty table gives an empty
    result; other columns play no part.
    """
    src = scratch.columns(rows, id=id, slot=slot, level=level, weight=weight)
    src = src.select("id", *[F.col(c).cast("long").alias(c) for c in ("slot", "level", "weight")])
    placed = F.col("slot").isNotNull() & F.col("level").isNotNull()
    cells = scratch.table(src.where(placed).groupBy("slot", "level").agg(F.count("*").alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")))
    counts = scratch.table(cell_counts(cells))
    joined = src.where(placed).select("id", "slot", "level").join(counts.hint("merge"), ["slot", "level"])
    nothing = F.lit(None).cast("long")
    rest = src.where(~placed).select("id", "slot", "level", nothing.alias("n_above"), nothing.alias("w_above"))
    return joined.select("id", "slot", "level", "n_above", "w_above").unionByName(rest)


def days_of(df: DataFrame, ts: str) -> Column:
    """Days since 1970, by UTC whatever the session's zone is; a time stamp without a zone is taken as UTC."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.unix_date(F.col(ts).cast("date")).cast("long")
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(86_400_000_000)).cast("long")


def _floor(x: Column) -> Column:
    """The floor as a double; from 2**52 on every double is whole."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def price_level(total: Column) -> Column:
    """``floor(floor(100 * total + 0.5) / 1000)`` in double arithmetic; null for what is no number or beyond a long."""
    level = _floor(_floor(total.cast("double") * 100.0 + 0.5) / 1000.0)
    return F.when(F.abs(level) < float(1 << 62), level).cast("long")


def sales_points(sales: DataFrame) -> DataFrame:
    """``sale_id, slot, level, weight`` of ``sales``: the day sold, the price level, and how many rows a sale stands for (crc32 of its id; without an id one)."""
    copies = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 3, F.lit(0)) + 1
    return sales.select("sale_id", days_of(sales, "sold_at").alias("slot"), price_level(F.col("total")).alias("level"), copies.cast("long").alias("weight"))
