"""Intermediate tables in the shared folder, and merging of fixed-size counters.

``spark.checkpoint.dir`` names the folder that every executor and the driver
share. Tables written there cut the lineage: an executor lost later costs a
re-read, not a recomputation.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.session import make_importable
from lodestack.sources import staging

from .textkernel import mix


class Scope:
    """The tables that were written for one piece of work."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def release(self) -> None:
        """Delete the tables; call it only when no result built on them is still to be read."""
        while self.paths:
            staging.delete(*self.paths.pop())


_now = threading.local()


@contextmanager
def scope() -> Iterator[Scope]:
    """Tables that this thread writes inside belong to the scope. Those of no scope go when the program ends."""
    before, _now.scope = getattr(_now, "scope", None), Scope()
    try:
        yield _now.scope
    finally:
        _now.scope = before


def table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = staging.new_path(spark, "lodestack")
    if getattr(_now, "scope", None) is not None:
        _now.scope.paths.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Settings of a program that runs these operators, which leave the session's settings alone: an Arrow batch is held on both
#: sides of every worker (Spark's own bound is 64 MB), and the shuffle files behind a written table are of no more use.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_DEFAULTS = (None, "64MB", "67108864", "67108864b", "false")


def configure(spark: SparkSession) -> None:
    """Give the session ``SETTINGS`` where it has Spark's own values. For programs: the registered queries and the pipeline."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) in _DEFAULTS:
            spark.conf.set(key, value)


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under fixed names: clashing extra columns cannot interfere. Also sees that workers can import this package."""
    make_importable(df.sparkSession)
    return df.select(*[df[src].alias(dst) for dst, src in names.items()])


def packed(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


#: Counters in one slice of a sketch or frequency table.
SLICE = 1 << 16


def _slices(cells: np.ndarray, multi: np.ndarray | None) -> Iterator[tuple[int, bytes]]:
    """(slice, sorted cells of it as uint16, those seen more than once after the others) of unique sorted cells."""
    edges = np.flatnonzero(np.diff(cells >> 16)) + 1
    for part in np.split(np.arange(len(cells)), edges) if len(cells) else []:
        low = (cells[part] & 0xFFFF).astype(np.uint16)
        twice = low[multi[part]]
        yield int(cells[part[0]] >> 16), np.concatenate((low, twice)).tobytes(), len(low)


SKETCH_ROW = "slice int, n int, cells binary"


def sketch_rows(cells: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """The partial sketch of one task: which cells were hit once, and which more often."""
    unique, counts = np.unique(cells, return_counts=True)
    for k, raw, n in _slices(unique, counts > 1):
        yield k, n, raw


def repeated_cells(partials: DataFrame, cells: int, partitions: int) -> np.ndarray:
    """Merge partial sketches; a bit for each cell, set where the merged count is two or more.

    The partial sketches are streamed slice by slice through dense counters,
    so a task holds one slice however many partials there are. What reaches
    the driver has ``cells`` bits, a bound set by the caller.
    """

    def merge(batches):
        at, once, twice = None, None, None

        def done():
            bits = np.packbits(twice, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), packed([bits])], names=["slice", "bits"])

        for batch in batches:
            for k, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if k != at:
                    if at is not None:
                        yield done()
                    at, once, twice = k, np.zeros(SLICE, bool), np.zeros(SLICE, bool)
                low = np.frombuffer(raw.as_buffer(), np.uint16)
                twice[low[:n][once[low[:n]]]] = True
                twice[low[n:]] = True
                once[low[:n]] = True
        if at is not None:
            yield done()

    merged = partials.repartition(partitions, "slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, bits binary")
    bits = np.zeros(cells // 8, np.uint8)
    for row in merged.collect():  # bounded by the number of cells
        bits[row.slice * SLICE // 8 : (row.slice + 1) * SLICE // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def counted_cells(partials: DataFrame, cells: int, partitions: int, as_: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray:
    """Merge partial dense counters (slice, uint32 counts) into one table of ``cells`` values of ``kind``: ``as_`` of each sum."""

    def merge(batches):
        at, total = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), packed([as_(total).astype(kind).tobytes()])], names=["slice", "counts"])

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != at:
                    if at is not None:
                        yield done()
                    at, total = k, np.zeros(SLICE, np.uint64)
                total += np.frombuffer(raw.as_buffer(), np.uint32)
        if at is not None:
            yield done()

    merged = partials.repartition(partitions, "slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, counts binary")
    out = np.zeros(cells, kind)
    for row in merged.collect():  # bounded by the number of cells
        out[row.slice * SLICE : (row.slice + 1) * SLICE] = np.frombuffer(row.counts, kind)
    return out


def bitmap(values: DataFrame, cells: int) -> np.ndarray:
    """A bit for each cell, set where ``cell_of`` a value of the only column (long) falls: a Bloom filter of one hash."""

    def partial(batches):
        for batch in batches:
            cell = np.unique(cell_of(batch.column(0).to_numpy().view(np.uint64), cells))
            edges = np.flatnonzero(np.diff(cell // SLICE)) + 1
            parts = np.split(cell, edges) if len(cell) else []
            yield pa.RecordBatch.from_arrays([pa.array([int(x[0] // SLICE) for x in parts], pa.int32()), pa.array([0] * len(parts), pa.int32()), packed([(x % SLICE).astype(np.uint16).tobytes() for x in parts])], names=["slice", "n", "cells"])

    return repeated_cells(values.mapInArrow(partial, SKETCH_ROW), cells, min(partitions_of(values.sparkSession), cells // SLICE))


def cell_of(values: np.ndarray, cells: int) -> np.ndarray:
    return (mix(values) & np.uint64(cells - 1)).astype(np.int64)


def bit(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def width_for(expected: int, least_bits: int, most_bits: int) -> int:
    """A power of two of at least four cells for each expected item, within bounds."""
    return 1 << min(most_bits, max(least_bits, (4 * max(1, expected) - 1).bit_length()))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
