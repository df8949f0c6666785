"""A growing set of texts that is asked what is new: buckets on disk behind a membership filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.session import make_importable
from lodestack.sources.staging import delete, new_path, staged

#: Buckets of the stored set.
BUCKETS = 64
#: Bits of the filter: 8 MB for the driver and each task, whatever the set's size. Two bits a text.
BITS = 1 << 26
#: Bits of one slice of the filter.
SLICE = 1 << 16
#: Additions after which the files of a bucket become one.
MERGED = 50


def _bucket(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int")


def _cells(bits: int) -> list[Column]:
    """The places of a text in the filter."""
    return [F.pmod(F.xxhash64(F.lit(k), F.col("url")), F.lit(bits)).alias(f"c{k}") for k in (1, 2)]


class SeenSet:
    """What was added before. The filter lets through what is surely new; only what it holds back is looked up, in its buckets.

    A full filter holds back more and is never wrong. It is made of bits that
    tasks find and merge; the driver keeps the merged bits and counts. Repeated texts are one; a null is never seen.
    """

    def __init__(self, spark: SparkSession, bits: int = BITS) -> None:
        make_importable(spark)
        self.spark, self.bits, self.path, self.additions = spark, np.zeros(bits // 8, np.uint8), new_path(spark, "seen"), 0

    def add(self, texts: DataFrame) -> None:
        """Take up ``texts(url)``, a staged table."""
        self._write(texts.where("url is not null").select("url", _bucket(F.col("url")).alias("bucket")), self.path)
        self.additions += 1
        if self.additions % MERGED == 0:
            old, self.path = self.path, new_path(self.spark, "seen")
            self._write(self.read(path=old).distinct(), self.path)
            delete(self.spark, old)
        size = len(self.bits) * 8
        placed = texts.where("url is not null").select(F.explode(F.array(*_cells(size))).alias("cell"))
        marks = placed.select((F.col("cell") / SLICE).cast("int").alias("slice"), (F.col("cell") % SLICE).cast("int").alias("at")).mapInArrow(_partial, "slice int, cells binary")
        merged = marks.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merge, "slice int, bits binary")
        for row in merged.collect():  # at most the bits of the filter
            self.bits[row.slice * SLICE // 8 : (row.slice + 1) * SLICE // 8] |= np.frombuffer(row.bits, np.uint8)

    @staticmethod
    def _write(rows: DataFrame, path: str) -> None:
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)

    def read(self, buckets: list[int] | None = None, path: str | None = None) -> DataFrame:
        """``url, bucket`` of the set, or of some buckets of it, by reading only those."""
        rows = self.spark.read.schema("url string, bucket int").parquet(path or self.path)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def unseen(self, texts: DataFrame) -> DataFrame:
        """The rows of ``texts(url)`` that were never added."""
        if not self.additions:
            return texts
        size, bits = len(self.bits) * 8, self.spark.sparkContext.broadcast(self.bits)

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                maybe = np.ones(batch.num_rows, bool)
                for k in (1, 2):
                    cell = batch.column(k).to_numpy()
                    maybe &= (bits.value[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maybe)], names=["url", "maybe"])

        told = staged(texts.select("url", *_cells(size)).mapInArrow(held, "url string, maybe boolean"))
        new, asked = told.where("not maybe").select("url"), told.where("maybe").select("url", _bucket(F.col("url")).alias("bucket"))
        buckets = sorted(r.bucket for r in asked.select("bucket").distinct().collect())  # at most BUCKETS
        if not buckets:
            return new
        return new.unionByName(asked.join(self.read(buckets), ["url", "bucket"], "left_anti").select("url"))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = np.unique(batch.column(0).to_numpy().astype(np.int64) * SLICE + batch.column(1).to_numpy())
        edges = np.concatenate(([0], np.flatnonzero(np.diff(cells // SLICE)) + 1, [len(cells)])).tolist()
        parts = [cells[a:z] for a, z in zip(edges[:-1], edges[1:], strict=True) if z > a]
        yield pa.RecordBatch.from_arrays([pa.array([int(p[0]) // SLICE for p in parts], pa.int32()), pa.array([(p % SLICE).astype(np.uint16).tobytes() for p in parts], pa.binary())], names=["slice", "cells"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, now = None, np.zeros(SLICE, bool)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(now, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != at:
                if at is not None:
                    yield done()
                at, now = k, np.zeros(SLICE, bool)
            now[np.frombuffer(raw, np.uint16)] = True
    if at is not None:
        yield done()
