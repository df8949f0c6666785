"""Folds written as Python functions: partial results where the rows lie, merged as a tree."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestack.session import make_importable
from lodestack.sources.staging import staged

#: Partial results that one step of the tree combines.
FAN_IN = 16


def fold_tree(
    rows: DataFrame,
    zero: Callable[[], Any],
    op: Callable[[Any, pd.DataFrame], Any],
    combine: Callable[[Any, Any], Any],
    finish: Callable[[Any], Sequence],
    schema: str,
    by: Sequence[str] = (),
    order: Sequence[str] = (),
    fan_in: int = FAN_IN,
) -> DataFrame:
    """The fold of ``rows``, or with ``by`` of the rows of each key: the ``by`` columns, then ``finish`` of the result as columns of ``schema``.

    ``op(acc, batch)`` takes up rows that follow each other, ``combine(a, b)``
    two results of which ``a`` comes first; a result is anything that pickles.
    With ``order`` the rows are folded in that order (nulls first), so ``combine`` need
    not commute, only be associative; where rows tie, their order is open. Without it any order will do.
    ``zero()`` is a neutral result, and what no rows give.

    Rows are sorted by range, each stretch of a key is folded where it lies, and
    ``fan_in`` neighbouring results of a key are combined at a time. So a key with most
    of the rows is folded by many tasks, and a task holds one result and a batch.
    """
    make_importable(rows.sparkSession)
    by, order = list(by), list(order)
    if by or order:
        rows = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    keys = StructType([rows.schema[c] for c in by])
    head = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in keys)}{', ' if by else ''}"
    names = [*by, "_part", "_acc"]

    def emitted(key: list[pa.Array], part: int, acc: Any) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*key, pa.array([part], pa.int32()), pa.array([pickle.dumps(acc)], pa.binary())], names=names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, acc = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for run, at in _runs(batch, by):
                if key is None or not _same(key, at):
                    if key is not None:
                        yield emitted(key, part, acc)
                    key, acc = at, zero()
                acc = op(acc, run.to_pandas())
        if key is not None:
            yield emitted(key, part, acc)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, acc, part = None, None, 0
        for batch in batches:
            for run, at in _runs(batch, [*by, "_group"]):
                if key is None or not _same(key, at):
                    if key is not None:
                        yield emitted(key[:-1], part, acc)
                    key, acc, part = at, zero(), at[-1][0].as_py()
                for raw in run.column(len(by) + 1).to_pylist():
                    acc = combine(acc, pickle.loads(raw))
        if key is not None:
            yield emitted(key[:-1], part, acc)

    now = staged(rows.mapInArrow(partial, f"{head}_part int, _acc binary"))
    parts = (now.agg(F.max("_part").alias("n")).first().n or 0) + 1
    while parts > 1:
        grouped = now.withColumn("_group", F.floor(F.col("_part") / fan_in).cast("int"))
        dealt = grouped.repartition(*by, "_group").sortWithinPartitions(*by, "_group", "_part")
        now = staged(dealt.mapInArrow(merge, f"{head}_part int, _acc binary"))
        parts = -(-parts // fan_in)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [finish(pickle.loads(raw)) for raw in batch.column(len(by) + 1).to_pylist()]
            columns = [pa.array(c, t.type) for c, t in zip(zip(*made, strict=True), fields, strict=True)] if made else [pa.array([], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], *columns], names=[*by, *(f.name for f in fields)])

    fields = list(_arrow(schema))
    if not by:
        nothing = rows.sparkSession.createDataFrame([(0, pickle.dumps(zero()))], "_part int, _acc binary")
        now = now.unionByName(nothing.where(F.lit(now.isEmpty())))
    return now.mapInArrow(last, head + schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))


def _runs(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
    """Runs of rows with equal ``by`` columns, each with those columns of its first row."""
    if not batch.num_rows:
        return
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in by:
        codes = batch.column(name).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    edges = [*np.flatnonzero(new).tolist(), batch.num_rows]
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        run = batch.slice(a, z - a)
        yield run, [run.column(name).slice(0, 1) for name in by]


def _same(a: list[pa.Array], b: list[pa.Array]) -> bool:
    return all(x.equals(y) for x, y in zip(a, b, strict=True))


class Streak:
    """A fold of values in order: the longest run of equal ones.

    A result is (rows, first value, its run, last value, its run, longest run);
    the longest run of two parts may lie over their border.
    """

    def __init__(self, column: str) -> None:
        self.column = column

    @staticmethod
    def zero() -> tuple:
        return 0, None, 0, None, 0, 0

    def op(self, acc: tuple, batch: pd.DataFrame) -> tuple:
        values = batch[self.column].astype(object).where(batch[self.column].notna(), None).to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))
        runs = np.diff(edges)
        return self.combine(acc, (len(values), values[0], int(runs[0]), values[-1], int(runs[-1]), int(runs.max())))

    @staticmethod
    def combine(a: tuple, b: tuple) -> tuple:
        if not a[0] or not b[0]:
            return a if a[0] else b
        over = a[4] + b[2] if a[3] == b[1] else 0
        first = a[2] + b[2] if a[2] == a[0] and over else a[2]
        last = b[4] + a[4] if b[4] == b[0] and over else b[4]
        return a[0] + b[0], a[1], first, b[3], last, max(a[5], b[5], over)

    @staticmethod
    def finish(acc: tuple) -> tuple:
        return acc[0], acc[5]

    def of(self, rows: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
        """The ``by`` columns, ``n`` rows and the length of the ``longest`` run of equal values (nulls are equal)."""
        return fold_tree(rows, self.zero, self.op, self.combine, self.finish, "n long, longest long", by, order)
