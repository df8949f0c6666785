"""Connected components of a distributed edge list (alternating large and small stars)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


#: Edges that one task settles alone: a union-find of them takes some tens of megabytes.
ONE_TASK = 1 << 18


class Forest:
    """Union-find over integers; the root of a tree is its least member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top and up != x:
            parent[x], x = top, up
        return top

    def union(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(x), self.root(y)
        if a == b:
            self.parent.setdefault(x, a)
            self.parent.setdefault(y, b)
            return False
        a, b = min(a, b), max(a, b)
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True


def contract(edges: DataFrame, most: int = 2 * ONE_TASK) -> DataFrame:
    """Fewer edges with the same components: each task keeps a star for each tree of what it has read."""

    def run(batches):
        forest = Forest()

        def stars():
            own = [(x, r) for x in forest.parent if (r := forest.root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.int64()), pa.array([r for _, r in own], pa.int64())], names=["a", "b"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.union(x, y)
            if len(forest.parent) > most:
                yield stars()
                forest = Forest()
        yield stars()

    return edges.select("a", "b").where("a <> b").mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges(a, b)``; the component is its least node.

    Every round writes its edges to the shared folder, so the lineage stays
    one round long. When the tasks' forests have few edges left, one task
    settles them and no round is needed; the result is the same. A hub's neighbours are never gathered in one row: each
    star is a minimum with partial aggregation and a join back. The minima are
    staged, so both sides of that join are plain shuffles and adaptive
    execution can split a hub's rows.
    """
    now = scratch.table(contract(edges))
    if now.count() <= ONE_TASK:
        return _members(scratch.table(contract(now.coalesce(1))))
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low.hint("merge"), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = scratch.table(small.where("a <> b").distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == mark:
            break
        mark = (seen.n, seen.h)
    return _members(now)


def _members(stars: DataFrame) -> DataFrame:
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
