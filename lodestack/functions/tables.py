"""Table functions for SQL: one row in, many rows out."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Pieces:
    """``pieces(TABLE(t) [PARTITION BY ... ORDER BY (...)], column, pattern)``: the pieces of a text column between matches of a pattern.

    The result has the other columns of the table, whatever they are, then
    ``n`` (the place within the partition, from 1, in its order), ``pos`` (the place
    within the row, from 1) and ``piece``. Empty pieces and null texts give
    nothing. Without PARTITION BY the places ``n`` count within a task. A partition is one key's
    rows in one task, streamed: it need not fit into memory.
    """

    def __init__(self) -> None:
        self.n, self.split = 0, None

    @staticmethod
    def analyze(row: AnalyzeArgument, column: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        if not row.isTable or column.value is None or pattern.value is None:
            raise ValueError("pieces(TABLE(...), column, pattern): a table, the name of a column and a pattern, both constant")
        if column.value not in row.dataType.names or row.dataType[column.value].dataType != StringType():
            raise ValueError(f"the table has no text column {column.value}")
        rest = [f for f in row.dataType if f.name != column.value]
        return AnalyzeResult(schema=StructType(rest).add("n", LongType()).add("pos", IntegerType()).add("piece", StringType()))

    def eval(self, row, column: str, pattern: str):
        if self.split is None:
            self.split = re.compile(pattern).split
        text = row[column]
        if text is None:
            return
        rest = [row[name] for name in row.__fields__ if name != column]
        pos = 0
        for piece in self.split(text):
            if piece:
                pos, self.n = pos + 1, self.n + 1
                yield (*rest, self.n, pos, piece)


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL under their names."""
    spark.udtf.register("pieces", udtf(Pieces))
