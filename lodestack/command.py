"""Key-value tables from the command line: ``python -m lodestack.command FOLDER get|put|scan|rename ...``.

Every table is a log below the folder (``operators.kv``).

    get TABLE ROW [COLUMN]       a row, or one cell
    put TABLE ROW COLUMN VALUE   set a cell
    scan TABLE [START [END]]     rows from START on and before END
    rename OLD NEW               move a table
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import kv

USAGE = {"get": (2, 3), "put": (4, 4), "scan": (1, 3), "rename": (2, 2)}


def run(spark: SparkSession, folder: str, words: list[str], say: Callable[[str], None] = print) -> bool:
    """Whether the command could be done; rows are said as JSON, one a line, in the order of their keys."""
    name, *args = words or [""]
    low, high = USAGE.get(name, (1, 0))
    if not low <= len(args) <= high:
        say(__doc__)
        return False

    def table(which: str) -> DataFrame:
        return kv.current(spark.read.schema(kv.LOG).parquet(f"{folder}/{which}"))

    def show(rows: DataFrame) -> bool:
        found = False
        for row in rows.orderBy("row_key").select(F.to_json(F.struct("row_key", "cols")).alias("line")).toLocalIterator():
            say(row.line)
            found = True
        return found

    if name == "put":
        which, key, column, value = args
        kv.append(spark.createDataFrame([(time.time_ns(), "cell", key, {column: value})], kv.LOG), f"{folder}/{which}")
        return True
    if name == "rename":
        return kv.rename(spark, *(f"{folder}/{x}" for x in args))
    if name == "scan":
        show(kv.scan(table(args[0]), *args[1:]))
        return True
    if len(args) == 2:
        return show(kv.get_row(table(args[0]), args[1]))
    cell = kv.get_cell(table(args[0]), *args[1:]).first()
    if cell is None or cell.value is None:
        return False
    say(cell.value)
    return True


if __name__ == "__main__":
    sys.exit(not run(SparkSession.builder.getOrCreate(), sys.argv[1] if len(sys.argv) > 1 else "", sys.argv[2:]))
