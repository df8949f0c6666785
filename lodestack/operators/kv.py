"""Key-value tables: rows ``row_key, cols map<string, string>`` over a log of mutations.

The log is append-only (``seq, op, row_key, cols``): ``cell`` merges columns
into a row, ``row`` replaces it. The current table is an aggregation of the
log, so writing never rewrites and reading never needs an order in the files.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack.operators import ranges
from lodestack.sources.staging import new_path, staged

#: What a log holds.
LOG = "seq long, op string, row_key string, cols map<string, string>"


def rows_of(df: DataFrame, key: Column, *names: str) -> DataFrame:
    """A typed table as key-value rows; null cells are absent."""
    cells = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(n).cast("string") for n in names]))
    return df.select(key.cast("string").alias("row_key"), F.map_filter(cells, lambda _, v: v.isNotNull()).alias("cols"))


def scan(table: DataFrame, start: str | None = None, stop: str | None = None) -> DataFrame:
    """Rows with ``start <= row_key < stop``; None is no bound. Both bounds reach the Parquet scan."""
    if start is not None:
        table = table.where(F.col("row_key") >= start)
    return table if stop is None else table.where(F.col("row_key") < stop)


def scan_path(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """The scan that an address ``/data/<table>/<start>/<end>`` names, with percent escapes; an empty bound is no bound, an unknown table has no rows."""
    _, data, name, start, stop = (unquote(x) for x in f"{path}//".split("/")[:5])
    if data != "data":
        raise ValueError(f"not a path of a scan: {path}")
    if name not in tables:
        return next(iter(tables.values())).limit(0)
    return scan(tables[name], start or None, stop or None)


def get_row(table: DataFrame, key: str) -> DataFrame:
    """The row, or no row."""
    return table.where(F.col("row_key") == key)


def get_cell(table: DataFrame, key: str, column: str) -> DataFrame:
    """``value`` of one cell; null if the row lacks the column."""
    return get_row(table, key).select(F.try_element_at("cols", F.lit(column)).alias("value"))


def exists(table: DataFrame, keys: DataFrame) -> DataFrame:
    """``row_key, found`` for each row of ``keys``, in one join."""
    held = table.select("row_key").distinct().withColumn("_held", F.lit(True))
    return keys.join(held, "row_key", "left").select("row_key", F.coalesce("_held", F.lit(False)).alias("found"))


def count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n"))


def latest_cells(log: DataFrame) -> DataFrame:
    """``row_key, col, value``: the last write of each cell of a log ``seq, row_key, col, value``."""
    return log.groupBy("row_key", "col").agg(F.max_by("value", "seq").alias("value"))


def latest_rows(log: DataFrame, seq: str = "seq", key: str = "row_key") -> DataFrame:
    """The last row of each key: a full-row log replayed. An aggregate with partial results, so a key's history is not sorted in one task."""
    last = log.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*log.columns), seq).alias("_row"))
    return last.select("_row.*")


def current(log: DataFrame) -> DataFrame:
    """The table that a mixed log ``seq, op, row_key, cols`` leaves: cells count from the key's last row replacement on.

    One aggregation by cell, with partial results, so a key with most of the log
    is not gathered: a row's last replacement goes through it as a cell without a name. Then a row's cells meet.
    """
    entries = F.transform(F.map_entries("cols"), lambda e: F.struct(e["key"].alias("col"), e["value"].alias("value")))
    mark = F.array(F.struct(F.lit(None).cast("string").alias("col"), F.lit(None).cast("string").alias("value")))
    cells = log.select("row_key", "seq", F.explode(F.concat(F.coalesce(entries, F.array().cast("array<struct<col:string,value:string>>")), F.when(F.col("op") == "row", mark).otherwise(F.slice(mark, 1, 0)))).alias("c"))
    last = cells.groupBy("row_key", F.col("c.col").alias("col")).agg(F.max("seq").alias("seq"), F.max_by("c.value", "seq").alias("value"))
    rows = last.groupBy("row_key").agg(F.max(F.when(F.col("col").isNull(), F.col("seq"))).alias("from"), F.collect_list(F.when(F.col("col").isNotNull(), F.struct("col", "seq", "value"))).alias("cells"))
    live = F.filter("cells", lambda c: F.col("from").isNull() | (c["seq"] >= F.col("from")))
    named = F.array_sort(F.transform(live, lambda c: F.struct(c["col"].alias("col"), c["value"].alias("value"))))
    return rows.select("row_key", F.map_from_entries(named).alias("cols")).where(F.size("cols") > 0)


def rows_as_of(log: DataFrame, reads: DataFrame) -> DataFrame:
    """The rows as they stood: ``row_key, at, cols`` for each distinct row of ``reads(row_key, at)``, where mutations up to the ``seq`` ``at`` count.

    Each column that the row ever had is looked up at that time, and the last
    replacement of the row too (``ranges.as_of_join``): a cell counts from it on. A
    row that held nothing then has no result, nor have nulls.
    """
    asked = ranges.spread_distinct(reads.select("row_key", "at").where("row_key is not null and at is not null"))
    cells = log.select("row_key", "seq", F.explode("cols").alias("col", "value"))
    columns = staged(cells.select("row_key", "col").distinct())
    wanted = asked.join(columns, "row_key").select("row_key", "col", F.col("at").alias("seq"))
    held = ranges.as_of_join(wanted, cells, ["row_key", "col"], "seq").where("seq_right is not null")
    replaced = log.where("op = 'row'").select("row_key", "seq")
    since = staged(ranges.as_of_join(asked.select("row_key", F.col("at").alias("seq")), replaced, ["row_key"], "seq").where("seq_right is not null").select("row_key", "seq", F.col("seq_right").alias("from")))
    live = held.join(since.hint("merge"), ["row_key", "seq"], "left").where("`from` is null or seq_right >= `from`")
    return live.groupBy("row_key", F.col("seq").alias("at")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "value")))).alias("cols"))


def append(log: DataFrame, path: str) -> None:
    """Add mutations to a log on disk."""
    log.write.mode("append").parquet(path)


def append_stream(log: DataFrame, path: str, checkpoint: str, every: str | None = "5 seconds") -> StreamingQuery:
    """Add a stream of mutations to a log on disk, ``every`` so often; None: all that is there now, and then end."""
    how = {"processingTime": every} if every else {"availableNow": True}
    return log.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**how).start(path)


def save_as(df: DataFrame, path: str) -> DataFrame:
    """Write a table under a new name; a name that is taken is an error."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Move a stored table. False, and nothing done, if the names are equal or the new one is taken."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    fs = a.getFileSystem(conf)
    return old != new and not fs.exists(b) and bool(fs.rename(a, b))


def table_list(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """``table_name, n_keys`` of each named table, given its key."""
    out = None
    for name, (df, key) in tables.items():
        one = df.agg(F.countDistinct(key).alias("n_keys")).select(F.lit(name).alias("table_name"), "n_keys")
        out = one if out is None else out.unionByName(one)
    return out


#: Up to so many rows a page is cut from the sorted head of a table; further down by a directory.
HEAD = 10_000


def page(table: DataFrame, offset: int, size: int = 10, key: str = "row_key") -> DataFrame:
    """One page of the rows by key, with ``has_next``. An offset beyond the table shows the first page.

    Near the head the first ``offset + size`` rows are sorted out; beyond ``HEAD``
    the table is stored by ranges of the key (``save_ranked``), and the page read from
    the ranges that hold it. For many pages of one table, store it once.
    """
    if offset + size > HEAD:
        path = new_path(table.sparkSession, "ranked")
        save_ranked(table, path, key)
        return page_ranked(table.sparkSession, path, offset, size, key)
    n = table.count()
    start = 0 if offset > n else offset
    shown = table.orderBy(key).offset(start).limit(size)
    return shown.withColumn("has_next", F.lit(n - start > size))


def save_ranked(table: DataFrame, path: str, key: str = "row_key") -> None:
    """Store a table by ranges of its key, each row with its place in the range, and a directory of how many rows each range has."""
    placed = table.repartitionByRange(key).withColumn("_range", F.spark_partition_id()).sortWithinPartitions(key)
    # The low bits of the id number the rows of a task, here in the order of the key.
    numbered = placed.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    numbered.write.partitionBy("_range").parquet(f"{path}/rows")
    table.sparkSession.createDataFrame([], numbered.schema).write.parquet(f"{path}/columns")  # so that a table without rows can be read too
    rows = table.sparkSession.read.schema(numbered.schema).parquet(f"{path}/rows")
    rows.groupBy("_range").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/directory")


def page_ranked(spark: SparkSession, path: str, offset: int, size: int = 10, key: str = "row_key") -> DataFrame:
    """A page of a table of ``save_ranked``. See ``page``.

    Only the ranges that hold it are read, usually one, and only the page's
    rows leave the scan.
    """
    rows = spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")
    held = sorted((r._range, r.n) for r in spark.read.schema("_range int, n long").parquet(f"{path}/directory").collect())  # a row for each range
    n = sum(of for _, of in held)
    start, before, wanted = 0 if offset > n else offset, 0, F.lit(False)
    for number, of in held:
        if before + of > start and before < start + size:
            wanted = wanted | ((F.col("_range") == number) & (F.col("_place") >= max(0, start - before)) & (F.col("_place") < start + size - before))
        before += of
    shown = rows.where(wanted).drop("_range", "_place").orderBy(key)
    return shown.withColumn("has_next", F.lit(n - start > size))
