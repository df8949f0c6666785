"""Tables between the rounds of an iteration, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session, as in tests, may do without: it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lodestack-"))
        found = _own[0]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str = "staged") -> str:
    """A path in the shared folder that nothing has yet; what is written there goes when the program ends, or with ``delete``."""
    path = f"{folder(spark)}/{name}/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def staged(df: DataFrame) -> DataFrame:
    """Write and re-read: the lineage ends here, and losing an executor costs a read."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of ``new_path``; call it when nothing built on it is still to be read."""
    if (spark, path) in _written:
        _written.remove((spark, path))
    if spark.sparkContext._jsc is None:  # the session has ended, and its folder may be gone
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clear() -> None:
    for spark, path in list(_written):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before
            return


atexit.register(_clear)
