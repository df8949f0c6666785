"""Sessions, and getting the package to their workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", app: str = "lodestack") -> SparkSession:
    """A local session; on a cluster, spark-submit's settings hold and this is not used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def make_importable(spark: SparkSession) -> None:
    """See that Python workers can import this package.

    They can where its folder is the working directory or on PYTHONPATH, as on
    a cluster set up for it; otherwise the package goes to them with Spark's
    own file distribution, once for each context.
    """
    root = Path(__file__).resolve().parents[1]
    known = [Path.cwd(), *(Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)]
    context = spark.sparkContext
    if root in known or context.applicationId in _shipped:
        return
    packed = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="lodestack-")) / "lodestack"), "zip", root, "lodestack")
    context.addPyFile(packed)
    _shipped.add(context.applicationId)
