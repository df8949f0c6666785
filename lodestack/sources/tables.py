"""The Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.sources.staging import new_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table as a stream: its rows are laid down as the files of a folder, from which the stream reads."""
    stored, path = read(spark, sf_dir, name), new_path(spark, "arrivals")
    stored.write.parquet(path)
    return spark.readStream.schema(stored.schema).parquet(path)
