"""Parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardlake.session import shared_folder

_SPLITS: dict[tuple[str, str, int], int] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str, *keys: str) -> DataFrame:
    """A table for work that is heavy per row.

    A table of few files or row groups would use few cores, so it is spread by
    its keys; one with at least as many splits as cores is read as it lies.
    """
    df = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    place = (folder, name, cores)
    if place not in _SPLITS:
        _SPLITS[place] = df.rdd.getNumPartitions()
    return df.repartition(cores, *keys) if _SPLITS[place] < cores else df


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written to the folder that all executors share and read back: later steps read them again instead of computing them."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
