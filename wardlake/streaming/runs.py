"""Start, drain and read back streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardlake.session import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table's Parquet files as a stream; timestamps become instants for watermarks.

    The table is one file, several whose names begin alike, or a folder of part files.
    """
    root = folder.rstrip("/")
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{root}/{name}*.parquet")
    return with_instants(df)


def with_instants(df: DataFrame) -> DataFrame:
    """Zone-less timestamps as instants."""
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def drain_to_table(stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Process everything available into a Parquet table in the shared folder and read it back."""
    spark = stream.sparkSession
    out, log = shared_folder(spark, f"{purpose}-out"), shared_folder(spark, f"{purpose}-log")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", log)
        .trigger(availableNow=True).start()
    )
    _finish(query)
    return spark.read.schema(stream.schema).parquet(out)


def drain_each(stream: DataFrame, purpose: str, step: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything available through a per-batch function."""
    log = shared_folder(stream.sparkSession, f"{purpose}-log")
    query = (
        stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True).start()
    )
    _finish(query)


def _finish(query: StreamingQuery) -> None:
    try:
        query.awaitTermination()
    finally:
        query.stop()
