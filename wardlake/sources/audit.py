"""The append-only audit table.

``append`` and ``read`` serve a plain folder. ``commit`` and ``committed`` add batches that count once: a batch
writes its files to a folder of its own and then one small file that names it. Readers go by those names, so an
attempt that died, or lost against another one of the same batch, is never seen.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMIT = "batch_id string, attempt string, n_events long, first_day string, last_day string, schema string"


def append(events: DataFrame, path: str) -> None:
    """Append events, one folder per day; rows are rebalanced by day, and a large day is split by its size."""
    events.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(path)


def read(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Stored events; ``since`` prunes whole days."""
    df = spark.read.parquet(path)
    return df.where(F.col("event_date") >= F.lit(since).cast("date")) if since else df


def _files(spark: SparkSession, path: str):
    """Hadoop's file context of a path, and a maker of its paths."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    context = hadoop.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()) if place.toUri().getScheme() else hadoop.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    return context, hadoop.Path


def commit(events: DataFrame, path: str, batch_id: str) -> bool:
    """Append the events of a batch unless that batch is there already; says whether this call added it.

    Within a batch the files lie by day and carry bloom filters on the interaction. The batch becomes
    visible by one rename that fails when the name is taken, so of two attempts one counts.
    """
    spark = events.sparkSession
    context, place = _files(spark, path)
    mark = f"{path}/commits/{hashlib.sha256(batch_id.encode()).hexdigest()}.json"
    if context.util().exists(place(mark)):
        return False
    attempt = f"attempt={uuid.uuid4().hex}"
    writer = events.hint("rebalance", "event_date").write.partitionBy("event_date").option("parquet.bloom.filter.enabled#interaction_id", "true")
    writer.parquet(f"{path}/events/{attempt}")
    # Counted from footers and folder names.
    day = F.col("event_date").cast("string")
    written = spark.read.schema(events.schema).parquet(f"{path}/events/{attempt}")
    found = written.agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first"), F.max(day).alias("last")).first()
    row = {
        "batch_id": batch_id, "attempt": attempt, "n_events": found["n"], "first_day": found["first"], "last_day": found["last"],
        "schema": events.schema.json(),
    }
    pending = f"{path}/pending/{attempt}"
    spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.text(pending)
    part = next(p for p in _listed(context, place, pending) if p.getName().startswith("part-"))
    hadoop = spark._jvm.org.apache.hadoop.fs
    context.mkdir(place(f"{path}/commits"), hadoop.permission.FsPermission.getDirDefault(), True)
    try:
        context.rename(part, place(mark), spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception.getClass().getName()):
            raise
        return False
    return True


def _listed(context, place, folder: str) -> list:
    found, out = context.listStatus(place(folder)), []
    while found.hasNext():
        out.append(found.next().getPath())
    return out


def committed(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Events of all committed batches, each once; ``since`` leaves out batches and days before it.

    The driver reads one row per batch, as it lists the files of those batches in any case.
    """
    batches = spark.read.schema(COMMIT).json(f"{path}/commits").collect()
    if not batches:
        raise ValueError(f"no batch was committed to {path}")
    schema = StructType.fromJson(json.loads(max(batches, key=lambda b: b["batch_id"])["schema"]))
    wanted = [f"{path}/events/{b['attempt']}" for b in batches if b["n_events"] and (since is None or (b["last_day"] or "") >= since)]
    if not wanted:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("basePath", f"{path}/events").parquet(*wanted).select(*schema.names)
    return df.where(F.col("event_date") >= F.lit(since).cast("date")) if since else df
