"""Reading inputs and keeping intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.session import shared_folder


#: With it Spark removes the shuffle files of a query when the query ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read back.

    Cuts the lineage: a lost executor costs a reread, not the work before. So the shuffle files of that work go at once.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def released(*tables: DataFrame) -> None:
    """Removes kept tables. No frame that is still to run may read them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def order_chunk(df: DataFrame, column: str, per_partition: int = 4) -> Column:
    """The chunk of a row in the order of ``column``: chunks ascend with it and hold about as many rows.

    The bounds are approximate quantiles, at most ``per_partition`` per shuffle partition, so the
    driver holds a few thousand numbers. Nulls are in chunk -1. Any bounds give right results.
    """
    parts = min(2048, per_partition * shuffle_width(df.sparkSession))
    marks = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(column, marks, 100 * parts).alias("q")).first()["q"] or []
    cuts = sorted(set(found))
    if not cuts:
        return F.when(F.col(column).isNull(), -1).otherwise(0)
    # Two steps, so that a row meets about twice the root of the number of bounds.
    step = max(1, int(len(cuts) ** 0.5))
    coarse = F.array(*[F.lit(int(c)) for c in cuts[::step]])
    fine = F.array(*[F.array(*[F.lit(int(c)) for c in cuts[i : i + step]]) for i in range(0, len(cuts), step)])
    value = F.col(column)
    group = F.size(F.filter(coarse, lambda c: c <= value))
    inner = F.size(F.filter(F.get(fine, group - 1), lambda c: c <= value))
    return F.when(value.isNull(), -1).when(group == 0, 0).otherwise((group - 1) * step + inner)
