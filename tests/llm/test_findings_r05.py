"""op1_iblt_fingerprints: the partitions of the document order are about as large, so no task needs far more memory than the others."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wardlake.llm import fingerprints


@pytest.fixture()
def width(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "51")
    yield 51
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_even_partitions_of_the_order(spark, width):
    n = 30_600
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    got = fingerprints.with_next(docs).withColumn("part", F.spark_partition_id())
    rows = [r["n"] for r in got.groupBy("part").agg(F.count("doc_id").alias("n")).collect()]
    assert sum(rows) == n
    assert max(rows) < 1.8 * n / width, sorted(rows)
    follows = F.when(F.col("doc_id") == 0, n - 1).otherwise(F.col("doc_id") - 1)
    assert got.where(F.col("next_text") != F.concat(F.lit("text "), follows.cast("string"))).count() == 0
