"""Lexicon tables (term, tier) for the scan in operators.lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """A CSV lexicon with columns term and tier."""
    return (
        spark.read.csv(path, header=True, schema="term string, tier string")
        .select(F.lower(F.trim("term")).alias("term"), F.lower(F.trim("tier")).alias("tier"))
        .where(F.length("term") > 0)
    )
