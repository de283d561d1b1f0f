"""Arrays to rows without a derived filter.

A plain ``explode`` lets the optimizer add ``size(array) > 0`` and push it below
the projections that built the array, which computes the array twice and puts
shared inputs inside lambdas. The outer form with a test on the position avoids
that and gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, keep: list, array: Column | str, value: str = "value", pos: str | None = None) -> DataFrame:
    """One row per array element: kept columns, the element, and its position when named."""
    out = df.select(*keep, F.posexplode_outer(array).alias("_pos", value)).where(F.col("_pos").isNotNull())
    return out.withColumnRenamed("_pos", pos) if pos else out.drop("_pos")


def spread_structs(df: DataFrame, keep: list, array: Column | str) -> DataFrame:
    """One row per struct element, its fields as columns."""
    out = spread(df, keep, array, "_s")
    return out.select(*[c for c in out.columns if c != "_s"], "_s.*")


def settle(df: DataFrame) -> DataFrame:
    """A point the optimizer does not merge projections across.

    Columns built below are computed once, whatever refers to them above. The
    filter is always true; it tests a non-deterministic column, so it cannot
    move below the projection. Later filters do not move below it either: it
    belongs after the source has been filtered and pruned.
    """
    return df.withColumn("_settled", F.rand(0)).where(F.col("_settled") >= 0).drop("_settled")
