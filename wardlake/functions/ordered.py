"""Running totals, ranks and look-back over ordered rows without a hot task.

A plain window over a key puts every row of that key into one task. Here each
key is cut into chunks that follow the order (minutes of a timestamp, hundreds
of a turn number, prefixes of a digest). The window runs inside a chunk; one
small row per (key, chunk) carries the total of all earlier chunks. Results are
the same as with the plain window, and a key that holds most rows is spread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minute_chunk(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def block_chunk(number: Column, size: int = 4096) -> Column:
    return F.floor(number / F.lit(size)).cast("long")


def digest_chunk(digest: Column, chars: int = 3) -> Column:
    return F.substring(digest, 1, chars)


def running_sum(
    df: DataFrame,
    keys: list[str],
    chunk: Column,
    order: list[Column],
    value: Column,
    out: str,
    before: bool = False,
) -> DataFrame:
    """Sum of ``value`` over all rows of the key up to this one (or before it)."""
    work = df.withColumn("_chunk", chunk).withColumn("_value", value)
    chunk_keys = [*keys, "_chunk"]
    totals = work.groupBy(*chunk_keys).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*chunk_keys, F.sum("_total").over(earlier).alias("_carried"))
    last = -1 if before else 0
    inside = Window.partitionBy(*chunk_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    zero = F.lit(0)
    return (
        work.join(carried, chunk_keys)
        .withColumn(out, F.coalesce(F.col("_carried"), zero) + F.coalesce(F.sum("_value").over(inside), zero))
        .drop("_chunk", "_value", "_carried")
    )


def running_count(df: DataFrame, keys: list[str], chunk: Column, order: list[Column], out: str) -> DataFrame:
    """Exact row number of every row within its key."""
    return running_sum(df, keys, chunk, order, F.lit(1).cast("long"), out)


def previous(
    df: DataFrame, keys: list[str], chunk: Column, order: list[str], value: str, out: str
) -> DataFrame:
    """``value`` of the preceding row of the key, null for the first one."""
    work = df.withColumn("_chunk", chunk)
    chunk_keys = [*keys, "_chunk"]
    tails = work.groupBy(*chunk_keys).agg(F.max_by(F.col(value), F.struct(*order)).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    carried = tails.select(*chunk_keys, F.lag("_tail").over(across).alias("_carried"))
    inside = Window.partitionBy(*chunk_keys).orderBy(*order)
    return (
        work.join(carried, chunk_keys)
        .withColumn(
            out,
            F.when(F.row_number().over(inside) == 1, F.col("_carried")).otherwise(F.lag(value).over(inside)),
        )
        .drop("_chunk", "_carried")
    )


def last_known(df: DataFrame, keys: list[str], chunk: Column, order: list[str], value: str, out: str) -> DataFrame:
    """The newest non-null ``value`` of the key up to each row; rows with null keys or a null chunk stay."""
    work = df.withColumn("_chunk", chunk)
    chunk_keys = [*keys, "_chunk"]
    place = F.struct(*order)
    tails = work.groupBy(*chunk_keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), place)).alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*[F.col(c).alias(f"_of_{c}") for c in chunk_keys], F.last("_tail", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy(*chunk_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in chunk_keys])
    return (
        work.join(carried, same)
        .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carried")))
        .drop("_chunk", "_carried", *[f"_of_{c}" for c in chunk_keys])
    )
