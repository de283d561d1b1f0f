"""Hashed text vectors: tokens are hashed in the JVM, arithmetic runs on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from wardlake import fixed
from wardlake.functions.hashing import bucket
from wardlake.functions.text import words

DIMS = 384
WORD_WEIGHT = 1.0
PAIR_WEIGHT = 1.5


def with_buckets(
    df: DataFrame, text: Column, out: str, dims: int = DIMS, stopwords: bool = False
) -> DataFrame:
    """Add ``out``: struct of the bucket numbers of all words and of all word pairs."""
    found = words(F.lower(F.coalesce(text, F.lit(""))))
    df = df.withColumn("_w", found)
    if stopwords:
        kept = F.filter("_w", lambda w: ~w.isin(*fixed.STOPWORDS))
        df = df.withColumn("_kept", kept).withColumn(
            "_w", F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.col("_w"))
        )
    pairs = F.when(
        F.size("_w") > 1,
        F.zip_with(
            F.slice("_w", F.lit(1), F.size("_w") - 1),
            F.slice("_w", F.lit(2), F.size("_w") - 1),
            lambda a, b: bucket(F.concat(a, F.lit("_"), b), dims),
        ),
    ).otherwise(F.array().cast("array<int>"))
    return df.withColumn(
        out, F.struct(F.transform("_w", lambda w: bucket(w, dims)).alias("one"), pairs.alias("two"))
    ).drop("_w", "_kept")


#: Dense rows made at a time: what a task of Python holds follows this, not the rows of an Arrow batch.
BLOCK_ROWS = 1024


def sizes(lists: pa.Array) -> np.ndarray:
    """Lengths of lists; null ones have none."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def dense_batch(one: pa.Array, two: pa.Array, dims: int = DIMS) -> np.ndarray:
    """Unit vectors of lists of bucket numbers, one row per text; a text without words stays zero."""
    out = np.zeros((len(one), dims))
    for lists, weight in ((one, WORD_WEIGHT), (two, PAIR_WEIGHT)):
        lengths = sizes(lists)
        if lengths.sum():
            rows = np.repeat(np.arange(len(lists)), lengths)
            cols = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            out += weight * np.bincount(rows * dims + cols, minlength=out.size).reshape(out.shape)
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norms > 0, norms, 1.0)


def dense_blocks(one: pa.Array, two: pa.Array, dims: int = DIMS) -> Iterator[np.ndarray]:
    """``dense_batch`` in blocks of bounded size."""
    for lo in range(0, len(one), BLOCK_ROWS):
        yield dense_batch(one.slice(lo, BLOCK_ROWS), two.slice(lo, BLOCK_ROWS), dims)


def listed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def joined(parts: list, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([p.cast(kind) for p in parts]) if parts else pa.array([], kind)


def dense_vector(buckets: Column, dims: int = DIMS) -> Column:
    """The text's unit vector as ``array<double>``."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def to_dense(one: pa.Array, two: pa.Array) -> pa.Array:
        return joined([listed(rows) for rows in dense_blocks(one, two, dims)], pa.list_(pa.float64()))

    return to_dense(buckets["one"], buckets["two"])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense arrays, 0 where either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot / scale).otherwise(F.lit(0.0))
