"""Exact top-k cosine search in a corpus too large to hand to every task: cells, bounds, two rounds.

Corpus vectors are grouped into cells around centroids. A cell keeps its widest angle and the
largest and smallest value of each component; either limits the cosine that any of its vectors
can have with a query. A query first meets the cells nearest to it, which gives a k-th best
cosine, and then only those cells whose bound reaches that. Every bound holds for all vectors of
a cell, so the result is that of comparing everything, whatever the centroids are.

Equal corpus vectors count once, with their k smallest ids, and equal query vectors are searched
once, so groups of copies cost nothing. A large cell is split into shards and the queries of a
much visited cell into slices; both have a bounded size, so no key of the exchange is hot.

Driver: a sample of at most ``SAMPLE`` vectors for the centroids and one row per cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.sources.tables import stored

MAX_CELLS = 1024
SAMPLE = 4096
SHARD_ROWS = 4096
SLICE_ROWS = 4096
DIGITS = 6
#: Cosines are rounded before they are compared, so a bound may fall short by one unit of the last digit.
SLACK = 2 * 10.0**-DIGITS


def unit_rows(vectors: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and a mask: false for null and ragged vectors and those with null or non-finite components."""
    fits = np.fromiter((v is not None and len(v) == dims for v in vectors), bool, len(vectors))
    out = np.zeros((len(vectors), dims))
    if fits.any():
        out[fits] = np.array([np.asarray(v, dtype=float) for v, ok in zip(vectors, fits, strict=True) if ok]).reshape(-1, dims)
    fits &= np.isfinite(out).all(axis=1)
    out[~fits] = 0.0
    largest = np.abs(out).max(axis=1, keepdims=True, initial=0.0)
    out /= np.where(largest > 0, largest, 1.0)
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norms > 0, norms, 1.0), fits


def with_units(df: DataFrame, dims: int) -> DataFrame:
    """``vector`` scaled to length one; rows whose vector can't be used are left out, zero vectors stay."""

    @F.pandas_udf("array<double>")
    def unit(vector: pd.Series) -> pd.Series:
        rows, fits = unit_rows(vector.tolist(), dims)
        return pd.Series([r if ok else None for r, ok in zip(rows, fits, strict=True)], dtype=object)

    return df.withColumn("vector", unit("vector")).where("vector IS NOT NULL")


def usual_length(corpus: DataFrame) -> int:
    """The most frequent length of the vectors (the larger of equally frequent ones); 0 without any."""
    sizes = corpus.where("vector IS NOT NULL").groupBy(F.size("vector").alias("n")).count()
    found = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    return int(found["n"]) if found else 0


def best(queries: np.ndarray, corpus: np.ndarray, ids: list, k: int) -> list[list[tuple]]:
    """The k nearest of ids (in their order for ties) for each query, cosines rounded."""
    out: list[list[tuple]] = []
    for lo in range(0, len(queries), 1024):
        sims = np.round(queries[lo : lo + 1024] @ corpus.T, DIGITS) + 0.0
        order = np.argsort(-sims, axis=1, kind="stable")[:, : min(k, len(ids))]
        out.extend([(ids[j], float(row[j])) for j in nearest] for row, nearest in zip(sims, order, strict=True))
    return out


def _centroids(sample: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """Spherical k-means from every few-th distinct row of the sample."""
    rows = np.unique(sample[(sample * sample).sum(axis=1) > 0], axis=0)
    if not len(rows):
        return np.zeros((1, sample.shape[1]))
    centres = rows[np.linspace(0, len(rows) - 1, min(n, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1.0), centres)
    return centres


@dataclass(frozen=True)
class Bounds:
    """One row per cell: the centroid, the widest angle to it, component limits, number of vectors."""

    cells: np.ndarray
    centres: np.ndarray
    widest: np.ndarray
    high: np.ndarray
    low: np.ndarray
    counts: np.ndarray

    def upper(self, queries: np.ndarray) -> np.ndarray:
        """The largest cosine that a vector of each cell may have with each query."""
        apart = np.arccos(np.clip(queries @ self.centres.T, -1, 1)) - self.widest
        by_angle = np.cos(np.clip(apart, 0, math.pi))
        by_component = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        # A zero query has cosine 0 with everything; angles say nothing about it.
        zero = ~queries.any(axis=1, keepdims=True)
        return np.where(zero, 0.0, np.minimum(by_angle, by_component))

    def homes(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query its nearest cells that hold k vectors together."""
        order = np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")
        need = (np.cumsum(self.counts[order], axis=1) < k).sum(axis=1) + 1
        return [row[:n] for row, n in zip(order, need, strict=True)]


@dataclass(frozen=True)
class Index:
    rows: DataFrame  # corpus_id, vector, cell
    bounds: Bounds
    k: int


def build(corpus: DataFrame, sample: DataFrame, k: int) -> Index:
    """The index of corpus rows (corpus_id, vector of length one) for searches of at most ``k`` neighbours.

    ``sample`` holds some of these rows; it shapes the cells and so the speed only.
    """
    picked = [r["vector"] for r in sample.select("vector").limit(SAMPLE).collect()]
    dims = len(picked[0]) if picked else 1
    n_cells = min(MAX_CELLS, max(1, math.isqrt(corpus.count())))
    centres = _centroids(np.array(picked, dtype=float).reshape(-1, dims), n_cells)

    @F.pandas_udf("int")
    def nearest(vector: pd.Series) -> pd.Series:
        return pd.Series((np.stack(vector.to_list()) @ centres.T).argmax(axis=1).astype("int32"))

    same = Window.partitionBy("_h", "vector").orderBy("corpus_id")
    once = corpus.withColumn("_h", F.xxhash64("vector")).withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k)
    rows = stored(once.select("corpus_id", "vector", nearest("vector").alias("cell")), "cells")
    return Index(rows, _bounds(rows, centres), k)


def _bounds(rows: DataFrame, centres: np.ndarray) -> Bounds:
    n_cells, dims = centres.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, near = np.zeros(n_cells, np.int64), np.ones(n_cells)
        high, low = np.full((n_cells, dims), -np.inf), np.full((n_cells, dims), np.inf)
        for batch in batches:
            if batch.empty:
                continue
            cell, vectors = batch["cell"].to_numpy(), np.stack(batch["vector"].to_list())
            np.add.at(counts, cell, 1)
            np.minimum.at(near, cell, (vectors * centres[cell]).sum(axis=1))
            np.maximum.at(high, cell, vectors)
            np.minimum.at(low, cell, vectors)
        held = np.flatnonzero(counts)
        yield pd.DataFrame({"cell": held.astype("int32"), "n": counts[held], "near": near[held], "high": list(high[held]), "low": list(low[held])})

    parts = rows.select("vector", "cell").mapInPandas(partial, "cell int, n long, near double, high array<double>, low array<double>")
    limits = parts.select("cell", "n", "near", F.posexplode(F.arrays_zip("high", "low")).alias("i", "z"))
    each = limits.groupBy("cell", "i").agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("z.high").alias("high"), F.min("z.low").alias("low"))
    cells = each.groupBy("cell").agg(F.max("n").alias("n"), F.min("near").alias("near"), F.array_sort(F.collect_list(F.struct("i", "high", "low"))).alias("z"))
    found = cells.select("cell", "n", "near", "z.high", "z.low").orderBy("cell").collect()
    number = np.array([r["cell"] for r in found], dtype=int)
    # The angle is widened by more than the error of a product of unit vectors.
    widest = np.arccos(np.clip(np.array([r["near"] for r in found], dtype=float), -1, 1)) + 1e-6
    high, low = (np.array([r[c] for r in found], dtype=float).reshape(-1, dims) for c in ("high", "low"))
    return Bounds(number, centres[number], widest, high, low, np.array([r["n"] for r in found], dtype=np.int64))


def query_key() -> Column:
    """128 bits of a hash of ``vector``."""
    return F.concat(F.hex(F.xxhash64("vector")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "vector")))


def search(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """Rows (query_key, rank, match_id, similarity) for the distinct unit vectors of ``queries`` (column vector)."""
    if k > index.k:
        raise ValueError("the index keeps fewer copies of a vector than neighbours are asked for")
    asked = stored(queries.select(query_key().alias("query_key"), "vector").dropDuplicates(["query_key"]), "queries")
    first = stored(_scan(visits(asked, index, k), index, k), "first-round")
    ranked = Window.partitionBy("query_key").orderBy(F.desc("similarity"), "match_id")
    kth = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("query_key", F.col("similarity").alias("kth"))
    second = _scan(visits(asked.join(kth, "query_key", "left"), index, k), index, k)
    found = first.unionByName(second).withColumn("rank", F.row_number().over(ranked))
    return found.where(F.col("rank") <= k).select("query_key", "rank", "match_id", "similarity")


def visits(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """Which cells each query meets (query_key, vector, cell): the nearest ones, or with a column ``kth`` all others that may hold better rows."""
    bounds = index.bounds
    names = bounds.cells

    @F.pandas_udf("array<int>")
    def home(vector: pd.Series) -> pd.Series:
        if not len(names):
            return pd.Series([np.zeros(0, "int32")] * len(vector))
        return pd.Series([names[h].astype("int32") for h in bounds.homes(np.stack(vector.to_list()), k)])

    @F.pandas_udf("array<int>")
    def others(vector: pd.Series, kth: pd.Series) -> pd.Series:
        if not len(names):
            return pd.Series([np.zeros(0, "int32")] * len(vector))
        rows = np.stack(vector.to_list())
        reach = bounds.upper(rows) >= kth.fillna(-2.0).to_numpy(dtype=float)[:, None] - SLACK
        for row, seen in zip(reach, bounds.homes(rows, k), strict=True):
            row[seen] = False
        return pd.Series([names[r].astype("int32") for r in reach])

    chosen = others("vector", "kth") if "kth" in asked.columns else home("vector")
    return asked.select("query_key", "vector", F.explode(chosen).alias("cell"))


def _scan(met: DataFrame, index: Index, k: int) -> DataFrame:
    """The k best rows of each shard for the queries that meet its cell."""
    # One row per cell each, so at most MAX_CELLS rows are broadcast.
    slices = met.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(SLICE_ROWS)).cast("int").alias("n_slices"))
    held = zip(index.bounds.cells.tolist(), (-(-index.bounds.counts // SHARD_ROWS)).tolist(), strict=True)
    shards = met.sparkSession.createDataFrame(list(held), "cell int, n_shards int")
    sizes = F.broadcast(slices.join(shards, "cell"))
    left = met.join(sizes, "cell").select(
        "query_key", "vector", "cell", F.pmod(F.xxhash64("query_key"), "n_slices").cast("int").alias("slice"),
        F.explode(F.sequence(F.lit(0), F.col("n_shards") - 1)).alias("shard"),
    )
    right = index.rows.join(sizes, "cell").select(
        "corpus_id", "vector", "cell", F.pmod(F.xxhash64("corpus_id"), "n_shards").cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)).alias("slice"),
    )

    def rank(queries: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
        names = ["query_key", "match_id", "similarity"]
        if queries.empty or corpus.empty:
            return pd.DataFrame({c: [] for c in names})
        corpus = corpus.sort_values("corpus_id")
        found = best(np.stack(queries["vector"].to_list()), np.stack(corpus["vector"].to_list()), list(corpus["corpus_id"]), k)
        return pd.DataFrame([(key, i, s) for key, rows in zip(queries["query_key"], found, strict=True) for i, s in rows], columns=names)

    kind = index.rows.schema["corpus_id"].dataType.simpleString()
    keys = ["cell", "shard", "slice"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rank, f"query_key string, match_id {kind}, similarity double")
