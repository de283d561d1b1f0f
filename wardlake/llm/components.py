"""Connected components of a large graph by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.tables import kept, released


#: A node with at least this share of all edges has its minimum broadcast: there are at most 2 / HOT_SHARE such nodes.
HOT_SHARE = 1 / 500


def _with_least(edges: DataFrame, n_edges: int) -> DataFrame:
    """Edges (a, b) with the smallest b of their a; those of nodes with very many edges stay where they are."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    limit = max(2, int(n_edges * HOT_SHARE))
    hot = F.broadcast(least.where(F.col("n") >= limit).select("a", F.col("m").alias("_hot")))
    cold = least.where(F.col("n") < limit).select(F.col("a").alias("_key"), F.col("m").alias("_cold"))
    # Edges that have their minimum are dealt by their other end, and what they may meet there is not used.
    met = edges.join(hot, "a", "left").withColumn("_key", F.when(F.col("_hot").isNull(), F.col("a")).otherwise(F.xxhash64("b")))
    return met.join(cold, "_key", "left").select("a", "b", F.coalesce("_hot", "_cold").alias("m"))


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, n_edges).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Each neighbour meets the minimum; the minimum itself meets the node.
    return _with_least(down, n_edges).select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (columns a and b): the root is the smallest node of its component.

    Minima are aggregated before they are shuffled, and the edges of a node with very many are not dealt by it. The
    number of rounds grows with the logarithm of the number of nodes.
    """
    now = kept(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    last, n_edges = None, now.count()
    while n_edges:
        before, now = now, kept(_small_star(_large_star(now, n_edges), n_edges).where(F.col("a") != F.col("b")).distinct(), "stars")
        released(before)
        seen = now.agg(mark.alias("m")).first()["m"]
        if seen == last:
            break
        last, n_edges = seen, seen["n"]
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
