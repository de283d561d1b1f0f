"""Top-k cosine search of texts or vectors against a corpus.

A corpus within the size limit is shipped to the tasks and the scan stays one
narrow stage. A larger one is searched by cells with bounds (``cells``). Both
ways are exact, and equal similarities go to the smaller corpus id in its own
type. Null vectors, vectors of another length than the corpus's usual one and
those with null or non-finite components take no part, nor do corpus rows
without an id; a zero vector has similarity 0 with everything.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions import vectors
from wardlake.functions.rows import spread
from wardlake.operators import cells
from wardlake.session import bounded_rows

MAX_CORPUS = 4096
#: Texts whose dense vectors a task makes and compares at a time.
QUERY_BLOCK = vectors.BLOCK_ROWS
MATCHES = "array<struct<match_id:string,similarity:double>>"


def embed(df: DataFrame, text_col: str = "text", out: str = "vector", stopwords: bool = False) -> DataFrame:
    return vectors.with_buckets(df, F.col(text_col), "_b", stopwords=stopwords).withColumn(
        out, vectors.dense_vector(F.col("_b"))
    ).drop("_b")


def sparse_rows(df: DataFrame, id_col: str, text_col: str = "text", stopwords: bool = False) -> DataFrame:
    """Non-zero entries of the hashed vectors: (id, bucket, weight)."""
    dense = embed(df.select(id_col, text_col), text_col, stopwords=stopwords)
    return spread(dense, [id_col], "vector", "weight", "bucket").where("weight <> 0")


def _listed(found: list[list[tuple]]) -> pd.Series:
    return pd.Series([[{"match_id": i, "similarity": s} for i, s in rows] for rows in found], dtype=object)


def _text_ranker(corpus: np.ndarray, ids: list[str], k: int):
    kind = pa.list_(pa.struct([("match_id", pa.string()), ("similarity", pa.float64())]))
    size = QUERY_BLOCK

    @F.arrow_udf(MATCHES)
    def rank(one: pa.Array, two: pa.Array) -> pa.Array:
        blocks = (vectors.dense_batch(one.slice(lo, size), two.slice(lo, size)) for lo in range(0, len(one), size))
        found = (cells.best(rows, corpus, ids, k) for rows in blocks)
        return vectors.joined([pa.array([[{"match_id": i, "similarity": s} for i, s in m] for m in block], kind) for block in found], kind)

    return rank


def _vector_ranker(corpus: np.ndarray, ids: list[str], k: int):
    @F.pandas_udf(MATCHES)
    def rank(vector: pd.Series) -> pd.Series:
        rows, fits = cells.unit_rows(vector.tolist(), corpus.shape[1])
        return _listed([m if ok else [] for m, ok in zip(cells.best(rows, corpus, ids, k), fits, strict=True)])

    return rank


def _large(queries: DataFrame, corpus: DataFrame, k: int, make) -> DataFrame:
    """Queries with ``_found``, their matches in a corpus too large to ship; ``make`` adds unit vectors to rows as ``vector``."""
    some = corpus.orderBy(F.xxhash64("corpus_id")).limit(cells.SAMPLE)
    index = cells.build(make(corpus).select("corpus_id", "vector"), make(some), k)
    with_key = make(queries).withColumn("query_key", cells.query_key())
    found = cells.search(with_key, index, k)
    listed = found.groupBy("query_key").agg(F.array_sort(F.collect_list(F.struct("rank", "match_id", "similarity"))).alias("_l"))
    matches = F.transform("_l", lambda m: F.struct(m["match_id"].cast("string").alias("match_id"), m["similarity"].alias("similarity")))
    return with_key.join(listed.select("query_key", matches.alias("_found")), "query_key", "left").drop("query_key", "vector")


def with_matches(queries: DataFrame, id_col: str, text_col: str, corpus: DataFrame, k: int, out: str) -> DataFrame:
    """Add the ``k`` best corpus items of each text as an array.

    Corpus columns: corpus_id, text. Within the limit this is row-local; a
    larger corpus is searched by cells and the matches join back by vector.
    """
    corpus = corpus.select("corpus_id", "text").where("corpus_id IS NOT NULL")
    rows = bounded_rows(embed(corpus).orderBy("corpus_id"), MAX_CORPUS)
    if rows is None:
        plain = queries.withColumn("_text", F.col(text_col))
        joined = _large(plain, corpus.withColumnRenamed("text", "_text"), k, lambda df: embed(df, "_text", "vector")).drop("_text")
        return joined.withColumn(out, F.coalesce("_found", F.array().cast(MATCHES))).drop("_found")
    if not rows:
        return queries.withColumn(out, F.array().cast(MATCHES))
    matrix = np.array([r["vector"] for r in rows], dtype=float)
    ranker = _text_ranker(matrix, [str(r["corpus_id"]) for r in rows], k)
    return (
        vectors.with_buckets(queries, F.col(text_col), "_b")
        .withColumn(out, ranker("_b.one", "_b.two"))
        .drop("_b")
    )


def top_k(queries: DataFrame, id_col: str, corpus: DataFrame, k: int = 3, vector_col: str | None = None) -> DataFrame:
    """Rows (id, rank, match_id, similarity) for texts, or for dense vectors when a column is named.

    Corpus columns: corpus_id and text, or corpus_id and vector.
    """
    named = corpus.where("corpus_id IS NOT NULL")
    if vector_col is None:
        q, c = queries.select(id_col, "text"), named.select("corpus_id", "text")
        make, dims = embed, vectors.DIMS
    else:
        q = queries.select(id_col, F.col(vector_col).cast("array<double>").alias("vector"))
        c = named.select("corpus_id", F.col("vector").cast("array<double>").alias("vector"))
        dims = cells.usual_length(c)

        def make(df: DataFrame) -> DataFrame:
            return cells.with_units(df, dims)

    rows = bounded_rows(make(c).select("corpus_id", "vector").orderBy("corpus_id"), MAX_CORPUS)
    if rows is None:
        scored = _large(q, c, k, make).select(id_col, F.col("_found").alias("m"))
    elif not rows:
        return q.select(id_col, F.lit(1).alias("rank"), F.lit("").alias("match_id"), F.lit(0.0).alias("similarity")).limit(0)
    else:
        matrix, ids = np.array([r["vector"] for r in rows], dtype=float).reshape(-1, dims), [str(r["corpus_id"]) for r in rows]
        if vector_col is None:
            scored = vectors.with_buckets(q, F.col("text"), "_b").select(id_col, _text_ranker(matrix, ids, k)("_b.one", "_b.two").alias("m"))
        else:
            scored = q.select(id_col, _vector_ranker(matrix, ids, k)("vector").alias("m"))
    return spread(scored, [id_col], "m", "match", "p").select(
        id_col, (F.col("p") + 1).alias("rank"), "match.match_id", "match.similarity"
    )


def max_similarity(matches: Column) -> Column:
    return F.round(F.coalesce(F.try_element_at(matches, F.lit(1))["similarity"], F.lit(0.0)), 4)


def seed_corpus(texts: DataFrame, source: str = "seed") -> DataFrame:
    """Corpus rows from pattern texts: (corpus_id, pattern_type, text) with source and vector."""
    return embed(texts.select("corpus_id", "pattern_type", "text")).withColumn("source", F.lit(source))


def ingest_confirmed(corpus: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Confirmed attacks that the corpus does not hold yet, each text once.

    Reviewed columns: item_id, direction, action, flag_correct, text.
    """
    confirmed = reviewed.where(
        (F.col("direction") == "input")
        & (F.col("flag_correct") | F.col("action").isin("deny", "block"))
        & (F.length(F.coalesce("text", F.lit(""))) > 0)
    ).withColumn("digest", F.sha2("text", 256))
    once = confirmed.groupBy("digest").agg(F.min("item_id").alias("item_id"))
    fresh = once.join(corpus.select(F.sha2("text", 256).alias("digest")), "digest", "left_anti")
    return (
        confirmed.join(fresh, ["digest", "item_id"], "left_semi")
        .select(
            F.concat(F.lit("custom_"), F.substring("digest", 1, 12)).alias("corpus_id"),
            F.lit("confirmed_human_review").alias("pattern_type"),
            F.lit("review_console").alias("source"),
            "text",
        )
    )
