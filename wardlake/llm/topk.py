"""Exact top-k inner products by block-at-a-time pruning.

Vectors are turned into integers and dealt into shards; within a shard they are ordered by the nearest of a
few anchor vectors, so that the blocks of consecutive vectors (document ranges) are alike.
Every block has its forward index (the vectors) and, for each component, its maximum and minimum. A pack of queries
meets every shard once. For each query the blocks are ordered by the sum over its components of the larger of
weight times maximum and weight times minimum, which no score in the block exceeds; blocks
are scored in this order until the bound falls below the query's k-th score. The best k of each
shard are then ranked together.

Defined results: a vector that is null, empty, or holds a null or non-finite component takes no part, nor does
a null id. Shorter vectors count as padded with zeros. Rows that repeat an id and its vector count once;
a query's own rows are those with its id. Ties go to the smaller id. Empty tables give
an empty table. Scores are exact: where they may exceed 53 bits, they are added up as 64-bit integers, and a score that
does not fit these is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.tables import kept, shuffle_width

SCALE = 1024
SHARD_ROWS = 8_192
BLOCK_ROWS = 64
QUERY_ROWS = 256
ANCHORS = 64

PACK = "pack long, width int, ids binary, vectors binary"


def quantised(df: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """Distinct (vec_id, ints) of the vectors that take part."""
    values = F.col(vector)
    whole = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), values.alias("v")).where(F.col(vec_id).isNotNull() & (F.size("v") > 0) & whole)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("ints")).distinct()


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = flat[offsets[0] : offsets[-1]]
    return out


def _packs(rows: DataFrame, pack_rows: int, anchors: np.ndarray | None) -> DataFrame:
    """Rows with a ``pack`` number as binary matrices; a pack with more rows than expected gives several."""

    def emit(pack: int, ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        if anchors is not None and len(anchors):
            w = max(m.shape[1], anchors.shape[1])
            a, b = (np.pad(x, ((0, 0), (0, w - x.shape[1]))) for x in (anchors, m))
            near = ((a * a).sum(1) - 2 * b @ a.T).argmin(1)
            order = np.lexsort((ids, near))
            ids, m = ids[order], m[order]
        return pa.RecordBatch.from_pydict({
            "pack": pa.array([pack], pa.int64()), "width": pa.array([m.shape[1]], pa.int32()),
            "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([m.astype("<i4" if np.abs(m).max(initial=0) < 2**31 else "<f8").tobytes()], pa.binary()),
        })

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held = None, [], []

        def flush() -> pa.RecordBatch:
            width = max(x.shape[1] for x in held)
            return emit(now, np.concatenate(ids), np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in held]))

        for batch in batches:
            number = batch.column("pack").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(edges, edges[1:], strict=False):
                while a < b:
                    if held and (now != number[a] or sum(map(len, ids)) >= pack_rows):
                        yield flush()
                        ids, held = [], []
                    now = int(number[a])
                    c = min(b, a + pack_rows - sum(map(len, ids)))
                    ids.append(batch.column("vec_id").slice(a, c - a).to_numpy())
                    held.append(_matrix(batch.column("ints").slice(a, c - a)))
                    a = c
        if held:
            yield flush()

    return rows.mapInArrow(work, PACK)


def _unpacked(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}ids"], "<i8")
    raw, width = row[f"{prefix}vectors"], row[f"{prefix}width"]
    kind = "<i4" if len(raw) == 4 * len(ids) * width else "<f8"
    return ids, np.frombuffer(raw, kind).reshape(len(ids), width).astype(float)


def search_blocks(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, block: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of one shard for each query: query rows, ids and scores; blocks beyond the bound are not scored."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    starts = np.arange(0, len(x), block)
    high, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    none, least = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    # Sums of absolute products bound every intermediate sum; below 2**53 floating point is exact.
    reach = np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).max(axis=0) if len(x) else np.zeros(len(q))
    exact = reach.max(initial=0) < 2.0**53
    slack = 0.0 if exact else 1e-9 * reach
    if not exact:
        whole_q, whole_x = q.astype(np.int64), x.astype(np.int64)
    bound = bound + (slack if exact else slack[:, None])
    top = np.full((len(q), k), least)
    who = np.full((len(q), k), none)
    live = np.arange(len(q))
    for turn in range(len(starts)):
        chosen = order[live, turn]
        # A bound equal to the k-th score may still hold a tie with a smaller id.
        go = bound[live, chosen] >= top[live, -1]
        live, chosen = live[go], chosen[go]
        if not len(live):
            break
        for b in np.unique(chosen).tolist():
            rows = live[chosen == b]
            part = slice(starts[b], min(starts[b] + block, len(x)))
            score = q[rows] @ x[part].T
            name = np.broadcast_to(ids[part], score.shape)
            own = name == q_ids[rows, None]
            if exact:
                score = score.astype(np.int64)
            else:
                if (np.abs(score) * (1 - 1e-9) >= 2.0**63)[~own].any():
                    raise OverflowError("a score does not fit a 64-bit integer")
                # Wraps only in between: a sum that fits comes out right.
                score = whole_q[rows] @ whole_x[part].T
            score = np.where(own, least, score)
            s = np.concatenate([top[rows], score], axis=1)
            n = np.concatenate([who[rows], np.where(own, none, name)], axis=1)
            by_id = np.argsort(n, axis=1, kind="stable")
            s, n = np.take_along_axis(s, by_id, 1), np.take_along_axis(n, by_id, 1)
            best = np.argsort(~s, axis=1, kind="stable")[:, :k]  # ~s falls as s grows and can't overflow
            top[rows], who[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(n, best, 1)
    row, col = np.nonzero(who != none)
    return row, who[row, col], top[row, col]


def top_k(df: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each query row.

    ``is_query`` is a condition on the column vec_id. Packs of queries are sent to every shard: what is
    shuffled is (queries / 256) x (rows / 8192) packs, far below the number of pairs.
    """
    rows = kept(quantised(df, vec_id, vector, scale), "vectors")
    width = shuffle_width(df.sparkSession)
    total = rows.count()
    shards = max(1, -(-total // SHARD_ROWS))
    chosen = rows.where(is_query)
    groups = max(1, -(-chosen.count() // QUERY_ROWS))
    seeds = [r["ints"] for r in rows.orderBy(F.xxhash64("ints"), "vec_id").limit(ANCHORS).collect()]
    anchors = np.zeros((len(seeds), max(map(len, seeds), default=1)))
    for i, s in enumerate(seeds):
        anchors[i, : len(s)] = s

    def dealt(part: DataFrame, n: int, size: int, by: np.ndarray | None) -> DataFrame:
        pack = F.pmod(F.xxhash64("vec_id"), F.lit(n))
        return _packs(part.withColumn("pack", pack).repartition(width, "pack").sortWithinPartitions("pack", "vec_id"), size, by)

    docs = dealt(rows, shards, SHARD_ROWS, anchors)
    queries = dealt(chosen, groups, QUERY_ROWS, None).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("pack"), *[F.col(c).alias(f"q_{c}") for c in ("width", "ids", "vectors")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                (q_ids, q), (ids, x) = _unpacked(r, "q_"), _unpacked(r, "")
                row, who, score = search_blocks(q_ids, q, ids, x, k)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q_ids[row]), "vec_id": pa.array(who), "score": pa.array(score)})

    found = queries.join(docs, "pack").mapInArrow(work, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
