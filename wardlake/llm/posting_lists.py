"""Approximate nearest neighbours by inner product: balanced posting lists under a graph of centroids.

A bounded sample of the vectors (``SAMPLE_ROWS`` with the smallest hashes, equal ones once) is halved again and again along its own
directions until the parts have the wanted size; their means are the centroids of the lists. Every row is indexed: it goes to the list of its
nearest centroid and, when it lies near a boundary, to others that are at most ``(1 + CLOSURE)`` times as far, so that neighbours
across a boundary share a list. There are as many lists as the root of the number of rows, at most
``MAX_LISTS``. Centroids are searched by a best-first walk over a graph of near centroids that each task holds in memory.

A query walks the graph, and the lists whose centroid is at most ``1 + ratio`` times as far as the nearest are
selected, at least as many as hold k other rows. The ratio is the smallest at which ``TARGET`` of
the true neighbours within the sample is found. Where that takes more lists than a walk follows, as with vectors of no structure, the distances to all
centroids are taken. The ``FIRST`` nearest lists are scored first; the k-th score found there is a bound below which the other lists
return nothing. A list with many more rows than others (copies of one vector, say) is split into blocks by
hash, and many queries of one list into packs; each block and pack meet in one group of rows. The best of all groups are ranked together, by
inner products that are added up in order of the components, so that equal vectors have equal scores.

Inner products become distances by one more component: a row x gets sqrt(M^2 - |x|^2), M being the
largest length in the sample, and a query is scaled to length M. Rows longer than M, which the sample
has not seen, are a list of their own that every query searches.

Defined results: a vector that is null, empty, all zero or holds a null or non-finite component takes no part, nor does a null id. Shorter
vectors count as padded with zeros. Rows that repeat an id and its vector count once; an id with several vectors stands once in an answer,
with its highest score. A query's own rows are those with its id. Ties go to the smaller id. Fewer rows than k
give all of them. Empty tables give an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.tables import kept
from wardlake.llm.topk import _matrix

SAMPLE_ROWS = 32_768
SAMPLE_QUERIES = 256
MAX_LISTS = 4_096
DEGREE = 16
BEAM = 32
FIRST = 8
CLOSURE = 0.02
COPIES = 4
TARGET = 0.95
#: Rows of one list that make one group: four times the usual, within these bounds.
BLOCK_ROWS = (256, 65_536)
PACK_QUERIES = 512
BATCH = 512


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Distinct (vec_id, v) of the vectors that take part."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), values.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).distinct()


class Index(NamedTuple):
    """What every task holds: centroids, their graph, where walks begin, the length M and the ratio for queries."""

    centroids: np.ndarray
    squares: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    length: float
    ratio: float

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Rows with their further component."""
        x = np.pad(x, ((0, 0), (0, self.centroids.shape[1] - 1 - x.shape[1])))
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.length**2 - (x * x).sum(axis=1)))])

    def queries(self, x: np.ndarray) -> np.ndarray:
        """Queries of length M."""
        x = np.pad(x, ((0, 0), (0, self.centroids.shape[1] - 1 - x.shape[1])))
        return np.column_stack([x * (self.length / np.sqrt((x * x).sum(axis=1)))[:, None], np.zeros(len(x))])

    def walk(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids that a best-first walk finds for each row, nearest first, and their distances (infinite: none)."""
        n, lists = len(x), len(self.centroids)
        beam = min(beam, lists)
        own = (x * x).sum(axis=1)
        seen = np.zeros((n, lists + 1), bool)
        seen[:, lists] = True
        who = np.full((n, beam), lists)
        far = np.full((n, beam), np.inf)
        done = np.ones((n, beam), bool)
        live, come = np.arange(n), np.broadcast_to(self.entries, (n, len(self.entries)))
        while len(live):
            # A centroid may be named twice among the neighbours only if it is the filler, which is always seen.
            fresh = ~seen[live[:, None], come]
            seen[live[:, None], come] = True
            near = np.minimum(come, lists - 1)
            d = own[live, None] + self.squares[near] - 2 * np.einsum("nd,nkd->nk", x[live], self.centroids[near])
            d = np.where(fresh, np.sqrt(np.maximum(d, 0.0)), np.inf)
            all_far = np.concatenate([far[live], d], axis=1)
            best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            who[live] = np.take_along_axis(np.concatenate([who[live], near], axis=1), best, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), best, 1)
            far[live] = np.take_along_axis(all_far, best, 1)
            open_ = np.where(done[live], np.inf, far[live])
            step = open_.argmin(axis=1)
            more = np.isfinite(open_[np.arange(len(live)), step])
            live, step = live[more], step[more]
            done[live, step] = True
            come = self.graph[who[live, step]]
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(who, order, 1), np.take_along_axis(far, order, 1)

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, list and whether it is the nearest, for every list that a row belongs to."""
        who, far = self.walk(self.rows(x), BEAM)
        inside = far <= far[:, :1] * (1 + CLOSURE)
        inside[:, COPIES:] = False
        row, at = np.nonzero(inside)
        return row, who[row, at], at == 0

    def selected(self, x: np.ndarray, held: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """The lists that each query searches, nearest first; ``held`` is how many rows have each list as their nearest."""
        q = self.queries(x)
        who, far = self.walk(q, 2 * BEAM)
        inside = self._inside(who, far, held, least)
        # A walk that would not end here is replaced by the distances to all centroids.
        open_ = np.flatnonzero(inside[:, -1]) if who.shape[1] < len(self.centroids) else np.zeros(0, int)
        for i in np.setdiff1d(np.arange(len(x)), open_).tolist():
            yield i, who[i][inside[i]]
        if len(open_):
            d = np.sqrt(np.maximum(0.0, (q[open_] ** 2).sum(axis=1)[:, None] + self.squares - 2 * q[open_] @ self.centroids.T))
            who = np.argsort(d, axis=1, kind="stable")
            inside = self._inside(who, np.take_along_axis(d, who, 1), held, least)
            for i, row in enumerate(open_.tolist()):
                yield row, who[i][inside[i]]

    def _inside(self, who: np.ndarray, far: np.ndarray, held: np.ndarray, least: int) -> np.ndarray:
        total = np.cumsum(np.where(np.isfinite(far), held[who], 0), axis=1)
        before = np.concatenate([np.zeros((len(who), 1)), total[:, :-1]], axis=1)
        return np.isfinite(far) & ((far <= far[:, :1] * (1 + self.ratio)) | (before < least))


def _halved(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Parts of at most ``size`` rows: each part is cut at the median along the line between its two means."""
    rng = np.random.default_rng(11)
    parts, todo = [], [np.arange(len(x))]
    while todo:
        i = todo.pop()
        if len(i) <= size:
            parts.append(i)
            continue
        p, half = x[i], len(i) // 2
        a, b = p[rng.choice(len(i), 2, replace=False)]
        for _ in range(6):
            order = np.argsort(p @ (a - b), kind="stable")
            a, b = p[order[half:]].mean(axis=0), p[order[:half]].mean(axis=0)
        todo += [i[order[:half]], i[order[half:]]]
    return parts


def _graph(c: np.ndarray) -> np.ndarray:
    """The nearest centroids of each and, so that all are reached, those before and after it in the order of halving."""
    n = len(c)
    squares = (c * c).sum(axis=1)
    out = np.full((n, DEGREE + 2), n)
    degree = min(DEGREE, n - 1)
    for a in range(0, n, 1024):
        d = squares[None, :] - 2 * c[a : a + 1024] @ c.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        if degree:
            out[a : a + 1024, :degree] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
    for column, other in ((DEGREE, np.arange(n) - 1), (DEGREE + 1, np.arange(n) + 1)):
        new = (other >= 0) & (other < n) & ~(out[:, :DEGREE] == other[:, None]).any(axis=1)
        out[new, column] = other[new]
    return out


def fit(sample: np.ndarray, total: int) -> Index:
    """Centroids, graph and ratio from a sample (rows x components) of a table of ``total`` rows."""
    lists = int(min(MAX_LISTS, np.ceil(np.sqrt(total))))
    length = float(np.sqrt((sample * sample).sum(axis=1)).max())
    bare = Index(np.zeros((1, sample.shape[1] + 1)), np.zeros(1), np.zeros((1, 1), int), np.zeros(1, int), length, 0.0)
    x = bare.rows(sample)
    c = np.stack([x[p].mean(axis=0) for p in _halved(x, max(1, -(-len(x) // lists)))])
    entries = np.unique(np.linspace(0, len(c) - 1, min(16, len(c))).astype(int))
    index = Index(c, (c * c).sum(axis=1), _graph(c), entries, length, 0.0)
    # The smallest ratio that finds the wanted share of the true neighbours within the sample.
    probes = np.linspace(0, len(sample) - 1, min(SAMPLE_QUERIES, len(sample))).astype(int)
    row, home, _ = index.homes(sample)
    member = np.zeros((len(sample), len(c)), bool)
    member[row, home] = True
    far = np.sqrt(np.maximum(0.0, length**2 + index.squares - 2 * index.queries(sample[probes]) @ c.T))
    share = far / np.maximum(far.min(axis=1, keepdims=True), 1e-300) - 1
    scores = sample[probes] @ sample.T
    scores[np.arange(len(probes)), probes] = -np.inf
    k = min(20, len(sample) - 1)
    if not k:
        return index
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    needed = np.where(member[near], share[:, None, :], np.inf).min(axis=2)
    return index._replace(ratio=float(np.quantile(needed, TARGET)) + 1e-9)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, each added up in the order of its components."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def best_of_group(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, id and score of the k best of a group for each query, none with scores below the query's floor."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    reach = np.sqrt((x * x).sum(axis=1).max()) * np.sqrt((q * q).sum(axis=1))
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    step = max(1, (1 << 21) // len(x))
    for a in range(0, len(q), step):
        rough = q[a : a + step] @ x.T
        rough[q_ids[a : a + step, None] == ids[None, :]] = -np.inf
        at = min(k, len(x)) - 1
        kth = -np.partition(-rough, at, axis=1)[:, at]
        kth = np.maximum(kth, floor[a : a + step])
        least = np.where(np.isfinite(kth), kth - 1e-12 * width * reach[a : a + step], -np.finfo(float).max)
        row, column = np.nonzero(rough >= least[:, None])
        for b in range(0, len(row), 1 << 18):
            r, c = row[b : b + (1 << 18)] + a, column[b : b + (1 << 18)]
            found.append((r, c, exact_scores(q[r], x[c])))
    row, column, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((ids[column], -score, row))
    row, column, score = row[order], column[order], score[order]
    keep = (np.arange(len(row)) - np.searchsorted(row, row) < k) & (score >= floor[row])
    return q_ids[row[keep]], ids[column[keep]], score[keep]


def neighbours(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each query row.

    ``is_query`` is a condition on the column vec_id.
    """
    spark = df.sparkSession
    rows = kept(usable(df, vec_id, vector), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("v"), "vec_id").limit(SAMPLE_ROWS).select("v").toArrow()
    index = fit(np.unique(_matrix(sample.column("v"), size["w"]), axis=0), size["n"])
    lists = len(index.centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                x = _matrix(part.column("v"))
                row, home, first = index.homes(x)
                over = np.sqrt((x * x).sum(axis=1)) > index.length * (1 + 1e-12)
                own = ~over[row]
                at = np.concatenate([row[own], np.flatnonzero(over)])
                name = np.concatenate([home[own], np.full(int(over.sum()), lists)])
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.int32()), pa.array(np.concatenate([first[own], np.ones(int(over.sum()), bool)])), *[part.column(c).take(pa.array(at)) for c in ("vec_id", "v")]], ["list", "first", "vec_id", "v"])

    placed = kept(rows.mapInArrow(place, "list int, first boolean, vec_id long, v array<double>"), "lists")
    held, n_rows = np.zeros(lists + 1, np.int64), np.zeros(lists + 1, np.int64)
    for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("first").cast("long")).alias("held")).collect():
        n_rows[r["list"]], held[r["list"]] = r["n"], r["held"]
    usual = -(-4 * int(n_rows.sum()) // lists)
    blocks = -(-n_rows // min(max(usual, BLOCK_ROWS[0]), BLOCK_ROWS[1]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                row, name, turn = [], [], []
                for i, chosen in index.selected(_matrix(part.column("v")), held, k + 1):
                    chosen = np.append(chosen, lists) if n_rows[lists] else chosen
                    row.append(np.full(len(chosen), i))
                    name.append(chosen)
                    turn.append(np.arange(len(chosen)))
                if row:
                    columns = [pa.array(np.concatenate(name), pa.int32()), pa.array(np.concatenate(turn), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, part.column("vec_id").take(pa.array(np.concatenate(row)))], ["list", "turn", "vec_id"])

    asking = rows.where(is_query)
    # An id with several vectors asks with each of them.
    asked = kept(asking.mapInArrow(ask, "list int, turn int, vec_id long").distinct(), "asked")
    # At most MAX_LISTS + 1 rows.
    cuts = F.broadcast(spark.createDataFrame([(i, int(blocks[i])) for i in range(lists + 1) if blocks[i]], "list int, blocks int"))
    one = lambda n: F.pmod(F.xxhash64("vec_id", "v"), n).cast("int")
    docs = placed.join(cuts, "list").select("list", one(F.col("blocks")).alias("block"), "vec_id", "v")

    def scored(chosen: DataFrame, floors: DataFrame | None) -> DataFrame:
        """Candidates from the chosen (list, query) pairs; ``floors`` holds the score that a query's candidates must reach."""
        n_asked = chosen.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
        packs = F.broadcast(n_asked.select("list", F.ceil(F.col("n") / PACK_QUERIES).cast("int").alias("packs")))
        with_v = chosen.join(asking, "vec_id")
        with_v = with_v.withColumn("floor", F.lit(float("-inf"))) if floors is None else with_v.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        queries = with_v.join(packs, "list").join(cuts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), one(F.col("packs")).alias("pack"), "vec_id", "v", "floor")
        rows_ = docs.join(packs, "list").select("list", "block", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)).alias("pack"), "vec_id", "v")

        def meet(some: pa.Table, these: pa.Table) -> pa.Table:
            if not some.num_rows or not these.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            found = best_of_group(some.column("vec_id").to_numpy(), _matrix(some.column("v")), some.column("floor").to_numpy(), these.column("vec_id").to_numpy(), _matrix(these.column("v")), k)
            return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

        key = ("list", "block", "pack")
        found = queries.groupBy(*key).cogroup(rows_.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")
        return found.where(F.col("query_id") != F.col("vec_id"))

    def best(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = kept(best(scored(asked.where(F.col("turn") < FIRST), None)), "near")
    floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    rest = scored(asked.where(F.col("turn") >= FIRST), floors)
    return best(near.select("query_id", "vec_id", "score").unionByName(rest)).select("query_id", "rank", "vec_id", "score")
