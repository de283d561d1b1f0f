"""Ranked lexical search over a K2-treap of the term-document grid.

Documents are taken in blocks. A block's grid has a row for each term, ordered by weight, and a column for
each document, ordered by id; a cell holds the impact of the term in the document, a whole number. The grid is stored
as a compressed quadtree: level by level, one bit mask of four children for each quadrant that is not empty,
and the largest impact in it. A child's place is the number of bits before it.

A search descends for all terms of an item together. A document range starts as the whole block; for each
term it knows the quadrant that holds the term's row and the range's columns. The sum of weight times that
quadrant's largest impact is a bound for all documents of the range, exact when the range is one
document. Ranges are split best first, until no bound can displace the item's k-th document. The k best
documents are carried from block to block of a task, and those of all tasks are ranked together.

Scores follow a whole-number variant of BM25 (see ``weights`` and ``impacts``), with statistics over all documents.

Terms are maximal stretches of ASCII letters, digits and all characters beyond ASCII; A-Z are lower-cased. Only rows of
terms that some item has are kept, for no other row is ever descended. Items are taken in packs
of about a million (item, term) pairs, so what a task holds is bounded; each pack reads the documents once.

Defined results: null and empty texts have no terms; such items find nothing, such documents are never found.
Every row of the documents is one document, rows without an id come last among equal scores; rows of one item id are one item with the terms of all; rows without an
item id are left out. Very long texts are taken whole. Empty tables give an empty table. Only the id and the
text column are read, so other columns may have any names. Terms are compared by 64-bit keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.bytetext import LOWER, WORDY, run_keys, runs, text_slices
from wardlake.llm.tables import kept

BLOCK_DOCS = 4_096
BLOCK_CELLS = 1 << 19
PACK_PAIRS = 1 << 20
#: Document ranges that are split together.
FRONT = 48
_LAST = np.iinfo(np.int64).max
_BITS = np.array([bin(i).count("1") for i in range(16)], np.int64)

BLOCK = "ids binary, named binary, sizes binary, docs binary, terms binary, counts binary, n_docs long, n_terms long"
TREAP = "ids binary, named binary, height int, levels binary, masks binary, peaks binary"


# --- terms


def term_keys(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of a text column: first row, rows, and the text and key of every term."""
    for i, j, data, offsets in text_slices(column):
        low = LOWER[data]
        starts, ends, owner = runs(low, offsets, WORDY)
        yield i, j - i, owner, run_keys(low, starts, ends)


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item_id, term): the key of each term of each item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, owner, keys in term_keys(batch.column(1)):
                ids = batch.column(0).take(pa.array(owner + i))
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys.astype(np.int64))], ["item_id", "term"])

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null")
    return rows.mapInArrow(work, "item_id long, term long").distinct()


# --- blocks of counted documents


class _Block:
    """Documents gathered until they are many enough for a block."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.named: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_docs = self.n_cells = 0

    def add(self, ids: np.ndarray, named: np.ndarray, sizes: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        self.cells.append((doc + self.n_docs, term, count))
        self.ids.append(ids)
        self.named.append(named)
        self.sizes.append(sizes)
        self.n_docs += len(ids)
        self.n_cells += len(doc)

    def full(self) -> bool:
        return self.n_docs >= BLOCK_DOCS or self.n_cells >= BLOCK_CELLS

    def row(self) -> pa.RecordBatch:
        doc, term, count = (np.concatenate(c).astype("<u4") for c in zip(*self.cells, strict=True))
        sizes = np.concatenate(self.sizes).astype("<i8")
        parts = {"ids": np.concatenate(self.ids).astype("<i8"), "named": np.concatenate(self.named).astype("u1"), "sizes": sizes, "docs": doc, "terms": term, "counts": count}
        columns = {n: pa.array([a.tobytes()], pa.binary()) for n, a in parts.items()}
        return pa.RecordBatch.from_pydict(columns | {"n_docs": pa.array([int((sizes > 0).sum())]), "n_terms": pa.array([int(sizes.sum())])})


def counted(docs: DataFrame, vocabulary: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of documents: ids, numbers of terms, and (document, place in the sorted vocabulary, occurrences)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            numbers = ids.fill_null(_LAST).to_numpy()
            for i, n, owner, keys in term_keys(batch.column(1)):
                keys = keys.astype(np.int64)
                place = np.minimum(np.searchsorted(vocabulary, keys), max(0, len(vocabulary) - 1))
                mine = vocabulary[place] == keys if len(vocabulary) else np.zeros(len(keys), bool)
                cell, count = np.unique(owner[mine] * max(1, len(vocabulary)) + place[mine], return_counts=True)
                doc, term = np.divmod(cell, max(1, len(vocabulary)))
                block.add(numbers[i : i + n], known[i : i + n], np.bincount(owner, minlength=n), doc, term, count)
                if block.full():
                    yield block.row()
                    block = _Block()
        if block.n_docs:
            yield block.row()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, BLOCK)


class Statistics(NamedTuple):
    n_docs: int
    n_terms: int
    #: Documents that hold each term of the vocabulary.
    holding: np.ndarray


def statistics(blocks: DataFrame, n_vocabulary: int) -> Statistics:
    """Numbers over all documents; each task adds up its blocks before anything is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_vocabulary, np.int64)
        for batch in batches:
            for raw in batch.column("terms"):
                total += np.bincount(np.frombuffer(raw.as_py(), "<u4"), minlength=n_vocabulary)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"place": pa.array(place), "holding": pa.array(total[place])})

    sums = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("t")).first()
    found = blocks.select("terms").mapInArrow(work, "place long, holding long").groupBy("place").agg(F.sum("holding").alias("holding")).collect()
    holding = np.zeros(n_vocabulary, np.int64)
    for r in found:
        holding[r["place"]] = r["holding"]
    return Statistics(int(sums["n"]), int(sums["t"]), holding)


def weights(s: Statistics) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    ratio = (2 * s.n_docs + 2) / (2 * s.holding + 1)
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def impacts(count: np.ndarray, size: np.ndarray, s: Statistics) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L: below a million."""
    m = 50 + (50 * size * s.n_docs) // s.n_terms
    return (1_000_000_000 * count) // (1000 * count + 20 * m)


# --- the treap


class Treap(NamedTuple):
    """Quadrants that are not empty, level by level in Morton order: mask of children, place of the first child, largest value."""

    height: int
    masks: np.ndarray
    first: np.ndarray
    peaks: np.ndarray

    @classmethod
    def of(cls, height: int, levels: np.ndarray, masks: np.ndarray, peaks: np.ndarray) -> Treap:
        """From masks and values; where children begin follows from the masks."""
        inner = len(masks)
        first = np.zeros(len(peaks), np.int64)
        first[:inner] = 1 + np.cumsum(_BITS[masks]) - _BITS[masks]
        return cls(height, np.concatenate([masks, np.zeros(len(peaks) - inner, np.uint8)]), first, peaks)


def _spread_bits(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


def build(row: np.ndarray, column: np.ndarray, value: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Height, quadrants of each level, masks of the inner ones and largest values of all."""
    height = max(1, int(max(row.max(initial=0), column.max(initial=0))).bit_length())
    code = (_spread_bits(row) << np.uint64(1)) | _spread_bits(column)
    order = np.argsort(code)
    code, peak = code[order], value[order]
    peaks, masks = [peak], []
    for _ in range(height):
        parent = code >> np.uint64(2)
        at = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(parent) else np.zeros(0, np.int64)
        masks.append(np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), at) if len(at) else np.zeros(0, np.uint8))
        peak = np.maximum.reduceat(peak, at) if len(at) else peak
        peaks.append(peak)
        code = parent[at]
    peaks, masks = peaks[::-1], masks[::-1]
    return height, np.array([len(p) for p in peaks]), np.concatenate(masks), np.concatenate(peaks)


def treaps(blocks: DataFrame, s: Statistics, rows: np.ndarray) -> DataFrame:
    """The treap of each block; ``rows`` is the grid row of each term of the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in ("ids", "named", "sizes", "docs", "terms", "counts")}
                ids, named, sizes = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["named"], "u1"), np.frombuffer(r["sizes"], "<i8")
                doc, term, count = (np.frombuffer(r[n], "<u4").astype(np.int64) for n in ("docs", "terms", "counts"))
                order = np.lexsort((ids, 1 - named))
                column = np.empty(len(ids), np.int64)
                column[order] = np.arange(len(ids))
                if not len(doc):
                    continue
                height, levels, masks, peaks = build(rows[term], column[doc], impacts(count, sizes[doc], s))
                columns = {"ids": ids[order], "named": named[order], "levels": levels.astype("<i8"), "masks": masks, "peaks": peaks.astype("<u4")}
                yield pa.RecordBatch.from_pydict({n: pa.array([columns[n].tobytes()], pa.binary()) if n in columns else pa.array([height], pa.int32()) for n in ("ids", "named", "height", "levels", "masks", "peaks")})

    return blocks.mapInArrow(work, TREAP)


class Best(NamedTuple):
    """The best documents of an item so far, best first."""

    score: np.ndarray
    ids: np.ndarray
    named: np.ndarray

    def with_more(self, score: np.ndarray, ids: np.ndarray, named: np.ndarray, k: int) -> Best:
        score, ids, named = np.concatenate([self.score, score]), np.concatenate([self.ids, ids]), np.concatenate([self.named, named])
        order = np.lexsort((ids, -score))[:k]
        return Best(score[order], ids[order], named[order])


NOBODY = Best(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))


def search(treap: Treap, rows: np.ndarray, weight: np.ndarray, ids: np.ndarray, named: np.ndarray, k: int, best: Best) -> Best:
    """The k best documents of an item after this block: the paths of its rows descend together, best range first."""
    height, masks, first, peaks = treap
    node = np.zeros((1, len(rows)), np.int64)
    level, place = np.zeros(1, np.int64), np.zeros(1, np.int64)
    bound = np.array([int((weight * int(peaks[0])).sum())])
    while True:
        if len(best.score) == k:
            least, last = best.score[-1], best.ids[-1]
            begins = ids[np.minimum(place << (height - level), len(ids) - 1)]
            hope = (bound > least) | ((bound == least) & (begins < last))
        else:
            hope = bound > 0
        if not hope.all():
            node, level, place, bound = node[hope], level[hope], place[hope], bound[hope]
        if not len(bound):
            return best
        if len(bound) > FRONT:
            chosen = np.argpartition(-bound, FRONT)[:FRONT]
            left = np.ones(len(bound), bool)
            left[chosen] = False
        else:
            chosen, left = np.arange(len(bound)), np.zeros(len(bound), bool)
        at, deep, where = node[chosen], level[chosen], place[chosen]
        here = at >= 0
        mask, begin = np.where(here, masks[at], 0), first[at]
        row_bit = (rows[None, :] >> (height - 1 - deep)[:, None]) & 1
        grown = []
        for column_bit in (0, 1):
            quadrant = 2 * row_bit + column_bit
            there = (mask >> quadrant) & 1 == 1
            child = np.where(there, begin + _BITS[mask & ((1 << quadrant) - 1)], -1)
            grown.append((child, deep + 1, 2 * where + column_bit, np.where(there, weight * peaks[child].astype(np.int64), 0).sum(axis=1)))
        child, deep, where, score = (np.concatenate(c) for c in zip(*grown, strict=True))
        done = (deep == height) & (score > 0)
        if done.any():
            best = best.with_more(score[done], ids[where[done]], named[where[done]], k)
        more = (deep < height) & (score > 0)
        node, level, place, bound = (np.concatenate([old[left], new[more]]) for old, new in ((node, child), (level, deep), (place, where), (bound, score)))


def _searched(blocks: DataFrame, names: list[int], terms: list[tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """The k best documents of each item in each task; ``terms`` holds the rows and weights of each item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [NOBODY] * len(names)
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                ids, named = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["named"], "u1")
                treap = Treap.of(r["height"], np.frombuffer(r["levels"], "<i8"), np.frombuffer(r["masks"], "u1"), np.frombuffer(r["peaks"], "<u4"))
                for q, (rows, weight) in enumerate(terms):
                    if len(rows):
                        best[q] = search(treap, rows, weight, ids, named, k, best[q])
        for name, b in zip(names, best, strict=True):
            if len(b.score):
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([name] * len(b.score), pa.int64()), "doc_id": pa.array(b.ids, pa.int64(), mask=b.named == 0), "score": pa.array(b.score, pa.int64())})

    return blocks.mapInArrow(work, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the k documents with the highest positive scores for each item."""
    spark = docs.sparkSession
    pairs = kept(item_terms(items, item_id, text), "item-terms")
    packs = -(-pairs.count() // PACK_PAIRS)
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for pack in range(packs):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(packs)) == pack).toPandas()
        if not len(mine):
            continue
        vocabulary = np.unique(mine["term"].to_numpy())
        blocks = kept(counted(docs, vocabulary, doc_id, text), "blocks")
        s = statistics(blocks, len(vocabulary))
        if not s.n_terms:
            continue
        weight = weights(s)
        order = np.argsort(-weight, kind="stable")
        rows = np.empty(len(order), np.int64)
        rows[order] = np.arange(len(order))
        mine["place"] = np.searchsorted(vocabulary, mine["term"].to_numpy())
        names, terms = [], []
        for name, part in mine.groupby("item_id")["place"]:
            place = part.to_numpy()
            place = place[weight[place] > 0]
            names.append(int(name))
            terms.append((rows[place], weight[place]))
        out = out.unionByName(_searched(treaps(blocks, s, rows), names, terms, k))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
