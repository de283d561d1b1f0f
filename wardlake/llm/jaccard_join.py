"""Exact Jaccard join of word-shingle sets as a metric-space join.

Jaccard distance is a metric, and texts link when theirs is at most ``1 - similarity``. The join has
three steps, all exact.

1.  Outer regions. Distances to pivots that are documents say nothing here, as nearly all pairs of documents
    are at distance 1 of each other. The outer pivots are therefore single shingles, in a fixed order with common
    ones last: a set's cell is that of its first shingle, and its window holds the cells that a linked
    set can have, which are those of its first n - ceil(similarity * n) + 1 shingles. Linked sets meet
    in at least one cell. Within a cell only pairs of like size whose bucket counts could still share enough are
    kept (the L1 distance of bucket counts never exceeds that of the sets), as a spanning forest.
2.  Document regions. The connected parts of these candidates are regions: no link leaves one. A region with many
    sets is split by pivots that are documents: each set goes to the Voronoi cell of its nearest pivot and, by
    the triangle inequality, into every cell whose pivot is at most twice the link distance farther. Cells are regions
    of the next round. A region that pivots can't thin out is compared in pairs of blocks.
3.  Small regions are joined exactly, and links are again kept as a spanning forest.

Equal sets are one class from the start. Nothing is sent to the driver but a bounded list of common shingles, which
changes the order of pivots and so the cost, never the result.

Defined results: a null or empty text has the empty set, size 0, and is its own component; a text with fewer
words than a shingle has one shingle, all its words; very long texts are taken whole; repeated rows are in one
component; a component without any id has a null component id; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.bytetext import LOWER, SPACES, bounds, mix, run_keys, runs, text_slices
from wardlake.llm.components import components
from wardlake.llm.tables import kept, released, shuffle_width

#: Texts of which common shingles are counted, and how many common shingles are handed to the tasks at most.
SAMPLE_TEXTS, COMMON = 5_000, 50_000
#: Sets that are compared in one task at once.
LEAF = 256
PIVOTS = 12
DEPTH = 4


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; a link needs ``den * shared >= num * all``."""

    words: int = 5
    num: int = 80
    den: int = 100

    @property
    def each(self) -> int:
        """Shingles for each bucket count: unrelated sets stay well below the share that a link needs."""
        return 16 if 100 * self.num >= 88 * self.den else 8

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n + (-self.num * n) // self.den + 1

    def links(self, shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * shared >= self.num * (a + b - shared)


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of texts: row range, the sorted distinct shingles of all texts, and where each text's begin."""
    for i, j, data, offsets in text_slices(column):
        data = LOWER[data]
        starts, ends, owner = runs(data, offsets, ~SPACES)
        keys = run_keys(data, starts, ends)
        at = bounds(owner, j - i)
        count = np.diff(at)
        state, span = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.int64)
        for step in range(words):
            inside = np.arange(len(keys)) + step < at[owner + 1]
            to = np.flatnonzero(inside)
            state[to] = mix(state[to] * np.uint64(3) + keys[to + step] + np.uint64(step + 1))
            span[to] += 1
        whole = np.zeros(len(keys), bool)
        whole[at[:-1][(count > 0) & (count < words)]] = True
        take = (span == words) | whole
        shingle, owner = state[take], owner[take]
        order = np.lexsort((shingle, owner))
        shingle, owner = shingle[order], owner[order]
        new = np.ones(len(shingle), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
        yield i, j, shingle[new], bounds(owner[new], j - i)


def _class(items: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    first, second = int(mix(items).sum(dtype=np.uint64)), int(mix(items ^ np.uint64(0xA5A5A5A5C3C3C3C3)).sum(dtype=np.uint64))
    return (first ^ len(items)).to_bytes(8, "little") + second.to_bytes(8, "little")


def _counts(items: np.ndarray, each: int) -> bytes:
    """How many shingles fall into each of a power of two of buckets, about ``each`` in one, as bytes below 255."""
    n = max(16, 1 << (len(items) // each).bit_length() >> 1)
    while True:
        found = np.bincount((items >> np.uint64(32)).astype(np.int64) & (n - 1), minlength=n)
        if found.max(initial=0) < 255:
            return found.astype(np.uint8).tobytes()
        n *= 2


def _could_share(a: bytes, b: bytes) -> int:
    """No two sets with these bucket counts share more."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    n = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, n).sum(0), y.reshape(-1, n).sum(0)).sum())


class _Forest:
    """A spanning forest of the pairs that are joined."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        p, q = self.root(a), self.root(b)
        if p != q:
            self.up[max(p, q)] = min(p, q)
            self.edges.append((a, b))

    def batch(self) -> pa.RecordBatch:
        e = np.array(self.edges, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({"a": pa.array(e[:, 0]), "b": pa.array(e[:, 1])})


def _common(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that many texts of a bounded sample share."""
    every = max(1, docs.count() // SAMPLE_TEXTS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, items, _ in shingle_sets(batch.column("text"), words):
                s, n = np.unique(items, return_counts=True)
                yield pa.RecordBatch.from_pydict({"s": pa.array(s.view(np.int64)), "n": pa.array(n)})

    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)
    found = sample.mapInArrow(work, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where("n >= 4")
    rows = found.orderBy(F.desc("n"), "s").limit(COMMON).collect()
    return np.sort(np.array([r["s"] for r in rows], np.int64).view(np.uint64))


def described(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, twin, class, n, prefix, counts) of every text; ``twin`` is a hash of the whole text."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, rule.words))  # at most COMMON numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, items, at in shingle_sets(batch.column("text"), rule.words):
                last = common.value
                late = np.isin(items, last) if len(last) else np.zeros(len(items), bool)
                classes, prefixes, counts = [], [], []
                for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
                    one, is_late = items[a:b], late[a:b]
                    classes.append(_class(one))
                    counts.append(_counts(one, rule.each))
                    p = int(rule.prefix(np.int64(b - a))) if b > a else 0
                    prefixes.append(np.concatenate([one[~is_late], one[is_late]])[:p].view(np.int64))
                lengths = np.cumsum([0, *map(len, prefixes)])
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(i, j - i), "twin": batch.column("twin").slice(i, j - i), "class": pa.array(classes, pa.binary()),
                    "n": pa.array(np.diff(at)), "prefix": pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat)), "counts": pa.array(counts, pa.binary()),
                })

    rows = docs.withColumn("twin", F.xxhash64("text"))
    return rows.mapInArrow(work, "doc_id long, twin long, class binary, n long, prefix array<long>, counts binary")


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows sorted by the keys; the last group of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
            if held and held[-1].column(k)[-1].as_py() != v[0]:
                change[0] = True
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(batch)
            continue
        if held or cuts[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
        held = [batch.slice(int(cuts[-1]))]
    if held:
        yield pa.Table.from_batches(held)


def _numpy(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _candidates(members: DataFrame, rule: Rule) -> DataFrame:
    """A spanning forest of the pairs that meet in a cell and may link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ("cell", "block")):
            key, block, node, n = (_numpy(table, c) for c in ("cell", "block", "node", "n"))
            counts = table.column("counts").combine_chunks()
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
            stop = np.repeat(np.append(new[1:], len(key)), np.diff(np.append(new, len(key))))
            # Rows of a group ascend by size, so partners of a row end where sizes outgrow it.
            forest, seen = _Forest(), set()
            step = 1
            row = np.arange(len(key))
            while len(row):
                row = row[row + step < stop[row]]
                row = row[rule.den * n[row] >= rule.num * n[row + step]]
                for a in row.tolist():
                    b = a + step
                    x, y = int(node[a]), int(node[b])
                    pair = (x, y) if x < y else (y, x)
                    if x == y or pair in seen:
                        continue
                    seen.add(pair)
                    if forest.root(x) != forest.root(y) and rule.links(_could_share(counts[a].as_py(), counts[b].as_py()), n[a], n[b]):
                        forest.join(x, y)
                step += 1
            if forest.edges:
                yield forest.batch()

    ordered = members.repartition(shuffle_width(members.sparkSession), "cell", "block").sortWithinPartitions("cell", "block", "n", "node")
    return ordered.mapInArrow(work, "a long, b long")


def _members(classes: DataFrame) -> DataFrame:
    """(cell, block, node, n) of every class in the cells of its window that hold others, large cells in pairs of blocks; kept.

    Sizes, places and, later, counts are queries of their own, so that disk holds the shuffle files of one of them only.
    """
    rows = classes.select("node", "n", F.explode("prefix").alias("cell"))
    size = kept(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    shared = rows.join(size, "cell")
    groups = F.ceil(F.col("size") / LEAF).cast("int")
    mine = F.pmod(F.xxhash64("node"), groups.cast("long")).cast("int")
    # A row of group g takes part in the pairs (g, h) and (h, g) of groups.
    blocks = F.transform(F.sequence(F.lit(0), groups - 1), lambda h: F.least(mine, h).cast("long") * groups + F.greatest(mine, h))
    placed = shared.withColumn("block", F.explode(F.when(groups == 1, F.array(F.lit(0).cast("long"))).otherwise(blocks)))
    placed = kept(placed.select("cell", "block", "node", "n"), "placed")
    released(size)
    return placed


def _bits(twins: DataFrame) -> np.ndarray:
    """A bitmap over hashes of texts, so that most texts are left out before they are shingled again; 16 MB at most."""
    size = 1 << min(27, max(20, (64 * twins.count()).bit_length()))
    at = F.pmod(F.col("twin"), F.lit(size))
    part = F.floor(at / 32768).alias("k")
    rows = twins.groupBy(part).agg(F.call_function("bitmap_construct_agg", F.pmod(at, F.lit(32768))).alias("m")).collect()
    out = np.zeros((size // 32768, 4096), np.uint8)
    for r in rows:
        out[r["k"]] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out.ravel()


def _sets(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(region, size, node, items) of the wanted classes: shingles are made again, for a text of each class only.

    wanted: class, twin, node, and the region with its size. Sets are shuffled once, by class.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_bits(wanted.select("twin")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            at = batch.column("twin").to_numpy() & (8 * len(bits.value) - 1)
            hit = np.flatnonzero(bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            rows = []
            for r, twin in zip(hit.tolist(), batch.column("twin").take(pa.array(hit)).to_pylist(), strict=True):
                if twin not in met:
                    met.add(twin)
                    rows.append(r)
            for _, _, items, at in shingle_sets(batch.column("text").take(pa.array(rows, pa.int64())), rule.words):
                parts = [items[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_pydict({"class": pa.array([_class(p) for p in parts], pa.binary()), "items": pa.array([p.tobytes() for p in parts], pa.binary())})

    made = docs.select(F.xxhash64("text").alias("twin"), "text").mapInArrow(work, "class binary, items binary")
    return made.groupBy("class").agg(F.first("items").alias("items")).join(wanted, "class").select("region", "size", "node", "items")


def _leaf_links(rows: DataFrame, rule: Rule) -> DataFrame:
    """A spanning forest of the links within groups of a few hundred sets: (region, block, node, n, items) rows."""

    def links(node: np.ndarray, sets: list[np.ndarray], forest: _Forest) -> None:
        sizes = np.array(list(map(len, sets)), np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        values, code = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(code, kind="stable")
        posting, at = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(values)))])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        for x in range(len(sets)):
            mine = code[begin[x] : begin[x + 1]]
            s, e = at[mine], at[mine + 1]
            long = e - s
            total = int(long.sum())
            reach = np.arange(total) + np.repeat(s - (np.cumsum(long) - long), long)
            shared = np.bincount(posting[reach], minlength=len(sets))
            for y in np.flatnonzero(rule.links(shared, sizes[x], sizes) & (np.arange(len(sets)) > x)).tolist():
                forest.join(int(node[x]), int(node[y]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ("region", "block")):
            key, block, node = (_numpy(table, c) for c in ("region", "block", "node"))
            items = table.column("items").combine_chunks()
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
            forest = _Forest()
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(key)], strict=True):
                if b - a > 1:
                    links(node[a:b], [np.frombuffer(items[k].as_py(), np.uint64) for k in range(a, b)], forest)
            if forest.edges:
                yield forest.batch()

    ordered = rows.select("region", "block", "node", "items").repartition(shuffle_width(rows.sparkSession), "region", "block").sortWithinPartitions("region", "block", "node")
    return ordered.mapInArrow(work, "a long, b long")


def _cells(big: DataFrame, rule: Rule, depth: int) -> DataFrame:
    """(region, node, cells, pivot): for each set of a big region the Voronoi cells it belongs to, and a pivot it links to.

    The region's pivots are sent to each of its parts and come first there, so sets stream past them.
    """
    parts = F.ceil(F.col("size") / 1024).cast("int")
    lot = F.xxhash64(F.lit(depth), "node")
    chance = F.pmod(lot, F.ceil(F.col("size") / PIVOTS).cast("long")) == 0  # about PIVOTS for each region
    pivots = big.where(chance).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("role", F.lit(0))
    rest = big.withColumn("part", F.pmod(lot, parts.cast("long")).cast("int")).withColumn("role", F.lit(1))
    window = 2 * (1 - rule.num / rule.den) + 1e-9

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            out = {"region": [], "node": [], "cells": [], "pivot": []}
            for r in range(batch.num_rows):
                region, part, role, node = (batch.column(c)[r].as_py() for c in ("region", "part", "role", "node"))
                items = np.frombuffer(batch.column("items")[r].as_py(), np.uint64)
                if here != (region, part):
                    here, held = (region, part), []
                if role == 0:
                    held.append((node, items))
                    continue
                shared = np.array([len(np.intersect1d(items, p, assume_unique=True)) for _, p in held], np.int64)
                sizes = np.array([len(p) for _, p in held], np.int64)
                far = 1 - shared / np.maximum(1, len(items) + sizes - shared)
                near = far <= far.min(initial=1) + window
                hit = np.flatnonzero(rule.links(shared, len(items), sizes))
                out["region"].append(region)
                out["node"].append(node)
                out["cells"].append([held[k][0] for k in np.flatnonzero(near)] or [-1])  # without pivots all are together
                out["pivot"].append(held[int(hit[0])][0] if len(hit) else None)
            kinds = {"region": pa.int64(), "node": pa.int64(), "cells": pa.list_(pa.int64()), "pivot": pa.int64()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})

    both = pivots.unionByName(rest).select("region", "part", "role", "node", "items")
    ordered = both.repartition(shuffle_width(big.sparkSession), "region", "part").sortWithinPartitions("region", "part", "role", "node")
    return ordered.mapInArrow(work, "region long, node long, cells array<long>, pivot long")


def _blocks(rows: DataFrame) -> DataFrame:
    """A region's rows (with its ``size``) in pairs of blocks of half a leaf."""
    groups = F.ceil(F.col("size") / (LEAF // 2)).cast("int")
    mine = F.pmod(F.xxhash64("node"), groups.cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), groups - 1), lambda h: F.least(mine, h).cast("long") * groups + F.greatest(mine, h))
    return rows.withColumn("block", F.explode(pairs))


def _region_links(members: DataFrame, rule: Rule) -> DataFrame:
    """A spanning forest of all links between sets of one region: (region, size, node, items) rows."""
    found: list[DataFrame] = []
    for depth in range(DEPTH + 1):
        small = members.where(F.col("size").between(2, LEAF)).withColumn("block", F.lit(0).cast("long"))
        found.append(kept(_leaf_links(small, rule), "links"))
        big = members.where(F.col("size") > LEAF)
        if big.isEmpty():
            break
        if depth == DEPTH:
            found.append(kept(_leaf_links(_blocks(big), rule), "links"))
            break
        cells = kept(_cells(big, rule, depth), "cells")
        found.append(cells.where(F.col("pivot").isNotNull()).select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        # A region is split only where that thins it out: few copies, and no cell that holds most of it.
        copies = cells.select("region", "node", F.explode("cells").alias("cell"))
        filled = kept(copies.groupBy("region", "cell").agg(F.count(F.lit(1)).alias("n")), "filled")
        worth = filled.groupBy("region").agg(F.sum("n").alias("copies"), F.max("n").alias("most"))
        judged = big.join(worth, "region").withColumn("split", (F.col("copies") <= 1.5 * F.col("size")) & (F.col("most") <= 0.7 * F.col("size")))
        judged = kept(judged.drop("copies", "most"), "judged")
        found.append(kept(_leaf_links(_blocks(judged.where(~F.col("split"))), rule), "links"))
        placed = copies.join(filled, ["region", "cell"])
        onward = judged.where("split").drop("size").join(placed, ["region", "node"])
        deeper = kept(onward.select(F.xxhash64("region", "cell").alias("region"), F.col("n").alias("size"), "node", "items"), "regions")
        released(judged, *([members] if depth else []))
        members = deeper
    if depth:
        released(members)
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def join_components(docs: DataFrame, rule: Rule, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, twin, n_shingles, component, component_id) of every row.

    component names the component (null for an empty set) and component_id is its smallest doc_id; twin is the
    hash of the row's text, so that a caller can find rows again where ids repeat.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    told = kept(described(docs, rule), "described")
    rows = kept(told.select("doc_id", "twin", "class", "n"), "rows")
    full = rows.where("n > 0")
    per_class = told.where("n > 0").groupBy("class").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("counts").alias("counts"), F.min("doc_id").alias("least"), F.min("twin").alias("twin"))
    classes = kept(per_class.withColumn("node", F.monotonically_increasing_id()), "classes")
    released(told)
    placed = _members(classes)
    forest = kept(_candidates(placed.join(classes.select("node", "counts"), "node"), rule), "candidates")
    regions = components(forest)
    inside = regions.select("node", F.col("root").alias("region")).join(regions.groupBy(F.col("root").alias("region")).agg(F.count(F.lit(1)).alias("size")), "region")
    wanted = kept(inside.join(classes.select("node", "class", "twin"), "node"), "inside")
    names = kept(classes.select("class", "node", "least"), "names")
    released(classes, placed, forest)
    members = kept(_sets(docs, wanted, rule), "members")
    linked = components(_region_links(members, rule))
    released(members, wanted)
    named = names.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select("class", F.col("root").alias("component"), "component_id")
    out = full.select("doc_id", "twin", "class", "n").join(named, "class").select("doc_id", "twin", F.col("n").alias("n_shingles"), "component", "component_id")
    alone = rows.where("n = 0").select("doc_id", "twin", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """Documents without near-duplicates of one that stays: of each component the rows of its smallest id.

    All columns stay as they are. Rows without shingles are all kept, and rows that repeat an id with a linked text count once.
    """
    decided = kept(join_components(docs, rule or Rule()), "decisions")
    keep = decided.where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "twin")
    firsts = keep.groupBy("component").agg(F.min(order).alias("first")).select("first.doc_id", "first.twin")
    met = keep.groupBy("doc_id", "twin").agg(F.count(F.lit(1)).alias("rows"))
    stays = kept(met.join(firsts.withColumnsRenamed({"doc_id": "_id", "twin": "_t"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("twin") == F.col("_t")), "left"), "stays")
    released(decided)
    drop = stays.where(F.col("_t").isNull()).select(F.col("doc_id").alias("_id"), F.col("twin").alias("_t"))
    again = stays.where(F.col("_t").isNotNull() & (F.col("rows") > 1)).select(F.col("doc_id").alias("_id"), F.col("twin").alias("_t"))
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_twin") == F.col("_t"))
    left = docs.withColumn("_twin", F.xxhash64(F.coalesce("text", F.lit("")))).join(drop, here, "left_anti")
    if not again.isEmpty():
        left = left.join(again, here, "left_anti").unionByName(left.join(again, here, "left_semi").dropDuplicates(["doc_id", "_twin"]))
    return left.drop("_twin")
