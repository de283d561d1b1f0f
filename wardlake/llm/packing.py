"""Best-fit packing of documents into sequences by a configuration linear program.

Documents are cut into pieces of at most ``capacity`` tokens; a full piece is a sequence by
itself. The other pieces count by length only. The program over this histogram, "use as few
configurations (sets of lengths that fit a sequence) as cover all pieces", is solved by
multiplicative weights: each round prices lengths, a knapsack dynamic program finds the
best configurations under the prices, a share of the sequences is filled with them, and prices of
lengths that lag behind rise. Shares are rounded down to whole sequences, and what
is left goes by best fit into open and new sequences. The histogram has at most
``capacity`` rows, so this part is the same for any number of documents; giving the pieces
their places is a join on length and rank.

Defined results: a null text is an empty text, which is one piece with the end id; repeated
rows are packed each for itself; null ids are kept; an empty table gives an empty table;
further columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm import bytebpe
from wardlake.llm.tables import kept
from wardlake.llm.token_files import ended

CAPACITY = 2048
ROUNDS = 160
BATCH = 96
RATE = 0.3
#: Taken off the value of every piece, so that of equally full configurations the one with fewer pieces is better.
FEWER = 2e-5

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents: ids with the end id, cut so that only the first piece is shorter than the others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, ids, offsets in bytebpe.encoded(batch.column("text"), vocabulary):
                ids, offsets = ended(ids, offsets)
                sizes = np.diff(offsets)
                count = -(-sizes // capacity)
                owner = np.repeat(np.arange(j - i), count)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                first = sizes - (count - 1) * capacity
                start = np.where(number == 0, 0, first[owner] + (number - 1) * capacity)
                length = np.where(number == 0, first[owner], capacity)
                begin = offsets[owner] + start
                raw = [ids[s:e].astype("<u4").tobytes() for s, e in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                columns = {
                    "doc_id": batch.column("doc_id").slice(i, j - i).take(pa.array(owner)), "piece": pa.array(number, pa.int32()),
                    "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(raw, pa.binary())} if with_ids else {}))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(work, PIECES + ", ids binary" * with_ids)


def _knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each room up to the capacity, and the length that is taken first there (0: none)."""
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        fit = lengths[: np.searchsorted(lengths, room, side="right")]
        if len(fit):
            value = price[fit] + best[room - fit]
            k = int(value.argmax())
            best[room], taken[room] = value[k], fit[k]
        if best[room - 1] > best[room]:
            best[room], taken[room] = best[room - 1], -1
    return best, taken


def _filled(length: int, taken: np.ndarray, capacity: int) -> list[int]:
    """The best configuration that holds this length."""
    out, room = [length], capacity - length
    while room > 0 and taken[room] != 0:
        if taken[room] < 0:
            room -= 1
        else:
            out.append(int(taken[room]))
            room -= out[-1]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how many sequences take each, so that every piece of the histogram has a place.

    The covering program is solved by multiplicative weights: the price of a length follows its lag.
    """
    demand = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        demand[length] += n
    left = demand.copy()
    total = float((np.arange(capacity + 1) * demand).sum())
    base = np.maximum(np.arange(capacity + 1) / capacity - FEWER, 0)
    price = base
    used: dict[tuple[int, ...], int] = {}
    share = max(1, int(total / capacity / rounds))
    idle, done = 0, 0.0
    while left.any() and idle < 3:
        lengths = np.flatnonzero(left)
        best, taken = _knapsack(price, lengths, capacity)
        value = price[lengths] + best[capacity - lengths]
        good = lengths[value >= (1 - 1e-3) * value.max()]
        # Configurations begin with the lengths that are furthest behind.
        order = good[np.lexsort((-good, -np.round(left[good] / demand[good], 2)))][:BATCH]
        step = max(1, -(-share // max(1, len(order))))
        placed = 0
        for length in order.tolist():
            if placed >= share:
                break
            if not left[length]:
                continue
            config = _filled(length, taken, capacity)
            kinds, times = np.unique(config, return_counts=True)
            copies = int(min(step, share - placed, (left[kinds] // times).min()))
            if copies <= 0 or capacity - sum(config) > capacity * 0.002 and idle < 2 and done < 0.9:
                continue
            left[kinds] -= copies * times
            key = tuple(sorted(config, reverse=True))
            used[key] = used.get(key, 0) + copies
            placed += copies
            done += copies * sum(config) / max(total, 1)
        idle = 0 if placed else idle + 1
        lag = np.where(demand > 0, left / np.maximum(demand, 1) - (1 - done), 0)
        price = base * np.exp(RATE * np.clip(lag, -1, 1))
    return _best_fit(used, left, capacity)


def _best_fit(used: dict[tuple[int, ...], int], left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Places what is left, longest first, each into the open sequences with the least room that holds it."""
    by_room: dict[int, dict[tuple[int, ...], int]] = {}
    mask = 0

    def put(config: tuple[int, ...], n: int) -> None:
        nonlocal mask
        room = capacity - sum(config)
        group = by_room.setdefault(room, {})
        group[config] = group.get(config, 0) + n
        mask |= 1 << room

    for config, n in used.items():
        put(config, n)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            above = mask >> length
            if not above:
                each = capacity // length
                whole, rest = divmod(n, each)
                if whole:
                    put((length,) * each, whole)
                if rest:
                    put((length,) * rest, 1)
                break
            room = length + (above & -above).bit_length() - 1
            config, have = by_room[room].popitem()
            k = min(n, have)
            if have > k:
                by_room[room][config] = have - k
            if not by_room[room]:
                mask &= ~(1 << room)
            put((*config, length), k)
            n -= k
    return [(c, n) for group in by_room.values() for c, n in group.items()]


def slots(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Places by length and rank: (length, first rank, ranks, first sequence, offset)."""
    out, ranks, sequence = [], {}, 0
    for config, n in planned:
        offset = 0
        for length in config:
            first = ranks.get(length, 0)
            out.append((length, first, n, sequence, offset))
            ranks[length] = first + n
            offset += length
        sequence += n
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (any columns, ``length`` among them).

    Pieces are written once to the shared folder with a number of their own; the driver gets the histogram. The
    table of places has a row for each length of each configuration; their number depends on the
    capacity and the rounds, not on the number of pieces, so it is broadcast.
    """
    spark = cut.sparkSession
    stored = kept(cut.withColumns({"_row": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}), "pieces")
    full = stored.where(F.col("length") >= capacity).select(*cut.columns, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = stored.where(F.col("length") < capacity)
    counts = items.groupBy("length", "_part").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = spark.createDataFrame(slots(plan(histogram, capacity, rounds)), "length long, _first long, _ranks long, _sequence long, _offset long")
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select("length", "_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy("length", "_part").orderBy("_row")
    ranked = items.withColumn("_inside", F.row_number().over(inside) - 1).join(carried, ["length", "_part"]).withColumn("_rank", F.col("_inside") + F.col("_carried"))
    place = F.broadcast(places.withColumnRenamed("length", "_length"))
    found = ranked.join(place, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_ranks")))
    placed = found.select(*cut.columns, (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), F.col("_offset").alias("offset"))
    return placed.unionByName(full)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences' ids (little-endian 32-bit), from pieces that carry ``ids``; a sequence has at most ``capacity`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(ids.alias("ids"), F.sum("length").alias("n_tokens"))
