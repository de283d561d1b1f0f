"""Encoding whole texts through a dictionary of segments.

A segmenter names places at which a tokenizer's output certainly breaks, so a text's ids are
its segments' ids one after another. Segments repeat far more than texts: each slice of
texts is looked up by numpy in a table of slots, and only segments that a worker has not
met are encoded. Keys have 128 bits: the second half is compared with every occurrence, and a
clash is encoded by itself. The dictionary is emptied when it is full, so its memory is bounded;
it holds arrays only, about 40 bytes and the ids for a segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from wardlake.llm.bytetext import run_keys, text_slices

#: Segments that a worker remembers.
REMEMBERED = 1_200_000


def _doubled(a: np.ndarray) -> np.ndarray:
    """The array with as much room again, whose memory is not touched before it is used."""
    out = np.zeros(2 * len(a), a.dtype)
    out[: len(a)] = a
    return out


class Dictionary:
    """Remembers a short row of numbers for every segment.

    ``encode`` gives these rows for a list of segments; ``cut`` gives the starts of the
    segments of a slice, ascending, text starts included.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray] | list[list[int]]], cut: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype: type) -> None:
        self.encode, self.cut, self.dtype = encode, cut, dtype
        self.clear()

    def clear(self) -> None:
        self.first = np.zeros(1 << 12, np.uint64)
        self.second = np.zeros(1 << 12, np.uint64)
        self.found = np.zeros(1 << 12, bool)
        self.start = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int32)
        self.pool = np.zeros(1 << 14, self.dtype)
        self.slots = np.full(1 << 14, -1, np.int32)
        self.count = self.used = 0

    def _add(self, first: np.ndarray, second: np.ndarray, rows: list[np.ndarray] | list[list[int]], findable: bool = True) -> np.ndarray:
        """Stores rows and returns their places; rows that are not ``findable`` are not found again."""
        n = self.count
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        total = int(sizes.sum())
        while n + len(rows) > len(self.first):
            self.first, self.second, self.found, self.start, self.size = map(_doubled, (self.first, self.second, self.found, self.start, self.size))
        while self.used + total > len(self.pool):
            self.pool = _doubled(self.pool)
        at = np.arange(n, n + len(rows))
        self.first[at], self.second[at], self.found[at], self.size[at] = first, second, findable, sizes
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        if total:
            flat = np.concatenate(rows) if isinstance(rows[0], np.ndarray) else np.fromiter(chain.from_iterable(rows), self.dtype, total)
            self.pool[self.used : self.used + total] = flat
        self.used += total
        self.count = n + len(rows)
        if 2 * self.count > len(self.slots):
            self.slots = np.full(1 << (2 * self.count).bit_length(), -1, np.int32)
            self._enter(np.flatnonzero(self.found[: self.count]))
        elif findable:
            self._enter(at)
        return at

    def _enter(self, place: np.ndarray) -> None:
        """Gives each of these places, whose keys differ, the next free slot from its key on."""
        mask = len(self.slots) - 1
        slot = (self.first[place] & np.uint64(mask)).astype(np.int64)
        while len(place):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = place[free]
            rest = self.slots[slot] != place
            place, slot = place[rest], (slot[rest] + 1) & mask

    def _look_up(self, key: np.ndarray) -> np.ndarray:
        """The place of every key, -1 for those not met."""
        mask = len(self.slots) - 1
        slot = (key & np.uint64(mask)).astype(np.int64)
        place = self.slots[slot]
        other = np.flatnonzero((place >= 0) & (self.first[place] != key))
        while len(other):
            slot[other] = (slot[other] + 1) & mask
            here = self.slots[slot[other]]
            place[other] = here
            other = other[(here >= 0) & (self.first[here] != key[other])]
        return place

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of every segment."""
        first, second = run_keys(data, starts, ends, 0), run_keys(data, starts, ends, 1)
        out = self._look_up(first)
        new = np.flatnonzero(out < 0)
        if len(new):
            unique, where, inverse = np.unique(first[new], return_index=True, return_inverse=True)
            if self.count and self.count + len(unique) > REMEMBERED:
                self.clear()
                return self.places(data, starts, ends)
            where = new[where]
            out[new] = self._add(unique, second[where], self.encode(self._bytes(data, starts, ends, where)))[inverse]
        clash = np.flatnonzero(self.second[out] != second)
        if len(clash):
            out[clash] = self._add(first[clash], second[clash], self.encode(self._bytes(data, starts, ends, clash)), findable=False)
        return out

    @staticmethod
    def _bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> list[bytes]:
        raw = data.tobytes()
        return [raw[s:e] for s, e in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]

    def slices(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each slice of texts: row range, all numbers, and where each text's numbers begin."""
        for i, j, data, offsets in text_slices(column):
            starts = self.cut(data, offsets)
            ends = np.append(starts[1:], len(data)) if len(starts) else starts
            place = self.places(data, starts, ends)
            size = self.size[place]
            stops = np.cumsum(size)
            total = int(stops[-1]) if len(stops) else 0
            source = np.arange(total) + np.repeat(self.start[place] - (stops - size), size)
            by_segment = np.concatenate([[0], stops])
            yield i, j, self.pool[source], by_segment[np.searchsorted(starts, offsets)]


def text_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A flag for every byte at which a text begins."""
    out = np.zeros(len(data) + 1, bool)
    out[offsets[:-1]] = True
    return out[:-1]
