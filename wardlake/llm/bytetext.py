"""Whole texts as byte buffers: runs of bytes and their keys, by numpy.

Texts come as Arrow string columns and are taken in slices of a quarter of a megabyte,
so memory follows the slice and the longest text, never the partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=2)
def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base, out = _BASES[which], []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.ones(SLICE_BYTES, np.uint64)
        size = 1
        while size < SLICE_BYTES:
            p[size : 2 * size] = p[:size] * np.uint64(pow(b, size, 1 << 64))
            size *= 2
        out.append(p)
    return out[0], out[1]


def run_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit key of every run ``data[start:end]``; runs are ascending and do not overlap.

    The key is a polynomial of the run's bytes, mixed with its length. Equal runs have
    equal keys wherever they lie. A run longer than a slice is hashed by itself.
    """
    up, down = _powers(which)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + SLICE_BYTES - 1, side="right"))
        if j <= i:
            digest = hashlib.blake2b(data[base : int(ends[i])].tobytes(), digest_size=8, salt=bytes([which]))
            out[i] = int.from_bytes(digest.digest(), "little")
            i += 1
            continue
        s, e = starts[i:j] - base, ends[i:j] - base
        size = int(e[-1])
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data[base : base + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each text begins (one more entry than texts); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets of each slice of a string column."""
    data, offsets = text_buffer(column)
    for i, j in slices(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words for language features: ASCII letters and digits and all bytes of other characters.
WORDY = np.zeros(256, bool)
WORDY[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the bytes that ``inside`` (a table of 256 flags) marks: starts, ends and each run's text.

    No run goes past the end of its text.
    """
    mark = inside[data]
    first = mark.copy()
    first[1:] &= ~mark[:-1]
    last = mark.copy()
    last[:-1] &= ~mark[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= mark[edges]
    last[edges - 1] |= mark[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def bounds(owner: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` owners begins in an ascending owner array (one more entry)."""
    return np.searchsorted(owner, np.arange(n + 1))
