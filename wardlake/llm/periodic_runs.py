"""Runs of periodically repeated words, found in a grammar-compressed text.

The words of a slice of texts become numbers, and Re-Pair compresses them: pairs of
neighbouring symbols that occur at least twice give way to a new symbol (a nonterminal),
the most frequent pair first; pairs that do not overlap a more frequent one are replaced in the same round. What
is left of each text is joined by a balanced tree of further symbols, so that every text is one symbol.
Equal passages of the slice, in one text or several, share their symbols.

A run that lies in the text of a symbol X = A B, but neither in A nor in B, crosses the boundary of X. These are
looked for once for each symbol: a period p needs a match of the word left of the boundary with the one p
further, or of the word p left of the boundary with the one right of it, within a stretch of max(p, 12 - p)
matches or more; stretches are measured by hashes of prefixes and then compared word by word. The intervals found are
translated to all places where the symbol occurs in the derivation. An interval that the edge of a
symbol cut is contained in the one that a larger symbol reports; the maximal ones are the runs.

Defined results: words are separated by blanks, tabs, line breaks, vertical tabs and form feeds. A run is a
stretch of words with smallest period q and at least max(12, 2 q) words that no neighbouring word extends. A null
text has no words, no runs and an empty collapsed text, like an empty one. Texts of any length are taken whole; memory
follows the slice and the longest text. Repeated rows have equal results; an empty table gives an
empty table. Added columns replace those of the same name; all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wardlake.llm.bytetext import mix, text_slices

LEAST = 12
#: A stretch of at least LEAST / 2 matches that holds a place has this many on one side of it, the place included.
GRAM = 4
SLICE_BYTES = 1 << 18
#: Pairs of a symbol and a period that are looked at together.
CHUNK = 1 << 20
_PRIME, _BASE = (1 << 31) - 1, 1_103_515_245

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


class Symbols:
    """Nonterminals by the place of one of their occurrences, and all places where they occur."""

    def __init__(self, start: np.ndarray, mid: np.ndarray, end: np.ndarray, symbol: np.ndarray, at: np.ndarray) -> None:
        self.start, self.mid, self.end, self.symbol, self.at = start, mid, end, symbol, at


def _chosen(left: np.ndarray, right: np.ndarray, joined: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of neighbours a round replaces, and which of them occur at least twice.

    Pairs are ranked by count, those of one count in mixed order; a pair is replaced where both pairs that overlap
    it rank lower. In a row of equal overlapping pairs (a a a) every other one is replaced.
    """
    key = np.where(joined, left * n_symbols + right, -1)
    pairs, which, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = (count >= 2) & (pairs >= 0)
    rank = np.empty(len(pairs), np.int64)
    rank[np.lexsort((mix(pairs.astype(np.uint64)), count))] = np.arange(len(pairs))
    rank = np.where(twice, rank, -1)[which]
    row_start = np.concatenate([[True], rank[1:] != rank[:-1]])
    first = np.flatnonzero(row_start)
    top = rank[first]
    before, after = np.concatenate([[-1], top[:-1]]), np.concatenate([top[1:], [-1]])
    row = np.cumsum(row_start) - 1
    peak = (top > before) & (top > after) & (top >= 0)
    return peak[row] & ((np.arange(len(rank)) - first[row]) % 2 == 0), rank >= 0


def compress(words: np.ndarray, offsets: np.ndarray) -> Symbols:
    """Re-Pair over the word numbers of several texts (text i holds ``words[offsets[i]:offsets[i + 1]]``)."""
    n = len(words)
    symbol, start = words.astype(np.int64), np.arange(n)
    end = start + 1
    last = np.zeros(n, bool)
    last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    n_symbols = int(words.max(initial=0)) + 1
    first_symbol = n_symbols
    rules: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    places: list[tuple[np.ndarray, np.ndarray]] = []
    rest: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbol) > 1:
        joined = (end[:-1] == start[1:]) & ~last[end[:-1] - 1]
        take, live = _chosen(symbol[:-1], symbol[1:], joined, n_symbols)
        if not live.any():
            break
        i = np.flatnonzero(take)
        pairs, one, which = np.unique(symbol[i] * n_symbols + symbol[i + 1], return_index=True, return_inverse=True)
        rules.append((start[i[one]], end[i[one]], end[i[one] + 1]))
        places.append((n_symbols + which, start[i]))
        symbol[i] = n_symbols + which
        end[i] = end[i + 1]
        n_symbols += len(pairs)
        # A symbol without a pair that occurs twice can't be paired later, unless a neighbour is new.
        near = np.zeros(len(symbol), bool)
        near[:-1] |= live
        near[1:] |= live
        gone = np.zeros(len(symbol), bool)
        gone[i + 1] = True
        still = ~near & ~gone
        rest.append((start[still], end[still]))
        keep = near & ~gone
        symbol, start, end = symbol[keep], start[keep], end[keep]
    rest.append((start, end))
    start, end = (np.concatenate(x) for x in zip(*rest, strict=True))
    order = np.argsort(start)
    start, end = start[order], end[order]
    # A balanced tree over what is left of each text: every level joins neighbours two by two.
    while len(start) > 1:
        text = np.searchsorted(offsets, start, side="right") - 1
        head = np.searchsorted(text, text)
        even = (np.arange(len(start)) - head) % 2 == 0
        i = np.flatnonzero(even[:-1] & (text[1:] == text[:-1]))
        if not len(i):
            break
        rules.append((start[i], end[i], end[i + 1]))
        places.append((n_symbols + np.arange(len(i)), start[i]))
        n_symbols += len(i)
        end[i] = end[i + 1]
        keep = np.ones(len(start), bool)
        keep[i + 1] = False
        start, end = start[keep], end[keep]
    if not rules:
        none = np.zeros(0, np.int64)
        return Symbols(none, none, none, none, none)
    columns = [np.concatenate(x) for x in zip(*rules, strict=True)]
    at = [np.concatenate(x) for x in zip(*places, strict=True)]
    return Symbols(*columns, at[0] - first_symbol, at[1])


class _Prefixes:
    """Hashes of all prefixes of a sequence, to compare stretches of it."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        power = np.ones(max(n, 1), np.int64)
        size = 1
        while size < n:
            power[size : 2 * size] = power[: min(size, n - size)] * pow(_BASE, size, _PRIME) % _PRIME
            size *= 2
        value = (mix(words.astype(np.uint64) + np.uint64(1)) % np.uint64(_PRIME - 1)).astype(np.int64) + 1
        self.power, self.sums = power, np.concatenate([[0], np.cumsum(value * power[:n] % _PRIME)])

    def same(self, a: np.ndarray, shift: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words at a are those at a + shift, up to collisions."""
        x = (self.sums[a + size] - self.sums[a]) % _PRIME * self.power[shift] % _PRIME
        return x == (self.sums[a + shift + size] - self.sums[a + shift]) % _PRIME

    def reach(self, a: np.ndarray, shift: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """How many words on from a (or back, before a) match those ``shift`` further, at most ``limit``."""
        low, high = np.zeros_like(a), limit.copy()
        while True:
            open_ = low < high
            if not open_.any():
                return low
            half = (low + high + 1) // 2
            ok = self.same(a - half if back else a, shift, half) | ~open_
            low = np.where(open_ & ok, half, low)
            high = np.where(open_ & ~ok, half - 1, high)


def _ragged(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of first, first + 1, ... of ``size`` values for each owner."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def _grams(words: np.ndarray) -> np.ndarray:
    """A key for the GRAM words from each place on (fewer at the end)."""
    key = mix(words.astype(np.uint64) + np.uint64(1))
    out = key.copy()
    for k in range(1, GRAM):
        out[:-k] = mix(out[:-k]) + key[k:]
    return out


def crossing(words: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Symbol, start, end and period of the repetitions that cross the boundary of each symbol, within its text."""
    grams, prefixes = _grams(words), _Prefixes(words)
    n = len(words)
    found = []
    size = end - start
    for side in ("left", "right"):
        periods = np.minimum(size // 2, (mid - start) if side == "left" else (end - mid))
        group = np.cumsum(periods) // CHUNK
        for g in np.unique(group).tolist():
            mine = np.flatnonzero(group == g)
            owner, p = _ragged(np.ones(len(mine), np.int64), periods[mine])
            x = mine[owner]
            # The place that a stretch of matches must hold.
            i = mid[x] - (p if side == "left" else 1)
            back = np.maximum(i - GRAM + 1, 0)
            like = (words[i] == words[np.minimum(i + p, n - 1)]) & ((grams[i] == grams[np.minimum(i + p, n - 1)]) | (grams[back] == grams[np.minimum(back + p, n - 1)]))
            x, p, i = x[like], p[like], i[like]
            ahead = prefixes.reach(i, p, end[x] - p - i, False)
            behind = prefixes.reach(i, p, i - start[x], True)
            s, e = i - behind, i + ahead + p
            whole = e - s >= np.maximum(LEAST, 2 * p)
            found.append((x[whole], s[whole], e[whole], p[whole]))
    x, s, e, p = (np.concatenate(c) for c in zip(*found, strict=True))
    # Multiples of a period have the same interval: the smallest stays.
    order = np.lexsort((p, e, s, x))
    x, s, e, p = x[order], s[order], e[order], p[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    x, s, e, p = x[new], s[new], e[new], p[new]
    owner, at = _ragged(s, e - s - p)
    wrong = np.unique(owner[words[at] != words[at + p[owner]]])
    if len(wrong):
        return _crossing_by_words(words, start, mid, end)
    return x, s, e, p


def _crossing_by_words(words: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same without hashes, for the rare slice in which two stretches collide."""
    out: dict[tuple[int, int, int], int] = {}
    for x, (a, b, c) in enumerate(zip(start.tolist(), mid.tolist(), end.tolist(), strict=True)):
        for p in range(1, (c - a) // 2 + 1):
            differ = np.flatnonzero(words[a : c - p] != words[a + p : c]) + a
            edges = np.concatenate([[a - 1], differ, [c - p]])
            for i in (b - p, b - 1):
                k = int(np.searchsorted(edges, i))
                if a <= i < c - p and edges[k] != i:
                    s, e = int(edges[k - 1]) + 1, int(edges[k]) + p
                    if e - s >= max(LEAST, 2 * p):
                        out.setdefault((x, s, e), p)
    rows = np.array([(*k, p) for k, p in out.items()], np.int64).reshape(-1, 4)
    return tuple(rows.T)


def runs_of(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (places in ``words``) and period of all runs, by start and then period."""
    symbols = compress(words, offsets)
    large = np.flatnonzero(symbols.end - symbols.start >= LEAST)
    if not len(large):
        none = np.zeros(0, np.int64)
        return none, none, none
    x, s, e, p = crossing(words, symbols.start[large], symbols.mid[large], symbols.end[large])
    x = large[x]
    s, e = s - symbols.start[x], e - symbols.start[x]
    # To all places of the derivation.
    first = np.searchsorted(x, symbols.symbol)
    owner, k = _ragged(first, np.searchsorted(x, symbols.symbol, side="right") - first)
    s, e, p = s[k] + symbols.at[owner], e[k] + symbols.at[owner], p[k]
    order = np.lexsort((p, e, s))
    s, e, p = s[order], e[order], p[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, p = s[new], e[new], p[new]
    # Maximal intervals of each period.
    order = np.lexsort((-e, s, p))
    s, e, p = s[order], e[order], p[order]
    reach = np.maximum.accumulate(e + p * (len(words) + 1))
    new = np.ones(len(s), bool)
    new[1:] = (p[1:] != p[:-1]) | (e[1:] + p[1:] * (len(words) + 1) > reach[:-1])
    s, e, p = s[new], e[new], p[new]
    order = np.lexsort((p, s))
    return s[order], e[order], p[order]


def _slice(data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """Runs and collapsed text of each text of a slice."""
    raw = data.tobytes()
    texts = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(at[-1]))
    s, e, p = runs_of(words, at)
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, s + p, 1)
    np.add.at(dropped, e, -1)
    kept = np.cumsum(dropped)[:-1] == 0
    bounds = np.searchsorted(s, at)
    found, collapsed = [], []
    for t, (words_, a, i, j) in enumerate(zip(texts, at[:-1].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        found.append([(int(s[k]) - a, int(e[k] - s[k]), int(p[k])) for k in range(i, j)])
        if i < j:
            words_ = [w for w, k in zip(words_, kept[a : at[t + 1]].tolist(), strict=True) if k]
        collapsed.append(b" ".join(words_).decode())
    return found, collapsed


def with_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Adds the runs of every text (array of start, length, period, by start and then period) and the text without repeats.

    The collapsed text holds, joined by single blanks, all words but those that lie in some run after its first ``period`` words.
    """
    added = [T.StructField(runs, T.ArrayType(RUN)), T.StructField(collapsed, T.StringType())]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in (runs, collapsed)] + added)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c not in (runs, collapsed)}
            for i, j, data, offsets in text_slices(batch.column(text), SLICE_BYTES):
                found, left = _slice(data, offsets)
                rows = [[{"start": a, "length": b, "period": c} for a, b, c in r] for r in found]
                yield pa.RecordBatch.from_pydict({c: v.slice(i, j - i) for c, v in columns.items()} | {runs: pa.array(rows, kind), collapsed: pa.array(left, pa.string())})

    return docs.mapInArrow(work, schema)
