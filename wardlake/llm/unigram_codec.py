"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

New segments of a slice go through the trie together: for each start position all segments walk down the trie
in step, and every piece met offers a score to the position behind it. A later start wins only
with a higher score. A character that is no piece scores ten below the worst piece and is
written as its bytes' pieces (byte fallback). Decoding joins the pieces' bytes, turns markers into blanks and
takes the blank in front away.

Defined results: null and empty texts have no ids and decode to the empty text; a whitespace marker in a text decodes to a
blank; very long texts are encoded whole; repeated rows have equal ids; an empty table gives an empty
table. Added columns replace columns of the same name; all others are kept.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wardlake.llm import unigram
from wardlake.llm.segments import Dictionary

#: Cells of the score matrix of one group of segments.
MATRIX = 1 << 19


@dataclass(frozen=True)
class DoubleArray:
    """State ``t = base[s] + byte`` follows state s if ``check[t] == s``; ``value[t]`` is a piece's id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def build(keys: dict[bytes, int]) -> DoubleArray:
        root: dict = {}
        for key, value in keys.items():
            node = root
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = value
        size = 1 << 12
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        low = 256  # below this all cells are taken; the first 256 stay free so that no base is negative
        waiting = deque([(0, root)])
        while waiting:
            state, node = waiting.popleft()
            bytes_ = sorted(b for b in node if b >= 0)
            value[state] = node.get(-1, -1)
            if not bytes_:
                base[state] = -1
                continue
            while low < len(check) and check[low] != -1:
                low += 1
            at = low - bytes_[0]
            while True:
                while at + 256 >= len(check):
                    grown = len(check)
                    base += [0] * grown
                    check += [-1] * grown
                    value += [-1] * grown
                if all(check[at + b] == -1 for b in bytes_):
                    break
                at += 1
            base[state] = at
            for b in bytes_:
                check[at + b] = state
            waiting.extend((at + b, node[b]) for b in bytes_)
        # A state without followers points at cells that belong to no state.
        free = len(check)
        ends = np.array(base) < 0
        out = np.where(ends, free, np.array(base))
        pad = np.full(512, -1)
        return DoubleArray(np.concatenate([out, pad]).astype(np.int32), np.concatenate([check, pad]).astype(np.int32), np.concatenate([value, pad]).astype(np.int32))


class Codec:
    def __init__(self, path: str | None = None, trie: DoubleArray | None = None) -> None:
        self.vocabulary = v = unigram.load(path)
        self.trie = trie or trie_of(path)
        self.score = np.full(v.size, -np.inf)
        text = [b""] * v.size
        for piece, (i, score) in v.pieces.items():
            self.score[i], text[i] = score, piece.encode()
        self.byte_ids = np.array(v.byte_ids, np.int32)
        for b, i in enumerate(v.byte_ids):
            text[i] = bytes([b])
        self.sizes = np.array(list(map(len, text)))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.dtype = np.uint16 if v.size <= 1 << 16 else np.int32
        self.dictionary = Dictionary(self.encode, lambda d, o: unigram.cuts(d, o, v.lonely), self.dtype)

    def encode(self, segments: list[bytes]) -> list[np.ndarray]:
        """Ids of each segment; segments of like length are worked on together."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        order = np.argsort(sizes, kind="stable")
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(segments)
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and (j + 1 - i) * (int(sizes[order[j]]) + 1) <= MATRIX or j == i:
                j += 1
            group = order[i:j]
            for k, ids in zip(group.tolist(), self._group([segments[k] for k in group.tolist()], sizes[group]), strict=True):
                out[k] = ids
            i = j
        return out

    def _group(self, segments: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
        n, longest = len(segments), int(sizes.max())
        text = np.zeros((n, longest), np.uint8)
        text[np.arange(longest) < sizes[:, None]] = np.frombuffer(b"".join(segments), np.uint8)
        begins = ((text & 0xC0) != 0x80) & (np.arange(longest) < sizes[:, None])
        wide = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, longest + 1), np.int32)
        piece = np.zeros((n, longest + 1), np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(longest):
            every = np.flatnonzero(begins[:, i])
            if not len(every):
                continue
            width = np.minimum(wide[every, i], sizes[every] - i)
            known = np.zeros(len(every), bool)
            row, here, at = every, np.arange(len(every)), i
            state = np.zeros(len(every), np.int32)
            while at < longest and len(row):
                inside = sizes[row] > at
                to = base[state] + text[row, at]
                go = inside & (check[to] == state)
                row, here, state = row[go], here[go], to[go]
                at += 1
                found = value[state]
                hit = found >= 0
                if hit.any():
                    r, w, ids = row[hit], here[hit], found[hit]
                    known[w[at - i == width[w]]] = True
                    offer = best[r, i] + self.score[ids]
                    better = offer > best[r, at]
                    r = r[better]
                    best[r, at], back[r, at], piece[r, at] = offer[better], i, ids[better]
            lost = np.flatnonzero(~known)
            if len(lost):
                r, w = every[lost], width[lost]
                offer = best[r, i] + self.vocabulary.unknown
                better = offer > best[r, i + w]
                r, w = r[better], w[better]
                best[r, i + w] = offer[better]
                for d in range(int(w.max(initial=0))):
                    rr = r[w > d]
                    back[rr, i + d + 1], piece[rr, i + d + 1] = i + d, self.byte_ids[text[rr, i + d]]
        ids = np.zeros((n, longest), self.dtype)
        count = np.zeros(n, np.int64)
        row, at = np.arange(n), sizes.copy()
        while len(row):
            ids[row, count[row]] = piece[row, at]
            count[row] += 1
            at = back[row, at]
            go = at > 0
            row, at = row[go], at[go]
        return [ids[k, :c][::-1] for k, c in enumerate(count.tolist())]

    def encoded(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each slice of texts: row range, ids, and where each text's ids begin."""
        return self.dictionary.slices(unigram.marked(column))

    def decoded(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of all texts and where each begins, without the blank in front."""
        size = self.sizes[ids]
        stops = np.cumsum(size)
        total = int(stops[-1]) if len(stops) else 0
        raw = self.bytes[np.arange(total) + np.repeat(self.starts[ids] - (stops - size), size)]
        at = np.concatenate([[0], stops])[starts]
        keep = np.ones(total, bool)
        keep[at[:-1][at[1:] > at[:-1]]] = False
        return raw[keep], at - np.concatenate([[0], np.cumsum(at[1:] > at[:-1])])


@lru_cache(maxsize=1)
def trie_of(path: str | None = None) -> DoubleArray:
    """The vocabulary's trie; it is built once, on the driver, and handed to the tasks (a few megabytes)."""
    return DoubleArray.build({p.encode(): i for p, (i, _) in unigram.load(path).pieces.items()})


_CODECS: dict[str | None, Codec] = {}


def codec(path: str | None = None, trie: DoubleArray | None = None) -> Codec:
    """One codec and dictionary for each Python worker and vocabulary."""
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = Codec(path, trie)
    return _CODECS[path]


def _texts(c: Codec, ids: np.ndarray, starts: np.ndarray) -> list[str]:
    data, at = c.decoded(ids, starts)
    return [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]


def round_trip(docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds the ids of every text and the text that they decode to, in one pass."""
    added = [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in (ids, decoded)] + added)
    trie = docs.sparkSession.sparkContext.broadcast(trie_of(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, trie.value)
        for batch in batches:
            for i, j, found, starts in c.encoded(batch.column(text)):
                part = batch.slice(i, j - i)
                columns = {n: part.column(k) for k, n in enumerate(part.schema.names) if n not in (ids, decoded)}
                columns[ids] = pa.array([found[a:b].astype("<u4").tobytes() for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)], pa.binary())
                yield pa.RecordBatch.from_pydict(columns | {decoded: pa.array(_texts(c, found, starts), pa.string())})

    return docs.mapInArrow(work, schema)


def with_ids(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Adds the ids of every text as little-endian integers of 32 bits."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, T.BinaryType())])
    trie = docs.sparkSession.sparkContext.broadcast(trie_of(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[bytes] = []
            for i, j, ids, starts in codec(path, trie.value).encoded(batch.column(text)):
                rows += [ids[starts[k] : starts[k + 1]].astype("<u4").tobytes() for k in range(j - i)]
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != out}
            yield pa.RecordBatch.from_pydict(columns | {out: pa.array(rows, pa.binary())})

    return docs.mapInArrow(work, schema)


def with_text(coded: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds the text that ids stand for; null ids decode to the empty text."""
    schema = T.StructType([f for f in coded.schema.fields if f.name != out] + [T.StructField(out, T.StringType())])
    trie = coded.sparkSession.sparkContext.broadcast(trie_of(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for raw in batch.column(ids):
                row = np.frombuffer(raw.as_py() or b"", "<u4").astype(np.int64)
                texts += _texts(codec(path, trie.value), row, np.array([0, len(row)]))
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != out}
            yield pa.RecordBatch.from_pydict(columns | {out: pa.array(texts, pa.string())})

    return coded.mapInArrow(work, schema)
