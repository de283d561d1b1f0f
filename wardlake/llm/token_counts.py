"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton names all pieces that end at each character; a dynamic program
carries the best score and the number of pieces of the best segmentation. As in the
tokenizer, candidates of one end come by ascending start, that is longest piece first, and a later one wins
only if its score is higher. A character that no piece begins and ends with is unknown: it scores ten below
the worst piece and counts as its UTF-8 bytes.

Defined results: null and empty texts have 0 tokens; very long texts are counted whole; ties follow
the rule above; repeated rows have equal counts; an empty table gives an empty table. The added
column replaces one of the same name; all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wardlake.llm import unigram
from wardlake.llm.segments import Dictionary


class Counter:
    def __init__(self, path: str | None = None) -> None:
        self.vocabulary = v = unigram.load(path)
        self.machine = ahocorasick.Automaton()
        for piece, (_, score) in v.pieces.items():
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.single = {p for p in v.pieces if len(p) == 1}
        self.dictionary = Dictionary(self.encode, lambda d, o: unigram.cuts(d, o, v.lonely), np.int32)

    def encode(self, segments: list[bytes]) -> list[np.ndarray]:
        return [np.array([self.count(s.decode("utf-8", "replace"))], np.int32) for s in segments]

    def count(self, text: str) -> int:
        """Number of pieces of the best segmentation."""
        least, unknown, single = -np.inf, self.vocabulary.unknown, self.single
        best, pieces = [0.0, *[least] * len(text)], [0] * (len(text) + 1)
        done = 0
        for last, (length, score) in self.machine.iter(text):
            end = last + 1
            while done < last:
                done += 1
                self._unknown(text, done, best, pieces, single, unknown)
            value = best[end - length] + score
            if value > best[end]:
                best[end] = value
                pieces[end] = pieces[end - length] + 1
        while done < len(text):
            done += 1
            self._unknown(text, done, best, pieces, single, unknown)
        return pieces[-1]

    @staticmethod
    def _unknown(text: str, end: int, best: list[float], pieces: list[int], single: set[str], score: float) -> None:
        """The unknown character that ends here, after all pieces that end here."""
        char = text[end - 1]
        if char not in single and best[end - 1] + score > best[end]:
            best[end] = best[end - 1] + score
            pieces[end] = pieces[end - 1] + len(char.encode())

    def counts(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column), np.int64)
        for i, j, numbers, starts in self.dictionary.slices(unigram.marked(column)):
            total = np.concatenate([[0], np.cumsum(numbers, dtype=np.int64)])
            out[i:j] = total[starts[1:]] - total[starts[:-1]]
        return out


@lru_cache(maxsize=1)
def counter(path: str | None = None) -> Counter:
    """One automaton and dictionary for each Python worker."""
    return Counter(path)


def with_token_counts(docs: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """Adds the number of unigram tokens of every text."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != out}
            yield pa.RecordBatch.from_pydict(columns | {out: pa.array(counter(path).counts(batch.column(text)))})

    return docs.mapInArrow(work, schema)
