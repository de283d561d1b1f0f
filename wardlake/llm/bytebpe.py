"""Ids of a byte-level BPE tokenizer, through the ``tokenizers`` library.

The library's own model merges the bytes; the split into words before that is done here,
because the library's split costs several times as much as the merges. A text is cut
where the split pattern always breaks and looks no further: before a blank with a character
other than white space on one side of it, and between ASCII letters, punctuation and line
breaks; the last white space before another character is a segment of its own, as in the pattern. The special tokens of the vocabulary are cut out first, as the library does by default.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from wardlake.llm.segments import Dictionary, text_starts

VOCABULARY = "byte_bpe_50k.json"

_CLASS = np.zeros(256, np.uint8)
_WORD, _MARK, _BREAK, _OTHER = 1, 2, 3, 4
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = _WORD
_CLASS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _MARK
_CLASS[range(0x09, 0x0E)] = _BREAK
_CLASS[range(0xC3, 0xE0)] = _OTHER  # lead bytes of U+00C0 to U+07FF, none of which is white space


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of texts, blanks with a character other than white space before or after them, and places between
    letters, punctuation and line breaks at which words of the pattern always end."""
    kind = _CLASS[data]
    here, past = kind[1:], kind[:-1]
    word, mark, gap = here == _WORD, here == _MARK, here == _BREAK
    past_word, past_mark, past_gap = past == _WORD, past == _MARK, past == _BREAK
    solid = (here > 0) & ~gap
    begin = text_starts(data, offsets)
    blank = data == 0x20
    out = begin.copy()
    out[1:] |= blank[1:] & (past_word | past_mark)
    out[:-1] |= blank[:-1] & solid & ~begin[1:]
    last = solid & past_gap
    out[1:] |= (mark | gap) & past_word | gap & past_mark | word & past_mark & (data[:-1] != 0x27) | last
    # The pattern gives the last break of a run as a word of its own, unless the text ends with it.
    out[:-1] |= last & ~begin[1:]
    return np.flatnonzero(out)


class Encoder:
    """Encodes Arrow string columns; ids are 16 bits wide where the vocabulary allows."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = _byte_letters()
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.added_bytes = [a.encode() for a in self.added]
        # ASCII letters, perhaps after one blank, are one word of the pattern; no special token hides in them.
        plain = not any(a.removeprefix(" ").isalpha() or a == " " for a in self.added)
        self.word = re.compile(rb" ?[A-Za-z]+").fullmatch if plain else lambda s: None
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.dictionary = Dictionary(self.encode, self.cut, self.dtype)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw = data.tobytes()
        if any(a in raw for a in self.added_bytes):
            return np.unique(offsets[:-1][np.diff(offsets) > 0])
        return cuts(data, offsets)

    def encode(self, segments: list[bytes]) -> list[list[int]]:
        merge, word = self.model.tokenize, self.word
        out = []
        for s in segments:
            if word(s):
                out.append([t.id for t in merge(s.decode("ascii").replace(" ", self.letters[0x20]))])
            else:
                out.append(self._ids(s))
        return out

    def _ids(self, segment: bytes) -> list[int]:
        text = segment.decode("utf-8", "replace")
        if self.special and (m := self.special.search(text)):
            left, right = text[: m.start()].encode(), text[m.end() :].encode()
            return [*self._ids(left), self.added[m.group()], *self._ids(right)]
        out: list[int] = []
        letters, merge = self.letters, self.model.tokenize
        for w in [text] if text.isalpha() or text[:1] == " " and text[1:].isalpha() else self.split(text):
            out += [t.id for t in merge("".join([letters[b] for b in w.encode("utf-8")]))]
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    return Encoder(path)


def vocabulary_path(path: str | None = None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def encoded(column: pa.Array, path: str | None = None):
    """For each slice of texts: row range, ids, and where each text's ids begin. Nulls are empty texts."""
    return encoder(vocabulary_path(path)).dictionary.slices(column)
