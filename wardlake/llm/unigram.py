"""A unigram vocabulary: pieces with log scores, and where texts can be cut.

Pieces come from a public SentencePiece file. No scores are trained: the file's order is by
frequency, and a piece's log score is minus the logarithm of its rank, rounded to 1/1024 so
that sums are exact and the segmentation of a text does not depend on how it is cut. A model whose own
scores are log scores is used as it is with ``ranked=False``.

Texts are marked as SentencePiece does: one blank is put before a text that is not empty, and blanks are the
whitespace marker; a marker that stands in a text counts as a blank. Here the marker is the byte of the blank.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece

from wardlake.llm.segments import text_starts

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
GRID = 1024


@dataclass(frozen=True)
class Vocabulary:
    """pieces: piece as text with blanks for markers -> (id, score). bytes: id of each byte piece. lonely: bytes of characters that no longer piece holds."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    size: int
    unknown: float
    lonely: np.ndarray


@lru_cache(maxsize=2)
def load(path: str | None = None, ranked: bool = True) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces: dict[str, tuple[int, float]] = {}
    byte_ids = [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            score = -round(np.log(i + 1) * GRID) / GRID if ranked else float(model.get_score(i))
            pieces[piece.replace(MARKER, " ")] = (i, score)
    together = np.zeros(256, bool)
    together[0x80:] = True
    for piece in pieces:
        if len(piece) > 1:
            together[[b for b in piece.encode() if b < 0x80]] = True
    return Vocabulary(pieces, tuple(byte_ids), model.get_piece_size(), min(s for _, s in pieces.values()) - UNKNOWN_PENALTY, ~together)


def marked(column: pa.Array) -> pa.Array:
    """Texts with the blank in front; nulls are empty texts."""
    text = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), MARKER, " ")
    blank = pa.scalar(" ", pa.large_string())
    front = pc.binary_join_element_wise(blank, text, pa.scalar("", pa.large_string()))
    return pc.if_else(pc.equal(pc.binary_length(text), 0), text, front)


def cuts(data: np.ndarray, offsets: np.ndarray, lonely: np.ndarray) -> np.ndarray:
    """Starts of segments that no piece crosses: texts, runs of blanks, and both sides of lonely characters.

    Pieces hold blanks only at their start or as runs of blanks, so none goes from another character into a blank.
    """
    first = text_starts(data, offsets)
    blank = data == 0x20
    alone = lonely[data]
    first[1:] |= blank[1:] & ~blank[:-1] | alone[1:] | alone[:-1]
    return np.flatnonzero(first)
