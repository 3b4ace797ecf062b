"""Reading a SentencePiece model file: its pieces, their scores and kinds, and how blanks are written."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

#: The character that stands for a blank inside pieces.
BLANK = "▁"

# Numbers of fields and of kinds of pieces in the file format.
PIECES, NORMALIZER = 1, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one message."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        if key & 7 == 0:
            value, at = _number(data, at)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, at = _number(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class PieceModel:
    """``scores`` has the pieces that texts are merged into, the higher the earlier; ``byte_ids`` the ids
    of the 256 single bytes, if the model has them."""

    pieces: tuple[str, ...]
    kinds: tuple[int, ...]
    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: tuple[int, ...] | None
    unknown_id: int
    end_id: int
    dummy_prefix: bool


def read_model(data: bytes) -> PieceModel:
    """The model in ``data``. Models that rewrite characters, squeeze blanks or have pieces defined by
    users are refused: they are no plain merging of characters."""
    pieces, kinds, scores = [], [], []
    normalizer: dict[int, int | bytes] = {}
    for number, value in _fields(data):
        if number == PIECES:
            piece = dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
            kinds.append(piece.get(3, NORMAL))
        elif number == NORMALIZER:
            normalizer = dict(_fields(value))
    dummy_prefix, squeeze, escape = (normalizer.get(k, 1) for k in (3, 4, 5))
    if normalizer.get(2) or squeeze or not escape or {USER_DEFINED, UNUSED} & set(kinds):
        raise ValueError("only models that merge the characters of a text as it is are supported")
    by_byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == BYTE}
    normal = [i for i, k in enumerate(kinds) if k == NORMAL]
    return PieceModel(
        tuple(pieces),
        tuple(kinds),
        {pieces[i]: scores[i] for i in normal},
        {pieces[i]: i for i in normal},
        tuple(by_byte[b] for b in range(256)) if len(by_byte) == 256 else None,
        kinds.index(UNKNOWN),
        pieces.index("</s>"),
        bool(dummy_prefix),
    )
