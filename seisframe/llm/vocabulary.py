"""Reading the public tokenizer files. Their folder is a parameter; nothing is copied or trained."""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass
from functools import lru_cache

#: Where the vocabulary files of the public tokenizers are, unless a path is given.
FOLDER = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")

PIECES, BYTE_BPE, BYTE_BPE_RANKS = "piece_bpe_32k.model", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: The character that stands for a space inside pieces.
SPACE = "▁"


def path(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or FOLDER, name)


@dataclass(frozen=True)
class Piece:
    text: str
    score: float
    kind: int


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    """(field number, value) of a protocol-buffer message; nested messages stay bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 1:
            value, at = data[at : at + 8], at + 8
        elif wire == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif wire == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"unknown wire type {wire}")
        yield tag >> 3, value


@dataclass(frozen=True)
class PieceModel:
    pieces: tuple[Piece, ...]
    unk_id: int
    byte_fallback: bool
    add_dummy_prefix: bool
    remove_extra_whitespaces: bool
    charsmap: bytes
    #: 2: byte-pair merges
    model_type: int


@lru_cache(maxsize=4)
def piece_model(file: str) -> PieceModel:
    """The parts of a sentencepiece model file that encoding and decoding need."""
    with open(file, "rb") as f:
        data = f.read()
    pieces, norm, train = [], {}, {}
    for field, value in _fields(data):
        if field == 1:
            own = dict(_fields(value))
            pieces.append(Piece(own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
        elif field == 2:
            train = dict(_fields(value))
        elif field == 3:
            norm = dict(_fields(value))
    unk = next((i for i, p in enumerate(pieces) if p.kind == UNKNOWN), 0)
    return PieceModel(tuple(pieces), unk, bool(train.get(35, 0)), bool(norm.get(3, 1)), bool(norm.get(4, 1)), norm.get(2, b""), train.get(3, 1))
