"""Vectorised encoding and decoding of samples, header fields and text."""

from __future__ import annotations

import numpy as np

from . import spec

FLT_MAX = np.finfo(np.float32).max


def ibm_to_float(words: np.ndarray, mode: str = "round") -> np.ndarray:
    """IBM hexadecimal words (uint32) to float32: rounded to nearest, or with mode 'trunc' towards zero. Overflow gives the largest float."""
    words = words.astype(np.uint32)
    fraction = (words & 0x00FFFFFF).astype(np.float64)
    exponent = ((words >> 24) & 0x7F).astype(np.int32)
    exact = np.ldexp(fraction, 4 * (exponent - 64) - 24)
    exact = np.where(words >> 31, -exact, exact)
    with np.errstate(over="ignore"):
        near = exact.astype(np.float32)
    if mode == "trunc":
        beyond = np.abs(near.astype(np.float64)) > np.abs(exact)
        near = np.where(beyond, np.nextafter(near, np.float32(0)), near)
    return np.clip(near, -FLT_MAX, FLT_MAX)


def float_to_ibm(values: np.ndarray) -> np.ndarray:
    """float32 to IBM hexadecimal words, truncating; infinities become the largest word and not-a-number zero."""
    v = np.nan_to_num(values.astype(np.float64), nan=0.0, posinf=7.2e75, neginf=-7.2e75)
    mantissa, power = np.frexp(np.abs(v))
    hexes = -(-power // 4)
    fraction = np.floor(np.ldexp(mantissa, power - 4 * hexes + 24)).astype(np.int64)
    word = ((hexes + 64).clip(0, 127).astype(np.int64) << 24) | fraction.clip(0, 0xFFFFFF)
    word = np.where(fraction == 0, 0, word) | (np.signbit(v).astype(np.int64) << 31)
    return word.astype(np.uint32)


def element_size(code: int) -> int:
    if code not in spec.FORMATS:
        raise ValueError(f"Unknown data format: {code}")
    return spec.FORMATS[code][1]


def decode_samples(raw: np.ndarray, code: int, mode: str = "round") -> np.ndarray:
    """Rows of raw bytes (n, nt * size) to float32 (n, nt)."""
    element_size(code)
    values = np.ascontiguousarray(raw).view(spec.FORMATS[code][0])
    return ibm_to_float(values, mode) if code == 1 else values.astype(np.float32)


def encode_samples(values: np.ndarray, code: int) -> np.ndarray:
    """float32 (n, nt) to rows of raw bytes; integers are truncated and clamped."""
    element_size(code)
    kind = spec.FORMATS[code][0]
    if code == 1:
        out = float_to_ibm(values).astype(">u4")
    elif code == 5:
        out = values.astype(">f4")
    else:
        limits = np.iinfo(kind)
        out = np.clip(np.trunc(np.nan_to_num(values.astype(np.float64))), limits.min, limits.max).astype(kind)
    return np.ascontiguousarray(out).view(np.uint8).reshape(len(values), -1)


def field(headers: np.ndarray, loc: int, code: int) -> np.ndarray:
    """Values of one field from header bytes (n, size); opaque codes give zeros."""
    if code == 6 or code > 9:
        return np.zeros(len(headers), dtype=np.int64)
    kind = np.dtype(spec.NUMPY[code])
    if loc < 1 or loc - 1 + kind.itemsize > headers.shape[1]:
        raise ValueError(f"location {loc} is outside the header")
    return np.ascontiguousarray(headers[:, loc - 1 : loc - 1 + kind.itemsize]).view(kind)[:, 0]


def put_field(headers: np.ndarray, loc: int, code: int, values) -> None:
    """Write values into header bytes in place; integers keep their low bits."""
    kind = np.dtype(spec.NUMPY[code])
    values = np.atleast_1d(np.asarray(values))  # numpy scalars have no byte order
    if kind.kind in "iu":
        values = (np.trunc(values).astype(np.int64) & ((1 << (8 * kind.itemsize)) - 1 if kind.itemsize < 8 else -1)).astype(f">u{kind.itemsize}" if kind.itemsize < 8 else kind)
    else:
        values = values.astype(kind)
    headers[:, loc - 1 : loc - 1 + kind.itemsize] = np.ascontiguousarray(np.broadcast_to(values, len(headers))).view(np.uint8).reshape(len(headers), -1)


def decode_text(raw: bytes, coding: str | None = None) -> list[str]:
    """The 40 lines of a textual header; coding 'e' (EBCDIC), 'a' (ASCII) or 'u'/None to detect."""
    if coding not in (None, "u", "e", "a"):
        raise ValueError("coding must be one of 'u', 'e', 'a'")
    ebcdic = is_ebcdic(raw) if coding in (None, "u") else coding == "e"
    text = "".join(spec.EBCDIC.get(b, " ") for b in raw) if ebcdic else raw.decode("latin-1")
    return [text[i : i + spec.COLUMNS] for i in range(0, spec.TEXT_BYTES, spec.COLUMNS)]


def encode_text(lines: list[str]) -> bytes:
    """Textual header in EBCDIC: rows padded or cut to 80 characters; unknown characters become spaces."""
    rows = [line[: spec.COLUMNS].ljust(spec.COLUMNS) for line in lines[: spec.ROWS]]
    rows += [" " * spec.COLUMNS] * (spec.ROWS - len(rows))
    return bytes(spec.TO_EBCDIC.get(c, 64) for c in "".join(rows))


def is_ebcdic(raw: bytes) -> bool:
    """ASCII only if strictly more bytes are letters or digits when read so."""
    alike = lambda c: c.isascii() and c.isalnum()
    return not sum(alike(chr(b)) for b in raw) > sum(alike(spec.EBCDIC.get(b, " ")) for b in raw)


def header_lines(values: dict[int, tuple[str, object]], table: tuple[spec.Field, ...], offset: int = 0) -> list[str]:
    """``Bytes a - b: value -- description`` for each field of a decoded header."""
    size = {f.loc: f.size for f in table}
    return [f"Bytes {loc + offset} - {loc + offset + size[loc] - 1}: {value} -- {text}" for loc, (text, value) in sorted(values.items())]


def header_dict(raw: bytes, table: tuple[spec.Field, ...]) -> dict[int, tuple[str, object]]:
    """loc -> (description, value) of one header; opaque fields are left out."""
    row = np.frombuffer(raw, dtype=np.uint8)[None]
    out = {}
    for f in table:
        if not f.opaque:
            kind = np.dtype(f.numpy)
            out[f.loc] = (f.description, np.ascontiguousarray(row[:, f.loc - 1 : f.loc - 1 + kind.itemsize]).view(kind)[0, 0].item())
    return out


def swapped(raw: bytes, table: tuple[spec.Field, ...]) -> bytes:
    """One header with every numeric field in this machine's byte order."""
    out = bytearray(raw)
    for f in table:
        if not f.opaque:
            kind = np.dtype(f.numpy)
            at = f.loc - 1
            out[at : at + kind.itemsize] = np.frombuffer(raw[at : at + kind.itemsize], dtype=kind).astype(kind.newbyteorder("=")).tobytes()
    return bytes(out)
