from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seisframe import codec, spec


def test_ibm_words():
    words = np.array([0x42640000, 0xC276A000, 0x41100000, 0, 0x80000000, 0x7FFFFFFF, 0x41000001], dtype=np.uint32)
    got = codec.ibm_to_float(words)
    assert got[:3].tolist() == [100.0, -118.625, 1.0]
    assert got[3] == 0 and np.signbit(got[4]) and got[5] == np.finfo(np.float32).max
    assert got[6] == np.float32(2.0**-20)  # unnormalised


def test_ibm_rounding_modes():
    word = np.array([0x41100001, 0x40FFFFFF, 0xC0FFFFFF], dtype=np.uint32)
    exact = [1 + 2.0**-20, 1 - 2.0**-24, -(1 - 2.0**-24)]
    assert codec.ibm_to_float(word).tolist() == [np.float32(x) for x in exact]
    assert (np.abs(codec.ibm_to_float(word, "trunc").astype(float)) <= np.abs(exact)).all()


@settings(max_examples=200, deadline=None)
@given(st.floats(width=32, allow_nan=False, allow_infinity=False, min_value=-(2.0**99), max_value=2.0**99))
def test_ibm_round_trip_is_close(value):
    got = float(codec.ibm_to_float(codec.float_to_ibm(np.array([value], dtype=np.float32)))[0])
    assert abs(got - value) <= max(abs(value) * 2.0**-20, 1e-37)
    assert abs(got) <= abs(value) or value == 0


@pytest.mark.parametrize(("code", "limit"), [(2, 2**31), (3, 2**15), (8, 2**7)])
def test_integers_are_truncated_and_clamped(code, limit):
    values = np.array([[1.9, -1.9, 1e12, -1e12]], dtype=np.float32)
    got = codec.decode_samples(codec.encode_samples(values, code), code)
    assert got[0, :2].tolist() == [1.0, -1.0]
    assert got[0, 2:].tolist() == [np.float32(limit - 1), -np.float32(limit)]


def test_unsupported_formats_raise():
    for code in (4, 6, 7, 9, 12, 15, 99):
        with pytest.raises(ValueError, match="Unknown data format"):
            codec.element_size(code)


def test_field_tables_cover_the_headers():
    for table, size in ((spec.BINARY, 400), (spec.TRACE, 240)):
        at = 1
        for f in table:
            assert f.loc == at
            at += f.size
        assert at == size + 1
    assert len({f.name for f in spec.TRACE}) == len(spec.TRACE)


def test_fields_are_put_and_read():
    heads = np.zeros((3, 240), dtype=np.uint8)
    codec.put_field(heads, 189, 4, [1, -2, 70000])
    codec.put_field(heads, 71, 2, -100)
    assert codec.field(heads, 189, 4).tolist() == [1, -2, 70000] and codec.field(heads, 71, 2).tolist() == [-100] * 3
    assert codec.field(heads, 219, 6).tolist() == [0, 0, 0]
    with pytest.raises(ValueError, match="outside"):
        codec.field(heads, 239, 4)


def test_text_codings():
    lines = [f"C{k:02d} Area {k}: x|y" for k in range(1, 41)]
    raw = codec.encode_text(lines)
    assert codec.is_ebcdic(raw) and raw[:3] == b"\xc3\xf0\xf1" and raw[raw.index(79)] == 79
    assert [s.rstrip() for s in codec.decode_text(raw)] == lines
    plain = "".join(s.ljust(80) for s in lines).encode()
    assert not codec.is_ebcdic(plain) and codec.decode_text(plain)[4].rstrip() == lines[4]
    with pytest.raises(ValueError, match="coding"):
        codec.decode_text(raw, "x")
    assert codec.encode_text(["é" * 100])[:80] == b"\x40" * 80
