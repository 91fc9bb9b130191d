"""Codecs as column expressions, for byte columns that are already in a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import spec


def unsigned(raw: Column, loc: int, size: int) -> Column:
    """Big-endian unsigned integer at a 1-based location."""
    return F.conv(F.hex(F.substring(raw, loc, size)), 16, 10).cast("decimal(20,0)").cast("long")


def signed(raw: Column, loc: int, size: int) -> Column:
    """Big-endian two's complement integer of 1, 2 or 4 bytes."""
    shift = 64 - 8 * size
    return F.shiftright(F.shiftleft(unsigned(raw, loc, size), shift), shift)


def ibm_float(word: Column) -> Column:
    """An IBM hexadecimal word (as an unsigned long) as float, rounded to nearest."""
    sign = F.when(F.shiftright(word, 31).bitwiseAND(1) == 1, -1.0).otherwise(1.0)
    exponent = F.shiftright(word, 24).bitwiseAND(0x7F)
    return (sign * word.bitwiseAND(0xFFFFFF) * F.pow(F.lit(2.0), 4 * (exponent - 64) - 24)).cast("float")


def header_field(raw: Column, loc: int) -> Column:
    """A trace header's integer field from its raw bytes."""
    field = spec.TRACE_AT[loc]
    return signed(raw, loc, field.size).cast(field.spark)


def ebcdic_text(raw: Column) -> Column:
    """EBCDIC bytes as text; codes without a character become spaces."""
    codes = [chr(c) for c in range(1, 256)]
    return F.translate(F.decode(raw, "iso-8859-1"), "".join(codes), "".join(spec.EBCDIC.get(ord(c), " ") for c in codes))


def sorting_label(code: Column) -> Column:
    """Label of a trace sorting code; unknown codes count as 0."""
    labels = F.create_map(*[F.lit(x) for pair in spec.SORTINGS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, code), F.lit(spec.SORTINGS[0]))


def coordinate_scale(scalar: Column) -> Column:
    """The factor that a coordinate scalar means: 0 none, negative a divisor."""
    return F.when(scalar == 0, 1.0).when(scalar > 0, scalar.cast("double")).otherwise(-1.0 / scalar)
