"""Headers: building, reading, reporting and patching them in place."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .. import codec, spec
from ..sources import files, segy


@dataclass(frozen=True)
class NewSurvey:
    """What a file made from scratch states; inline and crossline numbers count up by one."""

    ni: int
    nx: int
    nt: int
    dt: int = 2000
    format: int = 5
    start_time: int = 0
    iline_interval: float = 25.0
    xline_interval: float = 25.0
    min_iline: int = 1
    min_xline: int = 1
    scalar: int = -100

    def __post_init__(self):
        if min(self.ni, self.nx, self.nt, self.dt, self.min_iline, self.min_xline) <= 0 or min(self.iline_interval, self.xline_interval) <= 0:
            raise ValueError("sizes, intervals and first lines must be positive")
        if self.start_time < 0 or self.format not in (1, 2, 3, 5, 8):
            raise ValueError("the start time can't be negative; formats are 1, 2, 3, 5 and 8")


def field_range(loc: int, size: int = 2) -> str:
    return f"{loc}-{loc + size - 1}"


def textual_lines(il: tuple[int, int, int], xl: tuple[int, int, int], nt: int, shape: tuple[int, int], dt: int, code: int, intervals: tuple[float, float], start_time: int, custom: list[str] | None = None, locations: tuple[int, int, int, int] = (189, 193, 73, 77)) -> list[str]:
    """The 40 rows: up to 12 of the caller's, then what the file holds and where. il and xl are (first, last, step)."""
    top = [str(c) for c in (custom or ["Written by seisframe", "Three-dimensional seismic volume"])][:12]
    rows = top + [""] * (12 - len(top))
    rows += [
        f"Inlines {il[0]} to {il[1]}, every {il[2]}",
        f"Crosslines {xl[0]} to {xl[1]}, every {xl[2]}",
        f"Grid: {shape[0]} inlines x {shape[1]} crosslines x {nt} samples",
        f"Samples are {spec.FORMAT_LABELS.get(code, 'of an unknown format')}, {dt} microseconds apart",
        f"The first sample is at {start_time} milliseconds",
        f"Spacing on the map: inlines {intervals[0]:.6g} m, crosslines {intervals[1]:.6g} m",
        "",
        f"Binary header: interval {field_range(17)}, samples {field_range(21)}, format {field_range(25)}",
        *(f"Trace header: {name} in bytes {field_range(loc, 4)}" for name, loc in zip(("inline", "crossline", "x", "y"), locations)),
        f"Trace header: start time {field_range(spec.START_TIME)}, samples {field_range(spec.SAMPLE_COUNT)}, interval {field_range(spec.SAMPLE_INTERVAL)}",
    ]
    rows += [""] * (spec.ROWS - len(rows))
    return [f"C{k:02d} {row[:76]:<76}" for k, row in enumerate(rows, 1)]


def binary_header(s: NewSurvey) -> bytes:
    # What a new file's binary header holds by location
    values = {1: 1, 5: s.min_iline, 13: s.min_xline, 17: s.dt, 21: s.nt, 25: s.format, 27: 1, 29: 4, 55: 1, 303: 1}
    row = np.zeros((1, spec.BINARY_BYTES), dtype=np.uint8)
    for loc, v in values.items():
        codec.put_field(row, loc, spec.BINARY_AT[loc].code, v)
    return row.tobytes()


def trace_headers(s: NewSurvey, iline_idx: np.ndarray, xline_idx: np.ndarray) -> np.ndarray:
    """Header bytes (n, 240) of a new file's traces."""
    rows = np.zeros((len(iline_idx), spec.TRACE_BYTES), dtype=np.uint8)
    # What every trace header of a new file holds by location
    constant = {1: 1, 13: 1, 25: 1, 29: 1, 35: 1, 69: 1, 71: s.scalar, 89: 1, 105: s.start_time, 109: s.start_time, 115: s.nt, 117: s.dt, 125: 1, 133: 1, 139: 1}
    for loc, v in constant.items():
        codec.put_field(rows, loc, spec.TRACE_AT[loc].code, v)
    il, xl = iline_idx + s.min_iline, xline_idx + s.min_xline
    x = np.trunc(xline_idx * (s.xline_interval * -s.scalar) + 5200)
    y = np.trunc(iline_idx * (s.iline_interval * -s.scalar) + 5200)
    for locs, values in (((5, 9, 189), il), ((17, 21, 193), xl), ((73, 181), x), ((77, 185), y)):
        for loc in locs:
            codec.put_field(rows, loc, 4, values)
    return rows


def patched(headers: np.ndarray, nt: int | None = None, start_time: np.ndarray | int | None = None) -> np.ndarray:
    """Copies of trace headers with another sample count and, if positive, start time."""
    out = headers.copy()
    if nt is not None:
        codec.put_field(out, spec.SAMPLE_COUNT, 2, nt)
    if start_time is not None:
        for loc in (spec.START_TIME, 109):
            old = codec.field(out, loc, 2)
            codec.put_field(out, loc, 2, np.where(np.asarray(start_time) > 0, start_time, old))
    return out


def read_header(path: str, kind: str = "bh", n: int = 0):
    """kind 'bh': the binary header; 'th': trace n's header; 't': (header, samples). Headers are {loc: (description, value)}."""
    info = files.open_info(path)
    if kind == "bh":
        return codec.header_dict(files.read_at(path, spec.TEXT_BYTES, spec.BINARY_BYTES), spec.BINARY)
    if not 0 <= n < info.trace_count:
        raise IndexError("trace number out of range")
    raw = files.read_at(path, spec.PREAMBLE + n * info.record, info.record)
    head = codec.header_dict(raw[: spec.TRACE_BYTES], spec.TRACE)
    if kind == "th":
        return head
    if kind == "t":
        return head, codec.decode_samples(np.frombuffer(raw[spec.TRACE_BYTES :], dtype=np.uint8)[None], info.format)[0]
    raise ValueError("kind must be 'bh', 'th' or 't'")


def textual_header(path: str, coding: str | None = None) -> list[str]:
    return codec.decode_text(files.read_at(path, 0, spec.TEXT_BYTES), coding)


def _code(table: dict[int, spec.Field], loc: int, force: bool, kind: str | None) -> int:
    if force:
        if kind not in spec.FORCED:
            raise ValueError(f"type must be one of {', '.join(spec.FORCED)}")
        return spec.FORCED[kind]
    if loc not in table:
        raise ValueError(f"location {loc} is no field; use force and a type")
    if table[loc].opaque:
        raise ValueError(f"location {loc} holds bytes that have no type")
    return table[loc].code


def modify_bin_key(path: str, loc: int, value: float, force: bool = False, kind: str | None = None) -> None:
    """Patch one field of the binary header in the file."""
    row = np.zeros((1, spec.BINARY_BYTES), dtype=np.uint8)
    code = _code(spec.BINARY_AT, loc, force, kind)
    codec.put_field(row, loc, code, value)
    size = np.dtype(spec.NUMPY[code]).itemsize
    with open(files.local_path(path), "r+b") as f:
        f.seek(spec.TEXT_BYTES + loc - 1)
        f.write(row[0, loc - 1 : loc - 1 + size].tobytes())


def modify_trace_key(spark: SparkSession, path: str, loc: int, value: float, idx: int = -1, force: bool = False, kind: str | None = None, part: int = 100_000) -> int:
    """Patch one field of trace idx, or of all traces if idx < 0; tasks patch disjoint ranges. Returns the traces patched."""
    info, code = files.open_info(path), _code(spec.TRACE_AT, loc, force, kind)
    if idx >= info.trace_count:
        raise IndexError("trace number out of range")
    row = np.zeros((1, spec.TRACE_BYTES), dtype=np.uint8)
    codec.put_field(row, loc, code, value)
    data = row[0, loc - 1 : loc - 1 + np.dtype(spec.NUMPY[code]).itemsize].tobytes()
    local, record = files.local_path(path), info.record
    first, end = (0, info.trace_count) if idx < 0 else (idx, idx + 1)

    def run(batches):
        import os

        import pyarrow as pa

        fd = os.open(local, os.O_WRONLY)
        try:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    os.pwrite(fd, data, spec.PREAMBLE + i * record + loc - 1)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])
        finally:
            os.close(fd)

    rows = spark.range(first, end, 1, max(1, math.ceil((end - first) / part)))
    return sum(r["n"] for r in rows.mapInArrow(run, "n bigint").collect())  # one number a batch


def meta_info(keys: DataFrame, path: str, istep: int | None = None, xstep: int | None = None) -> dict:
    """Sizes, ranges, intervals and sampling of a 3-D file, as the reports show them; keys comes from mode 'keys'."""
    from . import geometry as g

    info = files.open_info(path)
    geo = g.scan(keys, steps=(istep, xstep))
    il, xl = geo.axes
    gaps = g.intervals(g.line_index(keys, il.step), keys.select("trace_idx", "x_coord", "y_coord"), il.step, xl.step).first()
    first = np.frombuffer(files.read_at(path, spec.PREAMBLE, spec.TRACE_BYTES), dtype=np.uint8)[None]
    scalar = int(codec.field(first, spec.SCALAR, 2)[0])
    scale = 1.0 if scalar == 0 else scalar if scalar > 0 else -1 / scalar
    return {
        "nt": info.nt, "nx": xl.size, "ni": il.size, "trace_count": info.trace_count, "dt": info.dt, "dtype": spec.DTYPE_LABELS.get(info.format, "unknown"),
        "scalar": scale, "i_interval": gaps and gaps["i_interval"], "x_interval": gaps and gaps["x_interval"], "start_time": int(codec.field(first, spec.START_TIME, 2)[0]),
        "min_iline": il.low, "max_iline": il.high, "min_xline": xl.low, "max_xline": xl.high, "isnormal": geo.regular, "istep": il.step, "xstep": xl.step,
        "sorting": spec.SORTINGS[info.sorting], "stack": spec.stack_class(info.sorting),
    }


def report(meta: dict) -> str:
    """The summary as text."""
    width = max(map(len, meta))
    return "\n".join(f"{k:<{width}} : {v:.6g}" if isinstance(v, float) else f"{k:<{width}} : {v}" for k, v in meta.items())


def load_headers(spark: SparkSession, path: str, **options) -> DataFrame:
    return segy.load(spark, path, "headers", **options)
