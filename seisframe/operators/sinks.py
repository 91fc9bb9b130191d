"""Writing SEG-Y files and raw volumes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import codec, spec
from ..sources import files, segy
from . import headers as hd
from .geometry import Geometry
from .volume import densify, indexed, range_filter

#: So many (trace number, rank) pairs are broadcast at most: 16 MB.
BROADCAST = 1_000_000


def _write(rows: DataFrame, path: str, preamble: bytes, nt: int, code: int, count: int) -> None:
    segy.register(rows.sparkSession)
    out = rows.select("trace_idx", "raw_header", "samples").write.format("segy").mode("overwrite")
    for k, v in {"nt": nt, "format": code, "trace_count": count, "preamble": preamble.hex(), "path": path}.items():
        out = out.option(k, str(v))
    out.save()


def create(volume: DataFrame, path: str, survey: hd.NewSurvey, custom: list[str] | None = None, trace_count: int | None = None) -> None:
    """A new file from (iline_idx, xline_idx, samples) rows, one for every cell, or for the first ``trace_count`` cells if the last inline is short."""
    if trace_count is not None and not (survey.ni - 1) * survey.nx < trace_count <= survey.ni * survey.nx:
        raise ValueError("only the last inline may be short")
    s = survey
    step = max(s.scalar, 1) if s.scalar > 0 else 1
    lines = hd.textual_lines(
        (s.min_iline, s.min_iline + s.ni - 1, 1), (s.min_xline, s.min_xline + s.nx - 1, 1), s.nt, (s.ni, s.nx), s.dt, s.format, (s.iline_interval * step, s.xline_interval * step), s.start_time, custom
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, x = b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy().astype(np.int64)
            heads = [h.tobytes() for h in hd.trace_headers(s, i, x)]
            yield pa.RecordBatch.from_arrays([pa.array(i * s.nx + x), pa.array(heads, type=pa.binary()), b.column(2)], names=["trace_idx", "raw_header", "samples"])

    rows = volume.select("iline_idx", "xline_idx", F.col("samples").cast("array<float>").alias("samples")).mapInArrow(run, "trace_idx bigint, raw_header binary, samples array<float>")
    _write(rows, path, codec.encode_text(lines) + hd.binary_header(s), s.nt, s.format, trace_count or s.ni * s.nx)


def renumbered(rows: DataFrame, chunk: int = 100_000) -> DataFrame:
    """trace_idx replaced by the rank among the rows, found chunk by chunk."""
    rows = rows.withColumn("__chunk", F.floor(F.col("trace_idx") / chunk))
    counts = rows.groupBy("__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a chunk
    rank = F.row_number().over(Window.partitionBy("__chunk").orderBy("trace_idx")) - 1
    ranks = rows.select("trace_idx", "__chunk").withColumn("__rank", rank).join(before.select("__chunk", "__before"), "__chunk")
    ranks = ranks.select("trace_idx", (F.col("__before") + F.col("__rank")).alias("__new"))
    return rows.drop("__chunk").join(ranks, "trace_idx").withColumn("trace_idx", F.col("__new")).drop("__new")


def _ranked(keys: DataFrame, spark: SparkSession) -> tuple[DataFrame, int]:
    """(trace_idx, rank) of the chosen traces and their number; few enough ranks are broadcast, so that samples stay where they are read."""
    ranks = renumbered(keys.select("trace_idx", F.col("trace_idx").alias("was"))).select(F.col("was").alias("trace_idx"), F.col("trace_idx").alias("rank"))
    count = keys.count()
    return (F.broadcast(ranks) if count <= BROADCAST else ranks), count


def _inside(rows: DataFrame, il: tuple[int, int], xl: tuple[int, int]) -> DataFrame:
    return rows.where(range_filter("iline_idx", il) & range_filter("xline_idx", xl))


def _repatched(rows: DataFrame, nt: int | None, shift: int) -> DataFrame:
    """Patch the sample count, and the start time by ``shift`` milliseconds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            heads = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint8).reshape(-1, spec.TRACE_BYTES)
            start = codec.field(heads, spec.START_TIME, 2).astype(np.int64) + shift
            new = hd.patched(heads, nt, start) if nt is not None else heads
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.tobytes() for h in new], type=pa.binary()), b.column(2)], names=["trace_idx", "raw_header", "samples"])

    return rows.select("trace_idx", "raw_header", "samples").mapInArrow(run, "trace_idx bigint, raw_header binary, samples array<float>")


def _preamble(donor: str, nt: int | None = None, lines: list[str] | None = None) -> bytes:
    raw = files.read_at(donor, 0, spec.PREAMBLE)
    head = np.frombuffer(raw[spec.TEXT_BYTES :], dtype=np.uint8)[None].copy()
    if nt is not None:
        codec.put_field(head, 21, 2, nt)
    return (codec.encode_text(lines) if lines else raw[: spec.TEXT_BYTES]) + head.tobytes()


def _lines(donor: files.FileInfo, geo: Geometry, il: tuple[int, int], xl: tuple[int, int], tm: tuple[int, int], custom: list[str] | None) -> list[str]:
    a, b = geo.axes[:2]
    first = np.frombuffer(files.read_at(donor.path, spec.PREAMBLE, spec.TRACE_BYTES), dtype=np.uint8)[None]
    start = int(codec.field(first, spec.START_TIME, 2)[0]) + tm[0] * donor.dt // 1000
    numbers = lambda axis, r: (axis.low + r[0] * axis.step, axis.low + (r[1] - 1) * axis.step, axis.step)
    return hd.textual_lines(numbers(a, il), numbers(b, xl), tm[1] - tm[0], (il[1] - il[0], xl[1] - xl[0]), donor.dt, donor.format, (0.0, 0.0), start, custom)


def cut(spark: SparkSession, path: str, out: str, geo: Geometry, il: tuple[int, int] | None = None, xl: tuple[int, int] | None = None, tm: tuple[int, int] | None = None, custom: list[str] | None = None, **options) -> int:
    """Copy the traces of half-open index ranges with their headers; returns how many. A time range patches sample count and start time."""
    info = files.open_info(path)
    il, xl, whole = il or (0, geo.shape[0]), xl or (0, geo.shape[1]), tm in (None, (0, info.nt))
    tm = tm or (0, info.nt)
    for (a, b), n in ((il, geo.shape[0]), (xl, geo.shape[1]), (tm, info.nt)):
        if not 0 <= a < b <= n:
            raise IndexError(f"range {a}..{b} is outside 0..{n}")
    keys = _inside(indexed(segy.load(spark, path, "keys", **options), geo), il, xl)
    ends = keys.agg(F.min("trace_idx").alias("a"), F.max("trace_idx").alias("b")).first()  # one row
    ranks, count = _ranked(keys, spark)
    rows = segy.load(spark, path, "traces", t0=tm[0], t1=tm[1], first=ends["a"] or 0, end=0 if ends["b"] is None else ends["b"] + 1, **options)
    rows = rows.select("trace_idx", "raw_header", "samples").join(ranks, "trace_idx").withColumn("trace_idx", F.col("rank"))
    nt = None if whole else tm[1] - tm[0]
    new = _repatched(rows, nt, tm[0] * info.dt // 1000)
    _write(new, out, _preamble(path, nt, _lines(info, geo, il, xl, tm, custom)), tm[1] - tm[0], info.format, count)
    return count


def share_header(spark: SparkSession, donor: str, out: str, volume: DataFrame, shape: tuple[int, int, int], geo: Geometry, offset: tuple[int, int, int] | None = None, custom: list[str] | None = None, **options) -> int:
    """A file with the donor's headers and new samples; only traces that the donor has are written. Returns how many.

    ``volume`` is (iline_idx, xline_idx, samples), its indexes counted from the offset.
    """
    info = files.open_info(donor)
    o = offset or (0, 0, 0)
    if offset is None and (shape[0], shape[1], shape[2]) != (*geo.shape[:2], info.nt):
        raise ValueError("the shape must be the donor's; give an offset for a part")
    if any(a < 0 or a + n > m for a, n, m in zip(o, shape, (*geo.shape[:2], info.nt), strict=True)):
        raise ValueError("the volume reaches beyond the donor")
    inside = (o[0], o[0] + shape[0]), (o[1], o[1] + shape[1])
    moved = volume.select((F.col("iline_idx") + o[0]).alias("iline_idx"), (F.col("xline_idx") + o[1]).alias("xline_idx"), F.col("samples").cast("array<float>").alias("samples"))
    keys = _inside(indexed(segy.load(spark, donor, "keys", **options).select("trace_idx", "iline", "xline"), geo), *inside)
    ranks, count = _ranked(keys.join(moved.select("iline_idx", "xline_idx"), ["iline_idx", "xline_idx"], "left_semi"), spark)
    heads = _inside(indexed(segy.load(spark, donor, "headers", **options).select("trace_idx", "iline", "xline", "raw_header"), geo), *inside)
    rows = heads.join(ranks, "trace_idx").join(moved, ["iline_idx", "xline_idx"]).select(F.col("rank").alias("trace_idx"), "raw_header", "samples")
    nt = shape[2] if shape[2] != info.nt else None
    lines = None if offset is None else _lines(info, geo, (o[0], o[0] + shape[0]), (o[1], o[1] + shape[1]), (o[2], o[2] + shape[2]), custom)
    _write(_repatched(rows, nt, o[2] * info.dt // 1000), out, _preamble(donor, nt, lines), shape[2], info.format, count)
    return count


def tofile(traces: DataFrame, path: str, nt: int, geo: Geometry | None = None, trace_count: int | None = None, fill: float = 0.0) -> None:
    """A headerless float32 volume: dense by the geometry, or without one the traces in file order."""
    spark = traces.sparkSession
    segy.register(spark)
    if geo is None:
        rows, ni, nx = traces.select(F.col("trace_idx").cast("int").alias("iline_idx"), F.lit(0).alias("xline_idx"), "samples"), trace_count or traces.count(), 1
    else:
        (ni, nx), rows = geo.shape[:2], densify(traces, geo, nt, fill)
    out = rows.select("iline_idx", "xline_idx", "samples").write.format("rawvol").mode("overwrite")
    for k, v in {"ni": ni, "nx": nx, "nt": nt, "path": path}.items():
        out = out.option(k, str(v))
    out.save()


def write_traces(rows: DataFrame, path: str, nt: int, trace_count: int, dt: int = 2000, code: int = 5, sorting: int = 4, lines: list[str] | None = None, start_time: int = 0, scalar: int = 1) -> None:
    """A file of any traces: (trace_idx, iline, xline, offset, x_coord, y_coord, samples), numbered from 0 without gaps."""
    head = np.frombuffer(hd.binary_header(hd.NewSurvey(1, max(1, trace_count), nt, dt, code, start_time)), dtype=np.uint8)[None].copy()
    codec.put_field(head, 29, 2, sorting)
    text = codec.encode_text(lines or [f"C{k:02d}" for k in range(1, spec.ROWS + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy().astype(np.int64) for i in range(6)]
            heads = hd.trace_headers(hd.NewSurvey(1, 1, nt, dt, code, start_time), cols[0] * 0, cols[0] * 0)
            codec.put_field(heads, spec.SCALAR, 2, scalar)
            for locs, values in (((5, 9, 189), cols[1]), ((17, 21, 193), cols[2]), ((37,), cols[3]), ((73, 181), cols[4]), ((77, 185), cols[5])):
                for loc in locs:
                    codec.put_field(heads, loc, 4, values)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.tobytes() for h in heads], type=pa.binary()), b.column(6)], names=["trace_idx", "raw_header", "samples"])

    made = rows.select(F.col("trace_idx").cast("long"), *(F.col(c).cast("int") for c in ("iline", "xline", "offset", "x_coord", "y_coord")), F.col("samples").cast("array<float>"))
    _write(made.mapInArrow(run, "trace_idx bigint, raw_header binary, samples array<float>"), path, text + head.tobytes(), nt, code, trace_count)
