"""Functions over files, for users who think in arrays: numpy in and out, Spark in between."""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codec, spec
from .operators import geometry as g
from .operators import headers as hd
from .operators import sinks
from .operators import volume as vol
from .operators.headers import NewSurvey, meta_info, modify_bin_key, modify_trace_key, read_header, report, textual_header
from .sources import files, segy
from .survey import Survey, guess

__all__ = [
    "MetaInfo", "NewSurvey", "Survey", "binary_header", "collect", "convert_trace", "create", "create_by_sharing_header", "create_by_sharing_header_guess", "fromfile", "fromfile_by_guess",
    "fromfile_ignore_header", "fromfile_without_scan", "get_metaInfo", "get_trace_keys", "get_trace_keys2", "guess", "load_prestack3D", "load_unsorted3D", "meta_info", "modify_bin_key",
    "modify_trace_key", "read_header", "report", "scan_4D", "scan_prestack", "scan_unsorted3D", "textual_header", "tofile", "tofile_by_guess", "tofile_ignore_header", "trace_count",
    "trace_header", "trace_range", "trace_record",
]


def _array(volume: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    index = list(vol.INDEX[: len(shape) - 1])
    rows = volume.orderBy(*index).toPandas()
    return np.stack(rows["samples"].to_list()).astype(np.float32).reshape(shape)


def _frame(spark: SparkSession, data: np.ndarray) -> DataFrame:
    import pyarrow as pa

    ni, nx, nt = data.shape
    i, x = np.divmod(np.arange(ni * nx), nx)
    samples = pa.ListArray.from_arrays(pa.array(np.arange(ni * nx + 1, dtype=np.int32) * nt), pa.array(np.ascontiguousarray(data, dtype=np.float32).ravel()))
    return spark.createDataFrame(pa.table({"iline_idx": i.astype(np.int32), "xline_idx": x.astype(np.int32), "samples": samples}))


def fromfile(spark: SparkSession, path: str, iline: int = 189, xline: int = 193, istep: int | None = 1, xstep: int | None = 1, fill: float = 0.0) -> np.ndarray:
    """The dense volume (ni, nx, nt)."""
    own = Survey(spark, path, iline, xline, istep, xstep, fill=fill)
    return _array(own.volume, own.shape)


def fromfile_by_guess(spark: SparkSession, path: str) -> np.ndarray:
    il, xl, istep, xstep, *_ = guess(path, spark, most=1)[0]
    return fromfile(spark, path, il, xl, istep, xstep)


def fromfile_without_scan(spark: SparkSession, path: str, ni: int, nx: int, il_min: int, xl_min: int, iline: int = 189, xline: int = 193, istep: int = 1, xstep: int = 1) -> np.ndarray:
    """The volume of a geometry that the caller knows; traces off it raise."""
    geo = g.Geometry((g.Axis(il_min, il_min + (ni - 1) * istep, istep), g.Axis(xl_min, xl_min + (nx - 1) * xstep, xstep)), 0, False)
    nt = files.open_info(path).nt
    return _array(vol.densify(segy.load(spark, path, iline=iline, xline=xline), geo, nt, strict=True), (ni, nx, nt))


def trace_range(spark: SparkSession, path: str, beg: int = -1, end: int = 0, tbeg: int = -1, tend: int = 0) -> DataFrame:
    """A range of traces and of samples as a DataFrame; nothing else is read."""
    info = files.open_info(path)
    (a, b), (t0, t1) = vol.bounds(beg, end, info.trace_count), vol.bounds(tbeg, tend, info.nt)
    return segy.load(spark, path, first=a, end=b, t0=t0, t1=t1)


def collect(spark: SparkSession, path: str, beg: int = -1, end: int = 0, tbeg: int = -1, tend: int = 0) -> np.ndarray:
    rows = trace_range(spark, path, beg, end, tbeg, tend)
    return np.stack(rows.orderBy("trace_idx").toPandas()["samples"].to_list())


def set_size(path: str, nt: int, nx: int, ni: int, short: bool = False) -> g.Geometry:
    """The geometry of a file that is taken as ni x nx traces in file order, whatever its headers say; the last of the ni may be ``short``."""
    info = files.open_info(path)
    fits = (ni - 1) * nx < info.trace_count <= ni * nx if short else nx * ni == info.trace_count
    if nt != info.nt or not fits:
        raise ValueError(f"{ni} x {nx} traces of {nt} samples aren't the file's {info.trace_count} of {info.nt}")
    whole = nx * ni == info.trace_count
    return g.Geometry((g.Axis(0, ni - 1, 1), g.Axis(0, nx - 1, 1)), info.trace_count, whole, whole)


def volume_ignore_header(spark: SparkSession, path: str, ni: int, nx: int, nt: int, short: bool = False) -> DataFrame:
    """(iline_idx, xline_idx, samples) with cells numbered by the traces' places in the file; the last row of cells may be ``short``."""
    set_size(path, nt, nx, ni, short)
    at = F.col("trace_idx")
    return segy.load(spark, path).select(F.floor(at / nx).cast("int").alias("iline_idx"), (at % nx).cast("int").alias("xline_idx"), "samples")


def fromfile_ignore_header(spark: SparkSession, path: str, ni: int, nx: int, nt: int, format: int = 5) -> np.ndarray:
    """The volume (ni, nx, nt) in file order; ``format`` is the file's own, whatever is given."""
    return _array(volume_ignore_header(spark, path, ni, nx, nt), (ni, nx, nt))


def tofile_ignore_header(spark: SparkSession, path: str, out: str, nt: int, nx: int, ni: int, format: int = 5) -> None:
    """A raw volume of all traces in file order; ``format`` is the file's own, whatever is given."""
    set_size(path, nt, nx, ni)
    sinks.tofile(segy.load(spark, path), out, nt, None, ni * nx)


def get_trace_keys(spark: SparkSession, path: str, keyloc, beg: int = -1, end: int = 0, force: int | None = None) -> np.ndarray:
    """Values of one or more header locations, in file order; opaque locations give zeros."""
    locs = [keyloc] if np.isscalar(keyloc) else list(keyloc)
    n = files.open_info(path).trace_count
    a, b = vol.bounds(beg, end, n)
    option = ",".join(f"key{k}:{loc}" + (f":{force}" if force else "") for k, loc in enumerate(locs))
    rows = segy.load(spark, path, "keys", keys=option, first=a, end=b).orderBy("trace_idx").toPandas()
    return np.squeeze(rows[[f"key{k}" for k in range(len(locs))]].to_numpy())


#: The same; both names are known to users.
get_trace_keys2 = get_trace_keys


def scan_unsorted3D(spark: SparkSession, path: str, iline: int, xline: int) -> dict:
    return g.scan(segy.load(spark, path, "keys", iline=iline, xline=xline)).as_dict()


def load_unsorted3D(spark: SparkSession, path: str, iline: int, xline: int, fill: float = 0.0) -> np.ndarray:
    return fromfile(spark, path, iline, xline, None, None, fill)


def scan_prestack(spark: SparkSession, path: str, iline: int, xline: int, offset: int = 37) -> dict:
    return g.scan_prestack(segy.load(spark, path, "keys", iline=iline, xline=xline, offset=offset)).as_dict()


def load_prestack3D(spark: SparkSession, path: str, iline: int, xline: int, offset: int = 37, fill: float = 0.0) -> np.ndarray:
    """The dense gathers (ni, nx, no, nt)."""
    geo = g.scan(segy.load(spark, path, "keys", iline=iline, xline=xline, offset=offset), ("iline", "xline", "offset"))
    nt = files.open_info(path).nt
    return _array(vol.densify(segy.load(spark, path, iline=iline, xline=xline, offset=offset), geo, nt, fill), (*geo.shape, nt))


def tofile(spark: SparkSession, path: str, out: str, iline: int = 189, xline: int = 193, istep: int | None = 1, xstep: int | None = 1, as_2d: bool = False) -> None:
    Survey(spark, path, iline, xline, istep, xstep, as_2d=as_2d).tofile(out)


def tofile_by_guess(spark: SparkSession, path: str, out: str) -> None:
    il, xl, istep, xstep, *_ = guess(path, spark, most=1)[0]
    tofile(spark, path, out, il, xl, istep, xstep)


def _source(spark: SparkSession, data: np.ndarray | str, shape: tuple[int, int, int]) -> DataFrame:
    if isinstance(data, str):
        segy.register(spark)
        return spark.read.format("rawvol").options(ni=shape[0], nx=shape[1], nt=shape[2]).load(data)
    return _frame(spark, data)


def create(spark: SparkSession, out: str, data: np.ndarray | str, shape: tuple[int, int, int] | None = None, custom: list[str] | None = None, **facts) -> None:
    """A new file from an array or a raw volume; facts are those of NewSurvey."""
    shape = shape or np.shape(data)
    sinks.create(_source(spark, data, shape), out, NewSurvey(*shape, **facts), custom)


def create_by_sharing_header(spark: SparkSession, out: str, donor: str, data: np.ndarray | str, shape: tuple[int, int, int] | None = None, iline: int = 189, xline: int = 193, istep: int | None = 1, xstep: int | None = 1, offset=None, custom: list[str] | None = None) -> int:
    """The donor's headers with new samples; offset is (iline, xline, time) indexes or a dict of them."""
    shape = shape or np.shape(data)
    if isinstance(offset, dict):
        offset = (offset["iline"], offset["xline"], offset["time"])
    geo = g.scan(segy.load(spark, donor, "keys", iline=iline, xline=xline), steps=(istep, xstep))
    return sinks.share_header(spark, donor, out, _source(spark, data, shape), shape, geo, offset, custom, iline=iline, xline=xline)


def create_by_sharing_header_guess(spark: SparkSession, out: str, donor: str, data: np.ndarray | str, shape: tuple[int, int, int] | None = None, offset=None, custom: list[str] | None = None) -> int:
    """``create_by_sharing_header`` with the first guessed key locations that fit."""
    if isinstance(data, str) and shape is None:
        raise ValueError("a raw volume needs its shape")
    failed: Exception | None = None
    for il, xl, istep, xstep, *_ in guess(donor, spark):
        try:
            return create_by_sharing_header(spark, out, donor, data, shape, il, xl, istep, xstep, offset, custom)
        except ValueError as e:  # the shape doesn't fit this geometry
            failed = e
    raise ValueError("no guessed key locations fit; give them") from failed


def scan_4D(*_args, **_options) -> None:
    raise NotImplementedError("use scan_prestack")


def _record(path: str, n: int, first: int, size: int) -> bytes:
    info = files.open_info(path)
    if not 0 <= n < info.trace_count:
        raise IndexError(f"trace {n} is outside 0..{info.trace_count}")
    return files.read_at(path, spec.PREAMBLE + n * info.record + first, size)


def binary_header(path: str, raw: bool = False) -> bytes:
    """The 400 bytes of the binary header, integers in this machine's byte order unless raw."""
    data = files.read_at(path, spec.TEXT_BYTES, spec.BINARY_BYTES)
    return data if raw else codec.swapped(data, spec.BINARY)


def trace_header(path: str, n: int, raw: bool = False) -> bytes:
    """The 240 bytes of trace n's header, integers in this machine's byte order unless raw."""
    data = _record(path, n, 0, spec.TRACE_BYTES)
    return data if raw else codec.swapped(data, spec.TRACE)


def trace_record(path: str, n: int, raw: bool = False) -> bytes:
    """Header and samples of trace n; unless raw, as ``trace_header`` and float32 in this machine's byte order."""
    info = files.open_info(path)
    if raw:
        return _record(path, n, 0, info.record)
    samples = _record(path, n, spec.TRACE_BYTES, info.record - spec.TRACE_BYTES)
    return trace_header(path, n) + convert_trace(samples, info.format).tobytes()


def convert_trace(data: bytes | np.ndarray, format: int = 1) -> np.ndarray:
    """float32 samples from the bytes of a trace."""
    return codec.decode_samples(np.frombuffer(bytes(data), dtype=np.uint8)[None], format)[0]


@dataclass
class MetaInfo:
    """A file's sizes, ranges, intervals and sampling; fields may be changed."""

    nt: int
    nx: int
    ni: int
    trace_count: int
    dt: int
    dtype: str
    scalar: float
    i_interval: float | None
    x_interval: float | None
    start_time: int
    min_iline: int
    max_iline: int
    min_xline: int
    max_xline: int
    isnormal: bool
    istep: int
    xstep: int
    sorting: str
    stack: str

    def as_dict(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def get_metaInfo(spark: SparkSession, path: str, iline: int = 189, xline: int = 193, istep: int | None = None, xstep: int | None = None, xloc: int = 73, yloc: int = 77, scaled: bool = True) -> MetaInfo:
    """What ``meta_info`` reports, intervals in metres (times the coordinate scalar) if ``scaled``."""
    meta = MetaInfo(**meta_info(segy.load(spark, path, "keys", iline=iline, xline=xline, xloc=xloc, yloc=yloc), path, istep, xstep))
    if scaled and meta.i_interval is not None:
        meta.i_interval, meta.x_interval = meta.i_interval * meta.scalar, meta.x_interval * meta.scalar
    return meta


def trace_count(path: str) -> int:
    return files.open_info(path).trace_count


def format_label(path: str) -> str:
    return spec.FORMAT_LABELS[files.open_info(path).format]


def header_lines(path: str, kind: str = "bh", n: int = 0) -> list[str]:
    """A header as printed lines."""
    return codec.header_lines(hd.read_header(path, kind, n), spec.BINARY if kind == "bh" else spec.TRACE)
