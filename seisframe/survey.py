"""A SEG-Y file as a lazy, sliceable survey."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spec
from .operators import geometry as g
from .operators import sinks, spatial
from .operators import volume as vol
from .sources import files, segy


class Survey:
    """Traces of one file, with geometry found on first use.

    ``survey[i, a:b, [3, 1]]`` is a DataFrame of cells with their samples;
    ``to_numpy`` collects one. In the two-dimensional view (``to_2d``)
    subscripts are (trace, sample).
    """

    def __init__(self, spark: SparkSession, path: str, iline: int | None = None, xline: int | None = None, istep: int | None = None, xstep: int | None = None, xloc: int = spec.X_COORD, yloc: int = spec.Y_COORD, offset: int = spec.OFFSET, as_2d: bool = False, ic: DataFrame | None = None, fill: float = 0.0):
        self.spark, self.path, self.info, self.as_2d, self.fill, self.ic = spark, path, files.open_info(path), as_2d, fill, ic
        if not as_2d and ic is None and (iline is None or xline is None):
            iline, xline, istep, xstep, xloc, yloc = guess(path, spark, iline, xline, istep, xstep, most=1)[0]
        self.options = {"iline": iline or spec.ILINE, "xline": xline or spec.XLINE, "xloc": xloc, "yloc": yloc, "offset": offset}
        self.steps = (istep, xstep)
        self._scalar: float | None = None

    def _with_keys(self, rows: DataFrame) -> DataFrame:
        if self.ic is None:
            return rows
        return rows.drop("iline", "xline").join(self.ic.select("trace_idx", "iline", "xline"), "trace_idx")

    @property
    def traces(self) -> DataFrame:
        return self._with_keys(segy.load(self.spark, self.path, "traces", **self.options))

    @property
    def keys(self) -> DataFrame:
        return self._with_keys(segy.load(self.spark, self.path, "keys", **self.options))

    @cached_property
    def geometry(self) -> g.Geometry:
        if self.ic is not None and self.ic.count() != self.trace_count:
            raise ValueError("external keys must have one row for each trace")
        return g.scan(self.keys, steps=self.steps)

    @cached_property
    def affine(self) -> spatial.Affine:
        return spatial.fit_affine(self.keys)

    @property
    def trace_count(self) -> int:
        return self.info.trace_count

    @property
    def shape(self) -> tuple[int, ...]:
        return (self.trace_count, self.info.nt) if self.as_2d else (*self.geometry.shape, self.info.nt)

    def __len__(self) -> int:
        return self.shape[0]

    @property
    def dt(self) -> int:
        return self.info.dt

    @property
    def iline_range(self) -> tuple[int, int]:
        return self.geometry.axes[0].low, self.geometry.axes[0].high

    @property
    def xline_range(self) -> tuple[int, int]:
        return self.geometry.axes[1].low, self.geometry.axes[1].high

    @cached_property
    def line_index(self) -> DataFrame:
        return g.line_index(self.keys, self.geometry.axes[0].step)

    @property
    def volume(self) -> DataFrame:
        return vol.densify(self.traces, self.geometry, self.info.nt, self.fill)

    def to_2d(self) -> Survey:
        return self._view(True)

    def to_3d(self) -> Survey:
        return self._view(False)

    def _view(self, flat: bool) -> Survey:
        other = object.__new__(Survey)
        other.__dict__.update(self.__dict__ | {"as_2d": flat})
        return other

    def _reach(self, il: tuple[int, int] | list[int], xl: tuple[int, int] | list[int]) -> dict:
        """Source options for the records that can hold these cells: by arithmetic in an ordered survey, else from a pass over the keys."""
        (i0, i1), (x0, x1) = (own if isinstance(own, tuple) else (min(own, default=0), max(own, default=-1) + 1) for own in (il, xl))
        geo = self.geometry
        if i0 >= i1 or x0 >= x1:
            return {"first": 0, "end": 0}
        if geo.in_order and len(geo.axes) == 2:
            nx = geo.shape[1]
            if x1 - x0 == nx or i1 - i0 == 1:
                return {"first": i0 * nx + x0, "end": (i1 - 1) * nx + x1}
            return {"lines": f"{i0 * nx + x0},{x1 - x0},{nx},{i1 - i0}"}
        placed = vol.indexed(self.keys, geo).where(vol.range_filter("iline_idx", (i0, i1)) & vol.range_filter("xline_idx", (x0, x1)))
        ends = placed.agg(F.min("trace_idx").alias("a"), F.max("trace_idx").alias("b")).first()  # one row
        return {"first": 0, "end": 0} if ends["a"] is None else {"first": ends["a"], "end": ends["b"] + 1}

    def _part(self, **reach) -> DataFrame:
        return self._with_keys(segy.load(self.spark, self.path, "traces", **reach, **self.options))

    def __getitem__(self, key) -> DataFrame:
        tm = vol.normalise_key(key, self.shape)[-1]
        t0, t1 = tm if isinstance(tm, tuple) else (min(tm, default=0), max(tm, default=0) + 1)
        if not self.as_2d:
            il, xl = vol.normalise_key(key, (*self.geometry.shape[:2], self.info.nt))[:2]
            return vol.fancy(self._part(t0=t0, t1=t1, **self._reach(il, xl)), self.geometry, self.info.nt, key, self.fill, t0)
        rows = vol.normalise_key(key, self.shape)[0]
        if isinstance(rows, tuple):
            out = self._part(first=rows[0], end=rows[1], t0=t0, t1=t1).withColumn("pos", F.col("trace_idx") - rows[0])
        else:
            index = self.spark.createDataFrame(list(enumerate(rows)), "pos int, trace_idx bigint")
            out = segy.load(self.spark, self.path, "traces", index=",".join(map(str, rows)), t0=t0, t1=t1, **self.options).join(F.broadcast(index), "trace_idx")  # the caller's list
        at = F.col("samples") if isinstance(tm, tuple) else F.array(*(F.element_at("samples", i - t0 + 1) for i in tm))
        return out.select("pos", "trace_idx", at.alias("samples"))

    def read_traces(self, index, tbeg: int = 0, tend: int | None = None) -> DataFrame:
        """(pos, trace_idx, samples) of a list of trace numbers, or of (inline, crossline) index pairs; no trace (or -1) gives zeros."""
        index = np.asarray(index)
        if index.ndim == 2:
            wanted = self.map_to_index(index).select("pos", "trace_idx")
            real = [r["trace_idx"] for r in wanted.select("trace_idx").distinct().collect()]  # the caller's list
        else:
            real = sorted({int(i) for i in index.tolist()})
            wanted = self.spark.createDataFrame([(k, int(i)) for k, i in enumerate(index.tolist())], "pos int, trace_idx bigint")
        tend = self.info.nt if tend is None else tend
        rows = segy.load(self.spark, self.path, "traces", index=",".join(str(i) for i in real if i >= 0), t0=tbeg, t1=tend, **self.options)
        return vol.gather(rows, wanted, self.trace_count, tend - tbeg)

    def map_to_index(self, cells) -> DataFrame:
        """(pos, iline_idx, xline_idx, trace_idx) of index pairs, -1 where there is no trace."""
        asked = self.spark.createDataFrame([(k, int(i), int(x)) for k, (i, x) in enumerate(np.asarray(cells).tolist())], "pos int, iline_idx int, xline_idx int")
        return vol.map_to_index(asked, vol.geometry_map(self.keys, self.geometry))

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        """All samples, for numpy's functions; the caller sees to the size."""
        out = self.to_numpy().reshape(self.shape)
        return out if dtype is None else out.astype(dtype)

    def to_numpy(self, key=Ellipsis) -> np.ndarray:
        """The (squeezed) array of a subscript; the caller sees to its size."""
        got = self[key].toPandas()
        if self.as_2d:
            return np.squeeze(np.stack(got.sort_values("pos")["samples"].to_list()))
        got = got.sort_values(["pos_i", "pos_x"])
        flat = np.stack(got["samples"].to_list())
        return np.squeeze(flat.reshape(got["pos_i"].nunique(), got["pos_x"].nunique(), -1))

    def min(self, exact: bool = False) -> float:
        return g.sampled_range(self.traces, self.trace_count, exact).first()["low"]

    def max(self, exact: bool = False) -> float:
        return g.sampled_range(self.traces, self.trace_count, exact).first()["high"]

    def _transform(self, points, kind: str) -> spatial.Affine | None:
        return self.affine if kind == "xy" or (kind == "auto" and np.max(points) > 100_000) else None

    def _interpolated(self, path: np.ndarray) -> DataFrame:
        """(pos, k, value) at index points; only the box about them is read."""
        ni, nx = self.geometry.shape[:2]
        box = [(max(0, min(int(p.min()), n - 2)), min(n, int(p.max()) + 2)) for p, n in zip(path.T, (ni, nx))]
        volume = vol.densify(self._part(**self._reach(*box)), self.geometry, self.info.nt, self.fill, dict(zip(vol.INDEX, box)))
        return spatial.interpolate(spatial.path_frame(self.spark, path), volume, self.geometry)

    def arbitrary_line(self, points, kind: str = "auto", di: float = 1.0) -> tuple[DataFrame, np.ndarray]:
        """(pos, k, value) along a path, and the path."""
        path = spatial.resample_path(spatial.place_points(points, self.geometry, kind, self._transform(points, kind)), di)
        return self._interpolated(path), path

    def interp(self, points, kind: str = "auto") -> DataFrame:
        """(pos, k, value) at single points."""
        return self._interpolated(spatial.place_points(points, self.geometry, kind, self._transform(points, kind)))

    def ix_to_xy(self, points, zero_based: bool = True) -> np.ndarray:
        """Map coordinates of (inline, crossline) pairs: indexes, or line numbers."""
        rows = self.spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(np.asarray(points).tolist())], "pos int, i double, j double")
        return np.array([(r["x"], r["y"]) for r in spatial.ix_to_xy(rows, self.affine, self.geometry if zero_based else None).orderBy("pos").collect()])  # the caller's list

    def xy_to_ix(self, points, zero_based: bool = True) -> np.ndarray:
        """(inline, crossline) indexes, or line numbers, of map coordinates."""
        rows = self.spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(np.asarray(points).tolist())], "pos int, x double, y double")
        return np.array([(r["i"], r["j"]) for r in spatial.xy_to_ix(rows, self.affine, self.geometry if zero_based else None).orderBy("pos").collect()])  # the caller's list

    def north(self) -> tuple[float, float]:
        return spatial.north(self.affine)

    def _first_header(self, loc: int) -> int:
        from . import codec

        return int(codec.field(np.frombuffer(files.read_at(self.path, spec.PREAMBLE, spec.TRACE_BYTES), dtype=np.uint8)[None], loc, 2)[0])

    @property
    def time_start(self) -> int:
        return self._first_header(spec.START_TIME)

    @property
    def scalar(self) -> float:
        """What coordinates are multiplied by."""
        if self._scalar is not None:
            return self._scalar
        raw = self._first_header(spec.SCALAR)
        return 1.0 if raw == 0 else float(raw) if raw > 0 else -1.0 / raw

    @scalar.setter
    def scalar(self, value: float) -> None:
        self._scalar = value

    @property
    def is_create_geometry(self) -> bool:
        """Whether the geometry has been found already."""
        return "geometry" in self.__dict__

    @cached_property
    def interval(self) -> tuple[float, float] | None:
        """Distances between neighbouring inlines and crosslines on the map, scaled; None if the survey is too small to tell."""
        il, xl = self.geometry.axes[:2]
        got = g.intervals(self.line_index, self.keys.select("trace_idx", "x_coord", "y_coord"), il.step, xl.step).first()
        return got and (got["i_interval"] * self.scalar, got["x_interval"] * self.scalar)

    @property
    def time_axis(self) -> np.ndarray:
        """Milliseconds of each sample."""
        return self.time_start + np.arange(self.info.nt) * self.dt / 1000

    def timed(self, key=Ellipsis) -> DataFrame:
        """(pos_i, pos_x, iline_idx, xline_idx, k, time, value) of a subscript with a contiguous time range."""
        t0 = vol.normalise_key(key, self.shape)[-1][0]
        rows = vol.exploded(self[key], ["pos_i", "pos_x", *vol.INDEX[:2]], t0)
        return rows.withColumn("time", F.lit(float(self.time_start)) + F.col("k") * self.dt / 1000)

    def outline(self, mode: str = "line") -> DataFrame:
        """The region's outline: (seq, line_num, xline), or (seq, x, y) on the map: of line ends, or for 'edges' of the traces on the first and last crossline."""
        if mode not in ("line", "xy", "edges"):
            raise ValueError("the mode is 'line', 'xy' or 'edges'")
        if mode == "edges":
            return spatial.edges_xy(self.keys, self.geometry)
        return spatial.region_outline(self.line_index) if mode == "line" else spatial.region_outline_xy(self.line_index, self.keys)

    def key_series(self, columns: tuple[str, ...] = ("iline", "xline"), beg: int = -1, end: int = 0) -> DataFrame:
        """(trace_idx, columns) of a range of traces, for panels of two or three keys."""
        a, b = vol.bounds(beg, end, self.trace_count)
        return self._with_keys(segy.load(self.spark, self.path, "keys", first=a, end=b, **self.options)).select("trace_idx", *columns)

    def tofile(self, path: str) -> None:
        sinks.tofile(self.traces, path, self.info.nt, None if self.as_2d else self.geometry, self.trace_count, self.fill)

    def __repr__(self) -> str:
        return f"Survey({self.path!r}, traces={self.trace_count}, nt={self.info.nt}, dt={self.info.dt}, format={spec.FORMAT_LABELS[self.info.format]!r})"


class Probe:
    """A few header values of a file, for guessing, by one read for neighbouring traces."""

    def __init__(self, path: str):
        self.info = files.open_info(path)

    def values(self, loc: int, first: int, n: int) -> list[int]:
        from . import codec

        n = max(0, min(n, self.info.trace_count - first))
        if not n:
            return []
        raw = files.read_at(self.info.path, spec.PREAMBLE + first * self.info.record, (n - 1) * self.info.record + spec.TRACE_BYTES)
        heads = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, dtype=np.uint8), spec.TRACE_BYTES)[:: self.info.record]
        return codec.field(np.ascontiguousarray(heads), loc, 4).tolist()

    def one(self, loc: int, at: int) -> int:
        return self.values(loc, at, 1)[0]

    def changes(self, loc: int, first: int) -> list[int]:
        """Up to three successive values from a trace on; a line can have a tenth of all traces and more, so steps double until a change is found, and are then halved."""
        out, at = [self.one(loc, first)], first
        n = self.info.trace_count
        while len(out) < 3 and at + 1 < n:
            step = 1
            while at + step < n and self.one(loc, at + step) == out[-1]:
                step *= 2
            same, other = at + step // 2 if step > 1 else at, min(at + step, n - 1)
            if self.one(loc, other) == out[-1]:
                break
            while other - same > 1:
                mid = (same + other) // 2
                same, other = (mid, other) if self.one(loc, mid) == out[-1] else (same, mid)
            at = other
            out.append(self.one(loc, at))
        return out


#: Where lines are usually numbered, the most usual place first.
XLINES, ILINES = (193, 17, 21, 13), (189, 5, 9, 221)


def candidates(path: str) -> tuple[list[int], list[int]]:
    """Locations whose probed values look like inlines, and like crosslines."""
    probe = Probe(path)
    n = probe.info.trace_count
    mid = n // 2
    xlines = [x for x in XLINES if g.plausible_xline(probe.one(x, 0), probe.one(x, n - 1), probe.values(x, mid, 10), n)]
    ilines = [i for i in ILINES if g.plausible_iline(probe.one(i, 0), probe.one(i, mid), probe.one(i, n - 1), n)]
    return ilines, xlines


def steps(path: str, ilines: list[int], xlines: list[int]) -> tuple[dict[int, int], dict[int, int]]:
    """Steps of the candidate locations that have a clear one."""
    probe = Probe(path)
    mid = probe.info.trace_count // 2
    xsteps = {x: g.probe_xstep(lambda shift, x=x: probe.values(x, mid + shift, 10)) for x in xlines}
    isteps = {i: abs(g.probe_istep(probe.changes(i, mid))) for i in ilines}
    return {k: v for k, v in isteps.items() if v}, {k: v for k, v in xsteps.items() if v}


def guess(path: str, spark: SparkSession, iline: int | None = None, xline: int | None = None, istep: int | None = None, xstep: int | None = None, xloc: int | None = None, yloc: int | None = None, most: int | None = None) -> list[tuple[int, int, int, int, int, int]]:
    """Plausible (iline, xline, istep, xstep, xloc, yloc), most usual locations first; what is given is not guessed. ``most``: stop after so many.

    A candidate counts only if its geometry can be scanned. Coordinates are at
    181 and 185 if the first candidate's intervals there are finite and not zero, else at 73 and 77.
    """
    ilines, xlines = candidates(path)
    ilines, xlines = ([iline] if iline else ilines), ([xline] if xline else xlines)
    isteps, xsteps = steps(path, ilines, xlines)
    isteps, xsteps = (dict.fromkeys(ilines, istep) if istep else isteps), (dict.fromkeys(xlines, xstep) if xstep else xsteps)
    out, first = [], None
    for il, xl in ((il, xl) for il in isteps for xl in xsteps if il != xl):
        if most is not None and len(out) >= most:
            break
        keys = segy.load(spark, path, "keys", iline=il, xline=xl, xloc=181, yloc=185)
        try:
            geo = g.scan(keys, steps=(isteps[il], xsteps[xl]))
        except ValueError:  # off the grid
            continue
        first = first or (keys, geo)
        out.append((il, xl, isteps[il], xsteps[xl]))
    if first is None:
        raise ValueError("no plausible key locations")
    if xloc is None or yloc is None:
        keys, geo = first
        il, xl = geo.axes
        got = g.intervals(g.line_index(keys, il.step), keys.select("trace_idx", "x_coord", "y_coord"), il.step, xl.step).first()
        good = got is not None and all(v is not None and np.isfinite(v) and v != 0 for v in got)
        xloc, yloc = (181, 185) if good else (73, 77)
    return [(*o, xloc, yloc) for o in out]
