"""Volumes as DataFrames: placing traces on the grid, slicing, gathering, fancy indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import Geometry

INDEX = ("iline_idx", "xline_idx", "offset_idx")
KEYS = ("iline", "xline", "offset")


def indexed(traces: DataFrame, geometry: Geometry, strict: bool = False) -> DataFrame:
    """Add grid indexes. Traces off the grid are left out, or raise if ``strict``."""
    inside = F.lit(True)
    out = traces
    for name, key, axis in zip(INDEX, KEYS, geometry.axes):
        d = F.col(key) - axis.low
        good = (d % axis.step == 0) & (F.col(key) <= axis.high) & (d >= 0)
        inside = inside & good
        place = F.floor(d / axis.step).cast("int")
        out = out.withColumn(name, F.when(good, place).otherwise(F.raise_error(F.lit(f"{key} is off the grid")).cast("int")) if strict else place)
    return out if strict else out.where(inside)


def last_wins(traces: DataFrame, index: Sequence[str]) -> DataFrame:
    """Of traces in one cell the last in the file. The choice is made on trace numbers; samples join afterwards."""
    keep = traces.groupBy(*index).agg(F.max("trace_idx").alias("trace_idx"))
    return traces.join(keep, [*index, "trace_idx"], "left_semi")


def grid(spark: SparkSession, geometry: Geometry, ranges: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """All cells, or those of half-open index ranges; made on the executors."""
    axes = [(n, *(ranges or {}).get(n, (0, a.size))) for n, a in zip(INDEX, geometry.axes)]
    total = 1
    for _, a, b in axes:
        total *= b - a
    out, rest = spark.range(total), F.col("id")
    columns = []
    for n, a, b in reversed(axes):
        columns.append((rest % (b - a) + a).cast("int").alias(n))
        rest = F.floor(rest / (b - a))
    return out.select(*reversed(columns))


def densify(traces: DataFrame, geometry: Geometry, nt: int, fill: float = 0.0, ranges: dict[str, tuple[int, int]] | None = None, time: tuple[int, int] | None = None, strict: bool = False) -> DataFrame:
    """Every cell with its samples, missing traces filled: the grid left-joined with the traces.

    A regular survey has no missing and no double cells, so its traces are
    returned as they are, without a join.
    """
    spark = traces.sparkSession
    index = list(INDEX[: len(geometry.axes)])
    t0, t1 = time or (0, nt)
    placed = indexed(traces, geometry, strict)
    for n, (a, b) in (ranges or {}).items():
        placed = placed.where((F.col(n) >= a) & (F.col(n) < b))
    samples = F.slice("samples", t0 + 1, t1 - t0) if (t0, t1) != (0, nt) else F.col("samples")
    if geometry.regular:
        return placed.select(*index, samples.alias("samples"))
    placed = last_wins(placed, index).select(*index, samples.alias("samples"))
    empty = F.array_repeat(F.lit(fill).cast("float"), t1 - t0)
    return grid(spark, geometry, ranges).join(placed, index, "left").select(*index, F.coalesce("samples", empty).alias("samples"))


def time_slice(traces: DataFrame, geometry: Geometry, k: int, fill: float = 0.0) -> DataFrame:
    """One sample for every cell; only that sample passes the join."""
    index = list(INDEX[: len(geometry.axes)])
    placed = indexed(traces, geometry).withColumn("value", F.element_at("samples", k + 1)).drop("samples")
    if geometry.regular:
        return placed.select(*index, "value")
    placed = last_wins(placed, index).select(*index, "value")
    return grid(traces.sparkSession, geometry).join(placed, index, "left").select(*index, F.coalesce("value", F.lit(fill).cast("float")).alias("value"))


def geometry_map(keys: DataFrame, geometry: Geometry) -> DataFrame:
    """Every cell with the number of its (last) trace, null where there is none."""
    index = list(INDEX[: len(geometry.axes)])
    placed = indexed(keys, geometry).groupBy(*index).agg(F.max("trace_idx").alias("trace_idx"))
    return grid(keys.sparkSession, geometry).join(placed, index, "left")


def bounds(beg: int, end: int, n: int) -> tuple[int, int]:
    """Half-open range of n: beg < 0 all; end < 0 up to the last; end = 0 the one at beg."""
    if beg < 0:
        return 0, n
    end = n if end < 0 else beg + 1 if end == 0 else end
    if not 0 <= beg < end <= n:
        raise IndexError(f"range {beg}..{end} is outside 0..{n}")
    return beg, end


def collect(traces: DataFrame, trace_count: int, nt: int, beg: int = -1, end: int = 0, tbeg: int = -1, tend: int = 0) -> DataFrame:
    """A range of traces and of samples, each by ``bounds``."""
    a, b = bounds(beg, end, trace_count)
    t0, t1 = bounds(tbeg, tend, nt)
    rows = traces if (a, b) == (0, trace_count) else traces.where((F.col("trace_idx") >= a) & (F.col("trace_idx") < b))
    return rows.withColumn("samples", F.slice("samples", t0 + 1, t1 - t0)) if (t0, t1) != (0, nt) else rows


def gather(traces: DataFrame, index: DataFrame, trace_count: int, nt: int, tbeg: int = 0, tend: int | None = None) -> DataFrame:
    """(pos, trace_idx, samples) for the rows of ``index`` (pos, trace_idx): any order, repeats allowed; a negative number gives zeros, one beyond the file raises."""
    tend = nt if tend is None else tend
    checked = index.withColumn("trace_idx", F.when(F.col("trace_idx") < trace_count, F.col("trace_idx")).otherwise(F.raise_error(F.lit("trace index out of range")).cast("long")))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), tend - tbeg)
    cut = traces.select("trace_idx", F.slice("samples", tbeg + 1, tend - tbeg).alias("samples"))
    return checked.join(cut, "trace_idx", "left").select("pos", "trace_idx", F.coalesce("samples", zeros).alias("samples"))


def map_to_index(cells: DataFrame, cell_map: DataFrame) -> DataFrame:
    """Trace numbers of (pos, iline_idx, xline_idx) rows, -1 where there is none."""
    return cells.join(cell_map, ["iline_idx", "xline_idx"], "left").select("pos", "iline_idx", "xline_idx", F.coalesce("trace_idx", F.lit(-1)).alias("trace_idx"))


def exploded(volume: DataFrame, columns: Sequence[str], start: int = 0, name: str = "value") -> DataFrame:
    """One row for each sample: the columns, k (0-based from ``start``) and the value as double."""
    return volume.select(*columns, F.posexplode("samples").alias("k", "v")).select(*columns, (F.col("k") + start).cast("int").alias("k"), F.col("v").cast("double").alias(name))


def normalise_key(key, shape: tuple[int, ...]) -> list[tuple[int, int] | list[int]]:
    """A subscript as one half-open range or index list for each axis.

    Integers wrap when negative; slices follow Python's rules but may not
    step; one Ellipsis stands for full axes; None entries are skipped.
    """
    parts = [k for k in (key if isinstance(key, tuple) else (key,)) if k is not None]
    if sum(k is Ellipsis for k in parts) > 1:
        raise IndexError("an index can only have a single ellipsis")
    if any(k is Ellipsis for k in parts):
        at = next(i for i, k in enumerate(parts) if k is Ellipsis)
        parts[at : at + 1] = [slice(None)] * (len(shape) - len(parts) + 1)
    if len(parts) > len(shape):
        raise IndexError("too many indices")
    out: list[tuple[int, int] | list[int]] = []
    for k, n in zip(parts + [slice(None)] * (len(shape) - len(parts)), shape, strict=True):
        if isinstance(k, slice):
            if k.step not in (None, 1):
                raise IndexError("slices with steps are not supported")
            a, b, _ = k.indices(n)
            if a >= b:
                raise IndexError("empty range")
            out.append((a, b))
        elif hasattr(k, "__len__"):
            own = [int(i) + (n if i < 0 else 0) for i in k]
            if any(not 0 <= i < n for i in own):
                raise IndexError("index out of range")
            out.append(own)
        else:
            i = int(k) + (n if k < 0 else 0)
            if not 0 <= i < n:
                raise IndexError("index out of range")
            out.append((i, i + 1))
    return out


def _chosen(rows: DataFrame, index: str, own: tuple[int, int] | list[int]) -> DataFrame:
    return rows.where(range_filter(index, own) if isinstance(own, tuple) else F.col(index).isin(sorted(set(own))))


def fancy(traces: DataFrame, geometry: Geometry, nt: int, key, fill: float = 0.0, t0: int = 0) -> DataFrame:
    """Cells of an orthogonal subscript with their samples: index lists cross; the time axis may be a list too.

    Columns: pos_i, pos_x (places in the result), the grid indexes, samples.
    ``traces`` may be any part of the survey that has the cells, with samples
    from ``t0`` on. Traces of a regular survey are neither shuffled nor
    compared; else of those in one cell the last counts, among the cells asked for.
    """
    spark = traces.sparkSession
    il, xl, tm = normalise_key(key, (*geometry.shape[:2], nt))
    at = F.slice("samples", tm[0] - t0 + 1, tm[1] - tm[0]) if isinstance(tm, tuple) else F.array(*(F.element_at("samples", i - t0 + 1) for i in tm))
    size = tm[1] - tm[0] if isinstance(tm, tuple) else len(tm)
    found = _chosen(_chosen(indexed(traces, geometry), INDEX[0], il), INDEX[1], xl)
    if not geometry.regular:
        found = last_wins(found, INDEX[:2])
    found = found.select(*INDEX[:2], at.alias("samples"))

    def places(rows: DataFrame, own, name: str, pos: str) -> DataFrame:
        if isinstance(own, tuple):
            return rows.withColumn(pos, F.col(name) - own[0])
        # a list comes from the caller; a place for each of its entries
        return rows.join(F.broadcast(spark.createDataFrame(list(enumerate(own)), f"{pos} int, {name} int")), name)

    names = ["pos_i", "pos_x", *INDEX[:2]]
    if geometry.regular:
        return places(places(found, il, INDEX[0], "pos_i"), xl, INDEX[1], "pos_x").select(*names, "samples")
    whole = {n: own if isinstance(own, tuple) else (min(own, default=0), max(own, default=-1) + 1) for n, own in zip(INDEX, (il, xl))}
    cells = places(places(grid(spark, Geometry(geometry.axes[:2], 0, False), whole), il, INDEX[0], "pos_i"), xl, INDEX[1], "pos_x")
    return cells.join(found, list(INDEX[:2]), "left").select(*names, F.coalesce("samples", F.array_repeat(F.lit(fill).cast("float"), size)).alias("samples"))


def range_filter(column: str, own: tuple[int, int]) -> Column:
    return (F.col(column) >= own[0]) & (F.col(column) < own[1])
