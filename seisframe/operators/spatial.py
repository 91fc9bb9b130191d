"""Map coordinates, paths and interpolation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import Geometry


@dataclass(frozen=True)
class Affine:
    """x = a * iline + b * xline + c, y = d * iline + e * xline + f."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    @property
    def determinant(self) -> float:
        return self.a * self.e - self.b * self.d

    @property
    def matrix(self) -> np.ndarray:
        return np.array([[self.a, self.b, self.c], [self.d, self.e, self.f], [0.0, 0.0, 1.0]])


def fit_affine(keys: DataFrame) -> Affine:
    """Least squares over all rows (iline, xline, x_coord, y_coord), from centred second moments in one aggregate."""
    i, x = F.col("iline").cast("double"), F.col("xline").cast("double")
    X, Y = F.col("x_coord").cast("double"), F.col("y_coord").cast("double")
    m = keys.agg(
        F.count(i).alias("n"), F.avg(i).alias("mi"), F.avg(x).alias("mx"), F.avg(X).alias("mX"), F.avg(Y).alias("mY"),
        F.covar_pop(i, i).alias("ii"), F.covar_pop(x, x).alias("xx"), F.covar_pop(i, x).alias("ix"),
        F.covar_pop(i, X).alias("iX"), F.covar_pop(x, X).alias("xX"), F.covar_pop(i, Y).alias("iY"), F.covar_pop(x, Y).alias("xY"),
    ).first()
    det = (m["ii"] or 0) * (m["xx"] or 0) - (m["ix"] or 0) ** 2
    if m["n"] < 3 or det <= 1e-12 * max(m["ii"] * m["xx"], 1e-300):
        raise ValueError("at least three traces that don't lie on one line are needed")
    rows = []
    for p, q, mean in ((m["iX"], m["xX"], m["mX"]), (m["iY"], m["xY"], m["mY"])):
        a, b = (p * m["xx"] - q * m["ix"]) / det, (q * m["ii"] - p * m["ix"]) / det
        rows += [a, b, mean - a * m["mi"] - b * m["mx"]]
    return Affine(*rows)


def ix_to_xy(points: DataFrame, t: Affine, geometry: Geometry | None = None) -> DataFrame:
    """Add x, y (rounded to 2) to rows (i, j): line numbers, or zero-based indexes if the geometry is given (one line number each step)."""
    i, j = (F.col("i"), F.col("j")) if geometry is None else (F.col("i") + geometry.axes[0].low, F.col("j") + geometry.axes[1].low)
    return points.withColumn("x", F.round(i * t.a + j * t.b + t.c, 2)).withColumn("y", F.round(i * t.d + j * t.e + t.f, 2))


def xy_to_ix(points: DataFrame, t: Affine, geometry: Geometry | None = None) -> DataFrame:
    """Add i, j (rounded to 2) to rows (x, y)."""
    u, v = F.col("x") - t.c, F.col("y") - t.f
    i, j = (u * t.e - v * t.b) / t.determinant, (v * t.a - u * t.d) / t.determinant
    if geometry is not None:
        i, j = i - geometry.axes[0].low, j - geometry.axes[1].low
    return points.withColumn("i", F.round(i, 2)).withColumn("j", F.round(j, 2))


def north(t: Affine) -> tuple[float, float]:
    """The unit vector in line numbers that points to growing y."""
    i, j = -1000 * t.b / t.determinant, 1000 * t.a / t.determinant
    i, j = round(i, 2), round(j, 2)
    length = math.hypot(i, j)
    return i / length, j / length


def place_points(points: Sequence[Sequence[float]], geometry: Geometry, kind: str = "auto", t: Affine | None = None) -> np.ndarray:
    """Points as zero-based indexes; kind 'zero', 'line', 'xy' or 'auto'. Line numbers are divided by the steps."""
    p = np.array(points, dtype=float)
    il, xl = geometry.axes[:2]
    if kind == "auto":
        kind = "xy" if p.max() > 100_000 else "line" if p[:, 0].max() >= il.size or p[:, 1].max() >= xl.size else "zero"
    if kind == "xy":
        if t is None:
            raise ValueError("map coordinates need a fitted transform")
        q = p - [t.c, t.f]
        p = np.column_stack([(q[:, 0] * t.e - q[:, 1] * t.b) / t.determinant, (q[:, 1] * t.a - q[:, 0] * t.d) / t.determinant]).round(6)
    if kind in ("xy", "line"):
        p = (p - [il.low, xl.low]) / [il.step, xl.step]
    if p.min() < 0 or p[:, 0].max() >= il.size or p[:, 1].max() >= xl.size:
        raise ValueError("points are outside the survey; perhaps their kind is wrong")
    return p


def resample_path(points: np.ndarray, di: float = 1.0) -> np.ndarray:
    """Points every ``di`` along the path, from its start up to one that reaches or passes its end (which stays at the end)."""
    legs = np.hypot(*np.diff(points, axis=0).T)
    along = np.concatenate([[0.0], np.cumsum(legs)])
    at = np.minimum(np.arange(0, along[-1] + di, di), along[-1])
    leg = np.clip(np.searchsorted(along, at, side="right") - 1, 0, max(len(legs) - 1, 0))
    part = np.divide(at - along[leg], legs[leg], out=np.zeros_like(at), where=legs[leg] > 0)
    return points[leg] + part[:, None] * (points[leg + 1] - points[leg])


def path_frame(spark: SparkSession, path: np.ndarray) -> DataFrame:
    """(pos, px, py): a path is as long as the caller's points make it."""
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(path)], "pos int, px double, py double")


def corners(path: DataFrame, geometry: Geometry) -> DataFrame:
    """The four cells about each path point with their bilinear weights: (pos, iline_idx, xline_idx, weight)."""
    ni, nx = geometry.shape[:2]
    if ni < 2 or nx < 2:
        raise ValueError("interpolation needs two lines in each direction")
    low = lambda c, n: F.greatest(F.lit(0), F.least(F.floor(F.col(c)), F.lit(n - 2))).cast("int")
    rows = path.withColumn("i", low("px", ni)).withColumn("j", low("py", nx)).withColumn("u", F.col("px") - F.col("i")).withColumn("v", F.col("py") - F.col("j"))
    u, v = F.col("u"), F.col("v")
    four = [(0, 0, (1 - u) * (1 - v)), (0, 1, (1 - u) * v), (1, 0, u * (1 - v)), (1, 1, u * v)]
    cell = F.explode(F.array(*(F.struct((F.col("i") + a).alias("iline_idx"), (F.col("j") + b).alias("xline_idx"), w.alias("weight")) for a, b, w in four)))
    return rows.select("pos", cell.alias("c")).select("pos", "c.iline_idx", "c.xline_idx", "c.weight")


def interpolate(path: DataFrame, volume: DataFrame, geometry: Geometry) -> DataFrame:
    """(pos, k, value): bilinear samples at each path point. Each needed trace is read once, whatever the number of points that use it."""
    need = corners(path, geometry)
    cells = need.select("iline_idx", "xline_idx").distinct()
    found = volume.join(F.broadcast(cells), ["iline_idx", "xline_idx"]).select("iline_idx", "xline_idx", "samples")  # four cells a point at most
    parts = need.join(found, ["iline_idx", "xline_idx"])
    weighted = parts.select("pos", F.posexplode(F.transform("samples", lambda s: s.cast("double") * F.col("weight"))).alias("k", "part"))
    return weighted.groupBy("pos", "k").agg(F.sum("part").alias("value"))


def region_outline(index: DataFrame) -> DataFrame:
    """(seq, line_num, xline): line starts going up, then line ends coming down; missing lines are left out."""
    there = index.where("count > 0")
    going = there.select(F.lit(0).alias("side"), F.col("line_num").alias("by"), "line_num", F.col("crossline_start").alias("xline"))
    back = there.select(F.lit(1).alias("side"), (-F.col("line_num")).alias("by"), "line_num", F.col("crossline_end").alias("xline"))
    from pyspark.sql import Window

    return going.union(back).withColumn("seq", (F.row_number().over(Window.orderBy("side", "by")) - 1).cast("int")).select("seq", "line_num", "xline")


def region_outline_xy(index: DataFrame, keys: DataFrame) -> DataFrame:
    """(seq, x, y): map coordinates of the line starts going up, then of the line ends coming down."""
    from pyspark.sql import Window

    there = index.where("count > 0")
    ends = there.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("line_num").alias("by"), F.col("trace_start").alias("trace_idx")), F.struct(F.lit(1).alias("side"), (-F.col("line_num")).alias("by"), F.col("trace_end").alias("trace_idx")))).alias("o")).select("o.*")
    at = ends.join(keys.select("trace_idx", F.col("x_coord").alias("x"), F.col("y_coord").alias("y")), "trace_idx")
    return at.withColumn("seq", (F.row_number().over(Window.orderBy("side", "by")) - 1).cast("int")).select("seq", "x", "y")  # two rows a line


def edges_xy(keys: DataFrame, geometry: Geometry) -> DataFrame:
    """(seq, x, y): map coordinates of the first crossline's traces going up, then of the last crossline's coming down; inlines that don't reach it are left out. Of traces in one cell the last counts."""
    from pyspark.sql import Window

    axis = geometry.axes[1]
    last = keys.where(F.col("xline").isin(axis.low, axis.high)).groupBy("iline", "xline").agg(F.max_by(F.struct("x_coord", "y_coord"), "trace_idx").alias("at"))
    sides = [last.where(F.col("xline") == line).select(F.lit(side).alias("side"), by.alias("by"), F.col("at.x_coord").alias("x"), F.col("at.y_coord").alias("y")) for side, line, by in ((0, axis.low, F.col("iline")), (1, axis.high, -F.col("iline")))]
    return sides[0].union(sides[1]).withColumn("seq", (F.row_number().over(Window.orderBy("side", "by")) - 1).cast("int")).select("seq", "x", "y")  # two rows a line
