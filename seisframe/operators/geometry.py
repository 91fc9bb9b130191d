"""Survey geometry from key columns: ranges, steps, line index, checks. All by aggregates and windows over keys; samples are never read."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """A key's range and step."""

    low: int
    high: int
    step: int

    @property
    def size(self) -> int:
        return (self.high - self.low) // self.step + 1


@dataclass(frozen=True)
class Geometry:
    """Axes in order (iline, xline[, offset]) and the number of traces."""

    axes: tuple[Axis, ...]
    trace_count: int
    #: every cell has exactly one trace
    regular: bool
    #: regular, and traces stand in the order of cells
    in_order: bool = False

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(a.size for a in self.axes)

    def as_dict(self) -> dict:
        names = ("iline", "xline", "offset")
        return {"shape": list(self.shape), "trace_count": self.trace_count, "regular": self.regular} | {n: asdict(a) for n, a in zip(names, self.axes)}


def key_axes(keys: DataFrame, columns: tuple[str, ...], chunk: int = 1 << 16) -> DataFrame:
    """One row (axis, low, high, step) for each column that has a key, in one pass; step is the smallest gap of the sorted distinct keys (1 for a single key).

    Gaps are found inside ranges of ``chunk`` numbers, and between the ends of
    neighbouring ranges, so no task orders all keys of an axis.
    """
    each = keys.select(F.explode(F.array(*(F.struct(F.lit(c).alias("axis"), F.col(c).cast("long").alias("k")) for c in columns))).alias("x"))
    distinct = each.select("x.*").where("k is not null").distinct().withColumn("chunk", F.floor(F.col("k") / chunk))
    inside = distinct.withColumn("gap", F.col("k") - F.lag("k").over(Window.partitionBy("axis", "chunk").orderBy("k")))
    chunks = inside.groupBy("axis", "chunk").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.min("gap").alias("gap"))
    between = F.col("low") - F.lag("high").over(Window.partitionBy("axis").orderBy("chunk"))  # a row a chunk
    gaps = chunks.withColumn("gap", F.least("gap", between))
    return gaps.groupBy("axis").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.coalesce(F.min("gap"), F.lit(1)).alias("step"))


def scan(keys: DataFrame, columns: tuple[str, ...] = ("iline", "xline"), steps: tuple[int | None, ...] | None = None) -> Geometry:
    """Geometry of any survey, sorted or not. A step that isn't given is inferred; keys off the grid raise."""
    steps = steps or (None,) * len(columns)
    if any(s is not None and s < 1 for s in steps):
        raise ValueError("steps must be positive")
    rows = {r["axis"]: r for r in key_axes(keys, columns).collect()}  # one row each
    if len(rows) < len(columns):
        raise ValueError("no traces")
    axes = [Axis(int(rows[c]["low"]), int(rows[c]["high"]), int(step or rows[c]["step"])) for c, step in zip(columns, steps, strict=True)]
    number = F.max("trace_idx") if "trace_idx" in keys.columns else F.lit(None).cast("long")
    cells = keys.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), number.alias("number"))
    place = F.lit(0).cast("long")
    for c, a in zip(columns, axes, strict=True):
        place = place * a.size + F.floor((F.col(c) - a.low) / a.step)
    off = [F.max(((F.col(c) - a.low) % a.step != 0).cast("int")).alias(f"off_{c}") for c, a in zip(columns, axes, strict=True)]
    facts = cells.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"), F.min(F.coalesce(F.col("number") == place, F.lit(False))).alias("in_order"), *off).first()
    for c in columns:
        if facts[f"off_{c}"]:
            raise ValueError(f"some {c} isn't on the grid of its step")
    regular = facts["n"] == facts["cells"] == math.prod(a.size for a in axes)
    return Geometry(tuple(axes), facts["n"], regular, regular and facts["in_order"])


def line_index(keys: DataFrame, istep: int) -> DataFrame:
    """One row for every inline from the first to the last: line_num, crossline_start, crossline_end, trace_start, trace_end, count (0 if missing)."""
    lines = keys.groupBy(F.col("iline").alias("line_num")).agg(
        F.min_by("xline", "trace_idx").alias("crossline_start"),
        F.max_by("xline", "trace_idx").alias("crossline_end"),
        F.min("trace_idx").alias("trace_start"),
        F.max("trace_idx").alias("trace_end"),
        F.count(F.lit(1)).alias("count"),
    )
    every = keys.agg(F.min("iline").alias("a"), F.max("iline").alias("b")).select(F.explode(F.sequence("a", "b", F.lit(istep))).alias("line_num"))
    return every.join(lines, "line_num", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def intervals(index: DataFrame, ends: DataFrame, istep: int, xstep: int) -> DataFrame:
    """One row (x_interval, i_interval) in coordinate units.

    ``ends`` is (trace_idx, x_coord, y_coord). The crossline interval is taken
    along the first line from an eighth of all on that has six traces, the
    inline interval between that line's and the last line's first traces, at a
    right angle to the first.
    """
    place = F.row_number().over(Window.orderBy("line_num")) - 1  # one row a line
    lines = index.withColumn("place", place)
    n = lines.agg(F.count(F.lit(1)).alias("n"))
    at = ends.select(F.col("trace_idx"), F.col("x_coord").cast("double").alias("x"), F.col("y_coord").cast("double").alias("y"))
    near = lines.crossJoin(F.broadcast(n)).where(F.col("count") > 0)
    near = near.join(at.toDF("trace_start", "x0", "y0"), "trace_start").join(at.toDF("trace_end", "x1", "y1"), "trace_end")
    pick = near.where((F.col("place") >= F.floor(F.col("n") / 8)) & (F.col("count") >= 6)).orderBy("place").limit(1)
    last = near.orderBy(F.desc("place")).limit(1).select(F.col("x0").alias("lx"), F.col("y0").alias("ly"), F.col("line_num").alias("last_line"), F.col("crossline_start").alias("last_xl"))
    along = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)) / F.abs(F.col("crossline_end") - F.col("crossline_start")) * xstep
    span = F.pow(F.col("lx") - F.col("x0"), 2) + F.pow(F.col("ly") - F.col("y0"), 2)
    shift = F.pow(F.col("x_interval") * (F.col("last_xl") - F.col("crossline_start")) / xstep, 2)
    return (
        pick.withColumn("x_interval", along).crossJoin(last)
        .select("x_interval", (F.sqrt(span - shift) / (F.abs(F.col("last_line") - F.col("line_num")) / istep)).alias("i_interval"))
    )


def previous(keys: DataFrame, columns: list[str], chunk: int = 100_000) -> DataFrame:
    """Each trace with the columns of the trace before it (prev_<column>), chunk by chunk, so no task sees the whole file.

    A chunk's first trace gets its neighbour from one extra row that the chunk
    before hands on.
    """
    rows = keys.select("trace_idx", *columns).withColumn("chunk", F.floor(F.col("trace_idx") / chunk))
    handed = rows.where(F.col("trace_idx") % chunk == chunk - 1).withColumn("chunk", F.col("chunk") + 1).withColumn("extra", F.lit(True))
    both = rows.withColumn("extra", F.lit(False)).unionByName(handed)
    w = Window.partitionBy("chunk").orderBy("trace_idx")
    return both.select("trace_idx", "extra", *columns, *(F.lag(c).over(w).alias(f"prev_{c}") for c in columns)).where("not extra").drop("extra")


def violations(keys: DataFrame, kind: str) -> DataFrame:
    """Traces that break the order of a sorted prestack file: (trace_idx, key, prev).

    'iline': inlines must not fall; 'xline': nor crosslines inside an inline;
    'offset': offsets must rise inside an inline and crossline.
    """
    inside = {"iline": [], "xline": ["iline"], "offset": ["iline", "xline"]}[kind]
    rows = previous(keys, [*inside, kind])
    bad = F.col(kind) <= F.col(f"prev_{kind}") if kind == "offset" else F.col(kind) < F.col(f"prev_{kind}")
    for c in inside:
        bad = bad & (F.col(c) == F.col(f"prev_{c}"))
    return rows.where(bad).select("trace_idx", F.col(kind).alias("key"), F.col(f"prev_{kind}").alias("prev"))


def scan_prestack(keys: DataFrame) -> Geometry:
    """Geometry (iline, xline, offset) of a sorted prestack survey; raises where offsets don't rise inside a gather."""
    for kind in ("iline", "xline", "offset"):
        first = violations(keys, kind).orderBy("trace_idx").first()
        if first is not None:
            raise ValueError(f"{kind} isn't in order at trace {first['trace_idx']}")
    return scan(keys, ("iline", "xline", "offset"))


def sampled_range(traces: DataFrame, trace_count: int, exact: bool = False, part: int = 4000) -> DataFrame:
    """One row (low, high) of the samples: of three ranges of ``part`` traces, or of all if exact or if there are fewer than 6000."""
    rows = traces
    if not exact and trace_count >= 6000:
        third = trace_count // 3
        t = F.col("trace_idx")
        rows = traces.where((t < part) | (t >= trace_count - part) | ((t >= third) & (t < third + part)))
    return rows.agg(F.min(F.array_min("samples")).alias("low"), F.max(F.array_max("samples")).alias("high"))


# ---- guessing key locations from a few probes ----


def plausible_xline(first: int, last: int, middle: list[int], trace_count: int) -> bool:
    """Whether a column can hold crosslines: a short range, ten mid values without negatives and with one repeat at most."""
    repeats = sum(a == b for a, b in zip(middle, middle[1:]))
    return last - first <= trace_count // 2 and len(middle) == 10 and min(middle) >= 0 and repeats <= 1


def plausible_iline(first: int, mid: int, last: int, trace_count: int) -> bool:
    """Whether a column can hold inlines: three different values, in order, within a tenth of the trace count."""
    probes = (first, mid, last)
    if min(probes) < 0 or len(set(probes)) < 3:
        return False
    return max(probes) - min(probes) <= min(trace_count // 10 - 1, 100_000) and mid not in (max(probes), min(probes))


def probe_xstep(read) -> int:
    """Crossline step from ten values about the middle; ``read(shift)`` gives those from ``shift`` on. 0 if unclear."""
    for shift in (0, None):
        values = read(shift or 0) if shift is not None else read(drop + 1)
        gaps = [b - a for a, b in zip(values, values[1:])]
        if gaps and min(gaps) > 0:
            return min(gaps)
        falls = [k for k, g in enumerate(gaps) if g <= 0]
        if shift is None or len(falls) != 1:
            return 0
        drop = falls[0]
    return 0


def probe_istep(changes: list[int]) -> int:
    """Inline step from three successive inlines after the middle; 0 unless both steps agree."""
    if len(changes) < 3:
        return 0
    a, b, c = changes[:3]
    return b - a if b - a == c - b else 0
