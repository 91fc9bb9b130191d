"""Audio fingerprints from pitch classes, and their alignment.

A recording is cut into overlapping frames; each frame's spectrum is folded
into twelve pitch classes, smoothed over time and scaled. Rectangles of the
frame-by-class picture are summed by an integral image; sixteen filters compare
two areas each, and every filter's two-bit answer is packed into one integer
for each position. Two recordings are aligned by a histogram of offsets that sums
the bits in which their integers differ, and judged by the share of such bits
over the overlap. The histogram covers every offset, so no match is missed.

Recordings with equal fingerprints are one class. The queries (a stated part
of the rows) are searched in blocks of bounded size against all classes, and
each block's hits are written before the next begins. Comparing one query with
one recording at all offsets takes a few microseconds; joining them on packed
integers, or on parts of them, would meet most pairs several times over, as
neighbouring frames and quiet passages repeat the same integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Samples a second after folding down, frame length and step in seconds, and the range of pitches in Hz.
RATE, FRAME, STEP, LOW, HIGH = 5512, 0.3716, 0.1238, 55.0, 1760.0
#: Overlap at least (the whole of a shorter recording), and the share of wrong bits up to which recordings match.
OVERLAP, ERRORS = 12, 0.2
#: Queries searched together, and about how many places of theirs are compared at once (both bound memory only).
BLOCK, PLACES = 20_000, 32_768
#: Filters: kind, first class, height (classes), width (positions). Kinds: 0 whole against nothing, 1 upper against
#: lower half, 2 earlier against later half, 3 crossed quarters, 4 middle against outer classes, 5 middle against outer positions.
WIDTH = 12
FILTERS = tuple((k % 6, (5 * k) % 8, 4 if k % 6 == 3 else (3, 6, 4)[k % 3] if k % 6 != 4 else 3, (4, 8, 12, 6)[k % 4] if k % 6 != 5 else (6, 12)[k % 2]) for k in range(16))
#: Answers are split at these values.
SPLIT = (-0.12, 0.0, 0.12)
_GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)


@lru_cache(maxsize=8)
def _spectrum(size: int, rate: int) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """Length of the transform, range of its rows inside the pitches, their pitch classes (rows, 12), and the frame's window."""
    length = 1 << (size - 1).bit_length()
    hertz = np.fft.rfftfreq(length, 1 / rate)
    inside = np.flatnonzero((hertz >= LOW) & (hertz <= HIGH))
    note = np.round(12 * np.log2(hertz[inside] / 440.0)).astype(int) % 12
    return length, int(inside[0]), int(inside[-1]) + 1, np.eye(12)[note], np.hanning(size).astype(np.float32)


def pitch_classes(samples: np.ndarray, rate: int) -> np.ndarray:
    """Smoothed, scaled energies (frames, 12)."""
    size, step = int(FRAME * rate), int(STEP * rate)
    if len(samples) < size:
        return np.empty((0, 12))
    length, first, last, fold, window = _spectrum(size, rate)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), size)[::step]
    spectrum = np.fft.rfft(frames * window, length, axis=1)[:, first:last]
    chroma = (spectrum.real**2 + spectrum.imag**2).astype(np.float64) @ fold
    smooth = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
    if len(chroma) < len(smooth):
        return np.empty((0, 12))
    chroma = sum(w * chroma[i : len(chroma) - len(smooth) + 1 + i] for i, w in enumerate(smooth))
    norm = np.sqrt((chroma**2).sum(axis=1, keepdims=True))
    return np.divide(chroma, norm, out=np.zeros_like(chroma), where=norm > 1e-9)


def packed(pictures: np.ndarray) -> np.ndarray:
    """Packed integers (uint32), one for each position, of equally long pictures (pictures, frames, 12)."""
    n = max(0, pictures.shape[1] - WIDTH + 1)
    integral = np.zeros((len(pictures), pictures.shape[1] + 1, 13))
    integral[:, 1:, 1:] = pictures.cumsum(axis=1).cumsum(axis=2)

    def area(a: int, b: int, c: int, d: int) -> np.ndarray:
        """Sums over positions a..b and classes c..d from each position on."""
        return integral[:, b : b + n, d] - integral[:, a : a + n, d] - integral[:, b : b + n, c] + integral[:, a : a + n, c]

    out = np.zeros((len(pictures), n), dtype=np.uint32)
    for kind, c, h, w in FILTERS:
        d = c + h
        whole = area(0, w, c, d)
        if kind == 0:
            first, second = whole, np.full_like(whole, w * h * 0.2)
        elif kind == 1:
            first = area(0, w, c, c + h // 2)
            second = whole - first
        elif kind == 2:
            first = area(0, w // 2, c, d)
            second = whole - first
        elif kind == 3:
            first = area(0, w // 2, c, c + h // 2) + area(w // 2, w, c + h // 2, d)
            second = whole - first
        elif kind == 4:
            first = area(0, w, c + h // 3, d - h // 3)
            second = whole - first
        else:
            first = area(w // 3, w - w // 3, c, d)
            second = whole - first
        answer = np.log1p(first) - np.log1p(second)
        out = (out << np.uint32(2)) | _GRAY[np.searchsorted(SPLIT, answer)]
    return out


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """The packed integers of one recording; none if it is too short."""
    return packed(pitch_classes(samples, rate)[None])[0]


def fingerprint_all(recordings: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """``fingerprint`` of each recording, those of equal length together."""
    pictures = [pitch_classes(*r) for r in recordings]
    alike: dict[int, list[int]] = {}
    for k, picture in enumerate(pictures):
        alike.setdefault(len(picture), []).append(k)
    out: list[np.ndarray] = [np.empty(0, dtype=np.uint32)] * len(pictures)
    for own in alike.values():
        for k, items in zip(own, packed(np.stack([pictures[k] for k in own])), strict=True):
            out[k] = items
    return out


def read_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """(mono samples, rate) of 16-bit PCM; nothing for null or anything else."""
    import io
    import wave

    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            if w.getsampwidth() != 2:
                return np.empty(0), RATE
            samples = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, w.getnchannels()).mean(axis=1) / 32768
            rate = w.getframerate()
    except (wave.Error, EOFError):
        return np.empty(0), RATE
    fold = max(1, rate // RATE)  # averages of neighbours, to the rate at which frames are cut
    return samples[: len(samples) // fold * fold].reshape(-1, fold).mean(axis=1), rate // fold


def play(values: list[float] | None, note: float = 0.1) -> tuple[np.ndarray, int]:
    """A recording of numbers: a short tone for each, its pitch by the number. Null and missing numbers are silent."""
    if not values:
        return np.empty(0), RATE
    own = np.array([np.nan if v is None else v for v in values], dtype=float)
    steps = np.floor(np.clip(np.nan_to_num(own), -1, 1) * 30).astype(int)
    return np.concatenate([_tone(int(k), note) if there else np.zeros(int(note * RATE)) for k, there in zip(steps, np.isfinite(own), strict=True)]), RATE


@lru_cache(maxsize=256)
def _tone(step: int, note: float) -> np.ndarray:
    n = int(note * RATE)
    phase = 2 * np.pi * 220.0 * 2 ** (step / 12) * np.arange(n) / RATE
    return (np.sin(phase) + 0.4 * np.sin(2 * phase)) * np.hanning(n)


def fingerprints(media: DataFrame, id_col: str, media_col: str, decode: Callable[[object], tuple[np.ndarray, int]] = read_wav) -> DataFrame:
    """(id, n_items, items, sha256): items are the packed integers as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                items = [x.astype("<u4").tobytes() for x in fingerprint_all([decode(v.as_py()) for v in part.column(1)])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in items]), pa.array(items, type=pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in items])], names=["id", "n_items", "items", "sha256"]
                )

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col)).mapInArrow(run, "id long, n_items long, items binary, sha256 string")


class Layout:
    """Items of some queries in one row, so far apart that a recording of n items never overlaps two of them enough."""

    def __init__(self, items: list[np.ndarray], first: int, n: int):
        sizes = np.array([len(x) for x in items])
        need = np.minimum(min(OVERLAP, n), sizes)
        gap = n - int(need.min())
        start = gap + np.cumsum(sizes + gap) - sizes - gap
        self.count = int(start[-1] + sizes[-1])  # places at which a recording can begin
        row = np.zeros(self.count + n + 1, dtype=np.uint64)
        for at, x in zip(start.tolist(), items, strict=True):
            row[at : at + len(x)] = x
        self.single = row.astype(np.uint32)
        self.double = row[:-1] | row[1:] << np.uint64(32)
        # the places that belong to a query: from -gap on, which shares at least `need` items with it
        own = np.repeat(np.arange(len(items)), n + sizes - 2 * need + 1)
        ends = np.cumsum(n + sizes - 2 * need + 1)
        nth = np.arange(ends[-1]) - np.repeat(ends - (n + sizes - 2 * need + 1), n + sizes - 2 * need + 1)
        self.shift = (n - need)[own] - nth
        self.place = start[own] - self.shift
        self.a, self.b = np.maximum(0, self.shift), np.minimum(n, sizes[own] + self.shift)
        self.who = first + own

    def wrong_bits(self, items: np.ndarray) -> np.ndarray:
        """Bits in which a recording that begins at each of the places differs from the query there."""
        n = len(items)
        total = np.zeros(self.count, dtype=np.uint16 if 32 * n < 1 << 16 else np.uint32)
        apart, bits = np.empty(self.count, dtype=np.uint64), np.empty(self.count, dtype=np.uint8)
        wide = items.astype(np.uint64)
        pairs = wide[: n - 1 : 2] | wide[1::2] << np.uint64(32)
        for k, word in enumerate(pairs):
            np.bitwise_xor(self.double[2 * k : 2 * k + self.count], word, out=apart)
            np.bitwise_count(apart, out=bits)
            np.add(total, bits, out=total)
        if n % 2:
            total += np.bitwise_count(self.single[n - 1 : n - 1 + self.count] ^ items[-1])
        # items beside the query met zeros: their own bits were counted
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(items), dtype=np.int64)])
        return total[self.place] - (ones[n] - ones[self.b] + ones[self.a])


class QueryBlock:
    """Some queries, compared with recordings at every offset."""

    def __init__(self, ids: list[int], items: list[bytes]):
        own = [(i, x) for i, x in zip(ids, (np.frombuffer(x, dtype="<u4") for x in items), strict=True) if len(x)]
        self.ids, self.items = [i for i, _ in own], [x for _, x in own]
        self.layouts: tuple[int, list[Layout]] = (0, [])

    def _layouts(self, n: int) -> list[Layout]:
        """The queries dealt into rows of about ``PLACES`` places for recordings of n items; the last n is kept."""
        if self.layouts[0] != n:
            out, first, size = [], 0, 0
            for k, x in enumerate(self.items):
                size += len(x) + n
                if size >= PLACES or k == len(self.items) - 1:
                    out.append(Layout(self.items[first : k + 1], first, n))
                    first, size = k + 1, 0
            self.layouts = (n, out)
        return self.layouts[1]

    def search(self, items: np.ndarray) -> list[tuple[int, int, float]]:
        """(query id, offset, share of wrong bits) of the queries that match a recording; offset: recording minus query.

        Each offset with overlap enough is judged. Of a query's matches the one
        with the smallest share counts, then the longest overlap, then the smallest offset.
        """
        if not len(items):
            return []
        best: dict[int, tuple[float, int, int]] = {}
        for row in self._layouts(len(items)):
            share = row.wrong_bits(items) / (32 * (row.b - row.a))
            for k in np.flatnonzero(share <= ERRORS).tolist():
                q, hit = int(row.who[k]), (float(share[k]), int(row.a[k] - row.b[k]), int(row.shift[k]))
                best[q] = min(best.get(q, hit), hit)
        return [(self.ids[q], shift, wrong) for q, (wrong, _, shift) in best.items()]


def _found(classes: DataFrame, block: QueryBlock) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(sha, *hit) for sha, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in block.search(np.frombuffer(items, dtype="<u4"))]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["sha256", "query", "shift", "errors"])

    return classes.select("sha256", "items").mapInArrow(run, "sha256 string, query long, shift long, errors double")


def align(media: DataFrame, id_col: str, media_col: str, decode: Callable[[object], tuple[np.ndarray, int]] = read_wav, every: int = 100, block: int = BLOCK) -> DataFrame:
    """One row per recording: <id_col>, n_items, sha256, class_id, n_links, best_query, best_offset, best_errors.

    Queries are the rows whose id is divisible by ``every``; of equal
    fingerprints the query with the smallest id stands for all. n_links counts
    the query classes that match, a recording's own included; the best has the
    fewest wrong bits, then the smallest id. Null, broken and too short media
    have no items, form one class and match nothing. Rows with a null id take
    part but are never queries; columns besides id and media are not read.
    """
    found = common.staged(fingerprints(media, id_col, media_col, decode), "fingerprints")
    query = F.min(F.when((F.col("id") % every == 0) & (F.col("n_items") > 0), F.col("id"))).alias("query")
    classes = common.staged(found.groupBy("sha256", "items").agg(F.min("id").alias("class_id"), query), "classes")
    asked = classes.where("query is not null").select("query", "items")
    spark, last = found.sparkSession, None
    path = common.scratch(spark, "hits")
    schema = "sha256 string, query long, shift long, errors double"
    spark.createDataFrame([], schema).write.parquet(path)
    while True:
        rows = asked if last is None else asked.where(F.col("query") > last)
        some = rows.orderBy("query").limit(block).collect()  # a block of queries
        if not some:
            break
        last = some[-1]["query"]
        own = _found(classes.where(F.length("items") > 0), QueryBlock([r["query"] for r in some], [bytes(r["items"]) for r in some]))
        own.write.mode("append").parquet(path)
        if len(some) < block:
            break
    best = F.min(F.struct("errors", "query", "shift")).alias("best")
    links = spark.read.schema(schema).parquet(path).groupBy("sha256").agg(F.count(F.lit(1)).alias("n_links"), best)
    known = common.staged(classes.select("sha256", "class_id").join(links, "sha256", "left"), "links")
    return found.select("id", "n_items", "sha256").join(known, "sha256").select(
        F.col("id").alias(id_col), "n_items", "sha256", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("best.query").alias("best_query"), F.col("best.shift").alias("best_offset"), F.round("best.errors", 6).alias("best_errors"),
    )
