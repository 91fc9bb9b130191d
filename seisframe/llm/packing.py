"""Packing token sequences by non-negative least squares over shallow length combinations.

Each document's ids are cut into whole windows and a rest. The rests' length
histogram over all documents is matched by all combinations of two or three
lengths that fill a window exactly: their repeat counts solve one non-negative
least-squares problem for the whole corpus and are rounded once. Every length
so has a quota of rests that stand in filled windows. A rest's rank among the
rests of its length decides its window; ranks come from a running sum over the
counts of each task, so no task sees all rests and no ids are shuffled, only
five numbers for each document. Rests beyond the quotas are packed greedily,
end to end, cutting at window ends, where they are scanned; each task's last,
shorter run is cut into powers of two, which need no padding.

The driver holds the histogram and quotas (a number for each length below the
window) and the solution (at most a number for each combination).
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, vocabulary

WINDOW, END_ID = 1024, 0
#: Rounds of the solver.
ROUNDS = 150
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
#: Sequence ids start here for windows filled by combinations, and for those packed end to end.
FILLED, RESIDUAL = 1 << 60, 1 << 61


class ByteTokenizer:
    """Ids of the ``tokenizers`` library for byte_bpe_50k.json, no special tokens added.

    The library gets each word (pre-token) once and not each occurrence, many
    words in one call with a special token between them. Texts that hold such a
    token's string, or a character that the library and ``regex`` class
    differently, go to the library whole.
    """

    #: Words kept between calls, and the longest that is kept (both bound memory only).
    KEPT, LONGEST = 500_000, 64
    #: The vocabulary's pre-tokens; the order of branches that can't both match differs from its own. The second is the same for ASCII texts.
    WORD = regex.compile(r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    ASCII = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)

    def __init__(self, folder: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary.path(vocabulary.BYTE_BPE, folder))
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.mark, self.mark_id = self.special[0], self.exact.token_to_id(self.special[0])
        vocabulary_of = self.exact.get_vocab()
        self.id_bytes = np.zeros(max(vocabulary_of.values()) + 1, dtype=np.int64)
        for token, i in vocabulary_of.items():  # a byte is one character there
            self.id_bytes[i] = len(token)
        self.known: dict[str, bytes] = {}
        self.agreed: set[str] = set()
        self.odd: set[str] = set()

    def _whole(self, text: str) -> bytes:
        return np.array(self.exact.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _same_words(self, text: str) -> bool:
        """Whether both libraries put all characters of the text into the same classes."""
        own = set(text)
        for c in own - self.agreed - self.odd:
            probe = f"a{c}a 1{c}1 .{c}. {c}{c}\n{c}"
            ends = np.cumsum([len(w) for w in self.WORD.findall(probe)]).tolist()
            (self.agreed if ends == [e for _, (_, e) in self.exact.pre_tokenizer.pre_tokenize_str(probe)] else self.odd).add(c)
        return own.isdisjoint(self.odd)

    def _words(self, text: str) -> list[str] | None:
        """The text's pre-tokens; None if the library has to find them."""
        if any(m in text for m in self.special):
            return None
        if text.isascii():
            return self.ASCII.findall(text)
        return self.WORD.findall(text) if self._same_words(text) else None

    def _learn(self, words: list[str]) -> None:
        alone = []
        plain = []
        for w in words:
            (plain if w[0] == " " and w[1:].isalpha() else alone).append(w)
        for i in range(0, len(plain), 1000):  # each begins with a space, so that they stay apart without a mark
            part = plain[i : i + 1000]
            ids = np.array(self.exact.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            sizes = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in part])
            self._keep(part, ids.tobytes(), (4 * (np.searchsorted(np.cumsum(self.id_bytes[ids]), sizes) + 1)).tolist(), 0)
        for i in range(0, len(alone), 1000):
            part = alone[i : i + 1000]
            ids = np.array(self.exact.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            self._keep(part, ids.tobytes(), [*(4 * np.flatnonzero(ids == self.mark_id)).tolist(), 4 * len(ids)], 4)

    def _keep(self, words: list[str], raw: bytes, ends: list[int], gap: int) -> None:
        self.known.update(zip(words, (raw[a:b] for a, b in zip([0, *(e + gap for e in ends)], ends)), strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self._words(t) for t in texts]
        if len(self.known) > self.KEPT:
            self.known.clear()
        known = self.known
        new = [w for w in set().union(*(own for own in split if own)) if w not in known]
        long = [w for w in new if len(w) > self.LONGEST]
        self._learn([w for w in new if len(w) <= self.LONGEST])
        for w in long:
            self.known[w] = self._whole(w)
        out = [self._whole(t) if own is None else b"".join(map(self.known.__getitem__, own)) for t, own in zip(texts, split, strict=True)]
        for w in long:
            del self.known[w]
        return out


@lru_cache(maxsize=1)
def tokenizer(folder: str | None = None) -> ByteTokenizer:
    return ByteTokenizer(folder)


def tokenised(docs: DataFrame, folder: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, ids those of the text and END_ID; null text counts as empty.

    Columns: doc_id, n_tokens, first_window (sequence id of its first whole
    window), crcs (of each whole window), rest_len, rest (ids after the whole
    windows), rest_crc, part and nth (the task, and the place there among
    rests of that length).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part = tokenizer(folder), TaskContext.get().partitionId()
        windows, seen, end = part << 36, [0] * window, END_ID.to_bytes(4, "little")
        for ids, texts in common.blocks(batches):
            cols: list[list] = [[] for _ in range(9)]
            for doc, row in zip(ids, own.encode_all(texts), strict=True):
                row += end
                whole, left = divmod(len(row) // 4, window)
                rest = row[len(row) - 4 * left :]
                crcs = [zlib.crc32(row[k : k + 4 * window]) for k in range(0, 4 * window * whole, 4 * window)]
                for c, v in zip(cols, (doc, len(row) // 4, windows, crcs, left, rest, zlib.crc32(rest), part, seen[left]), strict=True):
                    c.append(v)
                windows += whole
                seen[left] += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_tokens", "first_window", "crcs", "rest_len", "rest", "rest_crc", "part", "nth"])
        common.release()

    schema = "doc_id long, n_tokens long, first_window long, crcs array<long>, rest_len int, rest binary, rest_crc long, part int, nth long"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def combinations(window: int = WINDOW) -> np.ndarray:
    """Rows of three lengths (0 for none) that fill the window: all pairs and all triples."""
    rows = [np.array([(a, window - a, 0) for a in range(1, window // 2 + 1)])]
    for a in range(1, window // 3 + 1):
        b = np.arange(a, (window - a) // 2 + 1)
        rows.append(np.stack([np.full(len(b), a), b, window - a - b], axis=1))
    return np.concatenate(rows).astype(np.int64)


def solve(histogram: np.ndarray, parts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 with least ||A x - histogram||, by multiplicative updates; A counts lengths in each combination."""
    want = histogram.astype(float).copy()
    want[0] = 0
    size = len(want)
    usable = ((parts == 0) | (want[parts] > 0)).all(axis=1)
    out = np.zeros(len(parts))
    parts = parts[usable]
    if not len(parts):
        return out
    weight = (parts > 0).astype(float)
    x = np.full(len(parts), want.sum() / len(parts) / 2)
    top = (want[parts] * weight).sum(axis=1)
    for _ in range(rounds):
        made = np.bincount(parts.ravel(), (x[:, None] * weight).ravel(), size)
        below = (made[parts] * weight).sum(axis=1)
        x = np.where(below > 0, x * top / np.maximum(below, 1e-300), 0.0)
    out[usable] = x
    return out


def rounded(x: np.ndarray, parts: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeat counts near x that no length has too few rests for.

    First the whole part of each count, then one more by falling fraction, and
    at last as many more as still fit; afterwards no combination fits.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out = np.zeros(len(parts), dtype=np.int64)
    whole = np.floor(x).astype(np.int64)
    everything = np.full(len(parts), int(left.sum()))
    for order, most in ((np.argsort(-x, kind="stable"), whole), (np.argsort(whole - x, kind="stable"), (x > whole).astype(np.int64)), (np.argsort(-x, kind="stable"), everything)):
        fits = ((parts == 0) | (left[parts] > 0)).all(axis=1) & (most > 0)
        for c in order[fits[order]].tolist():
            own = [int(p) for p in parts[c] if p]
            times = min(int(most[c]), *(int(left[p]) // own.count(p) for p in set(own)))
            if times > 0:
                out[c] += times
                for p in own:
                    left[p] -= times
    return out


class Slots:
    """Where the rests of each length go: a rank below the length's quota names a window and an offset."""

    def __init__(self, parts: np.ndarray, times: np.ndarray, window: int):
        used = times > 0
        parts, times = parts[used], times[used]
        first = np.cumsum(times) - times
        length, count, window_at, offset = [], [], [], []
        for k in range(3):
            real = parts[:, k] > 0
            length.append(parts[real, k])
            count.append(times[real])
            window_at.append(first[real])
            offset.append(parts[real, :k].sum(axis=1))
        length, count, window_at, offset = map(np.concatenate, (length, count, window_at, offset))
        order = np.argsort(length, kind="stable")
        self.length, self.count, self.window_at, self.offset = length[order], count[order], window_at[order], offset[order]
        self.quota = np.bincount(length, count, window).astype(np.int64)[:window]
        total = np.cumsum(self.count) - self.count  # slots before each row, over all lengths
        begin = np.concatenate([[0], np.cumsum(self.quota)])
        self.begin, self.total = begin, total

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence id, offset) of rests whose rank is below their length's quota."""
        place = self.begin[length] + rank
        row = np.searchsorted(self.total, place, side="right") - 1
        return FILLED + self.window_at[row] + place - self.total[row], self.offset[row]


class EndToEnd:
    """Fills windows with ids from one task, cutting rests at window ends."""

    def __init__(self, partition: int, window: int):
        self.sequence, self.window = RESIDUAL | partition << 32, window
        self.held: list[tuple] = []  # (doc, start, ids, total), less than a window together
        self.size = 0
        self.out: list[tuple] = []

    def _emit(self, length: int) -> None:
        offset = 0
        while offset < length:
            doc, start, ids, total = self.held.pop(0)
            take = ids[: length - offset]
            self.out.append((doc, start, len(take), zlib.crc32(take.tobytes()), total, self.sequence, offset, length))
            offset += len(take)
            if len(take) < len(ids):
                self.held.insert(0, (doc, start + len(take), ids[len(take) :], total))
        self.size -= length
        self.sequence += 1

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        self.held.append((doc, start, ids, total))
        self.size += len(ids)
        while self.size >= self.window:
            self._emit(self.window)

    def finish(self) -> None:
        while self.size:
            self._emit(1 << (self.size.bit_length() - 1))


def _filled(meta: DataFrame, slots: Slots, window: int) -> DataFrame:
    """Pieces of the rests (doc_id, n_tokens, rest_len, rest_crc, rank) below the quotas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(2).to_numpy().astype(np.int64), batch.column(4).to_numpy()
            good = rank < slots.quota[length]
            keep = batch.filter(pa.array(good))
            sequence, offset = slots.find(length[good], rank[good])
            total, length = keep.column(1).to_numpy(), length[good]
            arrays = [keep.column(0), pa.array(total - length), pa.array(length), keep.column(3), pa.array(total), pa.array(sequence), pa.array(offset), pa.array(np.full(len(total), window))]
            yield pa.RecordBatch.from_arrays([a.cast(pa.int64()) for a in arrays], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return meta.select("doc_id", "n_tokens", "rest_len", "rest_crc", "rank").mapInArrow(run, SCHEMA)


def _residual(rows: DataFrame, window: int) -> DataFrame:
    """Pieces of the rests (doc_id, n_tokens, rest) that no combination takes, packed where they are read."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = EndToEnd(TaskContext.get().partitionId(), window)

        def emit() -> pa.RecordBatch:
            cols = list(zip(*packer.out, strict=True)) or [[]] * len(names)
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=names)

        for batch in batches:
            for doc, total, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(rest, dtype="<u4")
                packer.add(doc, total - len(ids), ids, total)
            yield emit()
        packer.finish()
        yield emit()

    return rows.select("doc_id", "n_tokens", "rest").mapInArrow(run, SCHEMA)


def pack(docs: DataFrame, folder: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length.

    Null text counts as empty and gives the single id 0. Every row is packed,
    also those with a null or repeated id. An empty table gives no pieces.
    Columns besides id and text are not read.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    spark = docs.sparkSession
    tokens = common.staged(tokenised(docs, folder, window, id_col, text_col), "tokens")
    has_rest = tokens.where("rest_len > 0")
    counts = common.staged(has_rest.groupBy("part", "rest_len").agg(F.count(F.lit(1)).alias("n")), "rest-counts")
    histogram = np.zeros(window, dtype=np.int64)
    for n, count in counts.groupBy("rest_len").agg(F.sum("n")).collect():  # fewer rows than the window is long
        histogram[n] = count
    parts = combinations(window)
    slots = Slots(parts, rounded(solve(histogram, parts), parts, histogram), window)
    # the rests of a length in an order of tasks that differs from length to length: what the quotas leave is spread over all tasks
    order = [F.xxhash64("part", "rest_len"), F.col("part")]
    before = F.coalesce(F.sum("n").over(Window.partitionBy("rest_len").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("base", before)
    whole = tokens.where(F.size("crcs") > 0).select("doc_id", "n_tokens", "first_window", F.posexplode("crcs").alias("k", "crc"))
    k, size = F.col("k").cast("long"), F.lit(window).cast("long")
    whole = whole.select("doc_id", (k * window).alias("start"), size.alias("length"), F.col("crc").alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"), (F.col("first_window") + k).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), size.alias("sequence_length"))
    meta = has_rest.select("doc_id", "n_tokens", "rest_len", "rest_crc", "part", "nth").join(ranked.select("part", "rest_len", "base"), ["part", "rest_len"])
    filled = _filled(meta.withColumn("rank", F.col("base") + F.col("nth")), slots, window)
    quotas = spark.createDataFrame([(n, int(q)) for n, q in enumerate(slots.quota.tolist())], "rest_len int, quota long")
    # where in the order of its tasks a length's quota ends; no row for a length that is used up
    ends = ranked.join(F.broadcast(quotas), "rest_len").where("base <= quota and quota < base + n")  # quotas: a row for each length below the window
    ends = ends.select("rest_len", F.xxhash64("part", "rest_len").alias("end_order"), F.col("part").alias("end_part"), (F.col("quota") - F.col("base")).alias("end_nth"))
    ends = spark.createDataFrame([tuple(r) for r in ends.collect()], "rest_len int, end_order long, end_part int, end_nth long")  # at most one row for each length
    over = F.struct(F.xxhash64("part", "rest_len"), "part", "nth") >= F.struct("end_order", "end_part", "end_nth")
    residual = has_rest.join(F.broadcast(ends), "rest_len").where(over)
    return whole.union(filled).union(_residual(residual, window))
