"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text becomes tokens (words in lower case, runs of other signs, and marks for
upper case and for repeats of the word before), the tokens become hashed
unigrams and bigrams, and a document scores as the sparse dot product of its
scaled counts with the weights. Training is online and runs in one task over a
bounded sample of labelled documents (``SAMPLE``), in hash order, so only the
weights are ever held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Labelled documents of each class that training reads at most, and hash bits.
SAMPLE, BITS = 3000, 18
#: Training goes over its sample until it has made so many updates, at least twice and at most MOST times.
UPDATES, MOST = 24_000, 24
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 1e-4
#: predicted is 1 from here on
THRESHOLD = 0.7
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MARKS = {"upper": 1, "repeat": 2, "bias": 3, "empty": 4}


class _Hashes(dict):
    """Lower-cased token -> 64-bit hash; forgets all when ``LIMIT`` are known."""

    LIMIT = 500_000

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[token] = xxhash.xxh64_intdigest(token.lower())
        return value


def features(texts: list[str], hashes: dict, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indexes, values) of each text; values have length 1 (as a vector). An empty text has the two marks only."""
    out = []
    for text in texts:
        tokens = _TOKEN.findall(text)
        n = len(tokens)
        if n:
            h = np.fromiter(map(hashes.__getitem__, tokens), dtype=np.uint64, count=n)
            upper = sum(map(str.isupper, tokens))
            same = int((h[1:] == h[:-1]).sum())
            pairs = (h[:-1] * _A) ^ (h[1:] * _B)
            grams = np.concatenate([h, pairs * _A])
            index, counts = np.unique((grams * _B) >> np.uint64(64 - bits), return_counts=True)
            values = 1.0 + np.log(counts)
            values /= np.sqrt((values**2).sum())
            extra, weights = [_MARKS["bias"], _MARKS["upper"], _MARKS["repeat"]], [1.0, upper / n, same / n]
        else:
            index, values = np.empty(0, dtype=np.uint64), np.empty(0)
            extra, weights = [_MARKS["bias"], _MARKS["empty"]], [1.0, 1.0]
        out.append((np.concatenate([np.array(extra, dtype=np.int64), index.astype(np.int64) + 8]), np.concatenate([weights, values])))
    return out


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 8), np.zeros((1 << bits) + 8)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, index: np.ndarray, values: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(index)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -30, 30)))
        g = weight * (p - label) * values
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[index] = n + g * g


@dataclass
class Model:
    weights: np.ndarray
    bits: int


def _drawn(rows: DataFrame, by: Column, sizes: dict[int, int], sample: int) -> DataFrame:
    """``sample`` rows of each label at most, those with the smallest hash, which is added as ``draw``."""
    rate = F.coalesce(*(F.when(F.col("label") == k, min(1.0, 1.2 * sample / n)) for k, n in sorted(sizes.items())), F.lit(0.0))
    own = rows.withColumn("draw", F.pmod(by, F.lit(1 << 30))).where(F.col("draw") < rate * (1 << 30)).dropDuplicates(["doc_id", "label", "draw"])  # equal rows count once
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw", "doc_id"))  # about 1.2 * sample rows
    return own.withColumn("place", place).where(F.col("place") <= sample).drop("place")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, updates: int = UPDATES, bits: int = BITS, seed: int = 10) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1); other labels are left out, null texts are empty.

    Label rows that repeat count once; a document with both labels is an
    example of each. Of each class ``sample`` labels at most are drawn, and of
    the rows that have their ids (ids may repeat) again ``sample`` at most.
    """
    rows = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    if not sizes:
        return Model(np.zeros((1 << bits) + 8, dtype=np.float32), bits)
    drawn = _drawn(rows, F.xxhash64("doc_id", F.lit(seed)), sizes, sample)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn.select("doc_id", "label")), "doc_id")  # at most 2 * sample rows
    met = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}  # two rows
    chosen = _drawn(own, F.xxhash64("doc_id", "text", F.lit(seed)), met, sample).select("draw", "doc_id", "text", "label")
    have = {k: min(n, sample) for k, n in sizes.items()}
    # rows of a class stand for as many as it has: scores follow the labels' own balance
    weight = {k: n / have[k] * sum(have.values()) / sum(sizes.values()) for k, n in sizes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, learner, seen = _Hashes(), Ftrl(bits), []
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                index, values = features([text.as_py()], hashes, bits)[0]
                label = label.as_py()
                learner.learn(index, values, label, weight[label])
                seen.append((index.astype(np.int32), values.astype(np.float32), label))
        for _ in range(min(MOST, max(2, updates // max(1, len(seen)))) - 1):
            for index, values, label in seen:
                learner.learn(index, values.astype(np.float64), label, weight[label])
        yield pa.RecordBatch.from_arrays([pa.array([learner.weights().astype(np.float32).tobytes()], type=pa.binary())], names=["weights"])

    got = chosen.repartition(1).sortWithinPartitions("draw", "doc_id").select("text", "label").mapInArrow(run, "weights binary").collect()  # the weights
    if not got:  # no labelled document
        return Model(np.zeros((1 << bits) + 8, dtype=np.float32), bits)
    return Model(np.frombuffer(got[0][0], dtype=np.float32), bits)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score in 0..1. Null text counts as empty and is scored like an empty one; other columns are not read."""
    own: list[_Hashes] = []

    def run(ids: list, texts: list[str]) -> dict:
        if not own:
            own.append(_Hashes())
        margins = [float(model.weights[i] @ v) for i, v in features(texts, own[0], model.bits)]
        return {"doc_id": ids, "score": 1 / (1 + np.exp(-np.clip(margins, -30, 30)))}

    return common.map_blocks(docs, run, "doc_id long, score double", id_col, text_col)


def held_out() -> F.Column:
    return common.crc_mod(F.col("doc_id"), 4) == 2


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels of rows that are not held out; score all: doc_id, held_out, score, predicted."""
    known = labels.where(F.coalesce(~held_out(), F.lit(False)) & F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    model = train(docs, known)
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
