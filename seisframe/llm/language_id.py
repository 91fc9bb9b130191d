"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
The likelihood of a word is the sum over all its segmentations into pieces,
computed by the forward algorithm for all distinct words of a block at once;
words of a text are independent. Piece probabilities come from a few rounds of
expectation-maximisation over the words of a bounded, hash-chosen sample of
labelled documents (``SAMPLE`` for each language); tasks add up expected
counts, and the driver holds one probability for each piece and language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, vocabulary

#: Different labelled documents that training reads for each language at most, and its rounds.
SAMPLE, ROUNDS = 1500, 4
UNDETERMINED = "und"
#: Probability of a single character that is no piece.
_FLOOR = 1e-9
#: Words up to here need no scaling: _FLOOR ** PLAIN is a normal float. Pieces of words computed together (this bounds memory only).
PLAIN, CELLS = 32, 2_000_000
#: Expected counts are added up as whole multiples of 1 / UNIT, so that sums don't depend on their order.
UNIT = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased, each opened by the vocabulary's word mark."""
    return [vocabulary.SPACE + word for word in _LETTERS.findall(text.lower())]


@lru_cache(maxsize=2)
def lattice(file: str) -> Lattice:
    """Of all pieces that can stand in a marked word: letters, the mark, or the mark and letters."""
    texts = {p.text for p in vocabulary.piece_model(file).pieces if p.kind == vocabulary.NORMAL}
    return Lattice(sorted(t for t in texts if t == vocabulary.SPACE or t.removeprefix(vocabulary.SPACE).isalpha()))


@dataclass
class Lattice:
    """A vocabulary's pieces, found by a rolling hash, and sums over segmentations."""

    pieces: list[str]

    def __post_init__(self):
        from .piece_bpe import HashIndex

        self.longest = max(map(len, self.pieces), default=1)
        self.index = HashIndex(self._hash(self.pieces))

    @staticmethod
    def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h ^ code.astype(np.uint64)) * _MULT
        return h ^ (h >> np.uint64(29))

    def _hash(self, pieces: list[str]) -> np.ndarray:
        out = np.zeros(len(pieces), dtype=np.uint64)
        for n in range(1, self.longest + 1):
            own = [i for i, p in enumerate(pieces) if len(p) == n]
            if own:
                codes = np.frombuffer("".join(pieces[i] for i in own).encode("utf-32-le"), dtype=np.uint32).reshape(-1, n)
                h = np.full(len(own), n, dtype=np.uint64)
                for k in range(n):
                    h = self._step(h, codes[:, k])
                out[own] = h
        return (out >> np.uint64(1)).astype(np.int64)

    def edges(self, codes: np.ndarray) -> list[np.ndarray]:
        """For equally long words (a row each): [length - 1][:, start] is the piece there, -1 for none."""
        n, out = codes.shape[1], []
        for size in range(1, min(self.longest, n) + 1):
            h = np.full((len(codes), n - size + 1), size, dtype=np.uint64)
            for k in range(size):
                h = self._step(h, codes[:, k : n - size + 1 + k])
            out.append(self.index.find((h >> np.uint64(1)).astype(np.int64).ravel()).reshape(h.shape))
        return out

    def by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, codes) of words of equal length, a bounded number at once."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(sizes, kind="stable")
        for n, first, count in zip(*np.unique(sizes[order], return_index=True, return_counts=True), strict=True):
            per = max(1, CELLS // (int(n) * min(int(n), self.longest)))
            for a in range(first, first + count, per):
                at = order[a : min(first + count, a + per)]
                yield at, np.frombuffer("".join([words[i] for i in at]).encode("utf-32-le"), dtype=np.uint32).reshape(len(at), n)

    def forward(self, edges: list[np.ndarray], prob: np.ndarray) -> np.ndarray:
        """[j]: log of the sum over segmentations of the first j characters, by word and language. prob has a last row, 0, for no piece.

        Long words keep the sums of earlier positions as multiples of the last one.
        """
        rows, n = edges[0].shape
        shape = (rows, prob.shape[1])
        if n <= PLAIN:
            alpha = np.zeros((n + 1, *shape))
            alpha[0] = 1
            for j in range(1, n + 1):
                alpha[j] = alpha[j - 1] * np.maximum(prob[edges[0][:, j - 1]], _FLOOR)
                for size in range(2, min(len(edges), j) + 1):
                    alpha[j] += alpha[j - size] * prob[edges[size - 1][:, j - size]]
            return np.log(alpha)
        out = np.zeros((n + 1, *shape))
        ratio = np.zeros((len(edges), *shape))  # [s - 1]: the sum s characters before over the last one
        ratio[0] = 1
        for j in range(1, n + 1):
            most = min(len(edges), j)
            p = prob[np.stack([edges[s - 1][:, j - s] for s in range(1, most + 1)])]
            p[0] = np.maximum(p[0], _FLOOR)
            gain = (ratio[:most] * p).sum(axis=0)
            out[j] = out[j - 1] + np.log(gain)
            ratio[1:] = ratio[:-1] / gain
            ratio[0] = 1
        return out

    def log_likelihood(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        out = np.empty((len(words), prob.shape[1]))
        for at, codes in self.by_length(words):
            out[at] = self.forward(self.edges(codes), prob)[-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """How often each piece stands in the words' segmentations, by language (pieces + 1 rows), for word counts (words x languages)."""
        seen = np.zeros_like(prob)
        for at, codes in self.by_length(words):
            edges = self.edges(codes)
            n = codes.shape[1]
            before = self.forward(edges, prob)
            after = self.forward([e[:, ::-1] for e in edges], prob)[::-1]  # the same from the end
            weight = counts[at]
            for size, pieces in enumerate(edges, 1):
                for start in range(n - size + 1):
                    hit = np.flatnonzero(pieces[:, start] >= 0)
                    if len(hit):
                        piece = pieces[hit, start]
                        share = np.exp(before[start, hit] + after[start + size, hit] - before[n, hit]) * prob[piece] * weight[hit]
                        for k in range(prob.shape[1]):
                            seen[:, k] += np.bincount(piece, share[:, k], len(seen))
        return seen


@dataclass
class Model:
    langs: list[str]
    prob: np.ndarray
    pieces_file: str


def _sampled(rows: DataFrame, sizes: dict[str, int], sample: int, seed: int) -> DataFrame:
    """(lang, text) of ``sample`` different rows of each language at most, chosen by a hash of id and text."""
    own = rows.withColumn("h", F.xxhash64("doc_id", "text", F.lit(seed)))
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.2 * sample / n))])[F.col("lang")]
    drawn = own.where(F.pmod("h", F.lit(1 << 30)) < rate * (1 << 30)).dropDuplicates(["lang", "h"])  # equal rows count once
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))  # about 1.2 * sample rows
    return drawn.withColumn("place", place).where(F.col("place") <= sample).select("lang", "text")


def _tallied(chosen: DataFrame, langs: list[str]) -> DataFrame:
    """(word, counts): the words of all chosen texts with their counts by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                tally = Counter((lang, w) for lang, text in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True) for w in words_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.string()), pa.array(tally.values(), pa.int64())], names=["lang", "word", "n"])

    each = chosen.mapInArrow(run, "lang string, word string, n long")
    return each.groupBy("word").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)) for lang in langs)).alias("counts"))


def _maximised(tally: DataFrame, prob: np.ndarray, file: str) -> np.ndarray:
    """One round: expected counts under ``prob``, summed over tasks, made probabilities."""
    langs = prob.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = lattice(file), np.zeros_like(prob)
        for batch in batches:
            if batch.num_rows:
                counts = batch.column(1).flatten().to_numpy().reshape(-1, langs).astype(float)
                seen += own.expected(batch.column(0).to_pylist(), counts, prob)
        piece, lang = np.nonzero(np.rint(seen * UNIT))
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(np.rint(seen[piece, lang] * UNIT).astype(np.int64))], names=["piece", "lang", "n"])

    seen = np.zeros_like(prob)
    summed = tally.mapInArrow(run, "piece long, lang long, n long").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
    for piece, lang, n in summed.collect():  # a row for each piece and language at most
        seen[piece, lang] = n / UNIT
    seen[:-1] += 0.01
    new = seen / seen.sum(axis=0)
    new[-1] = 0
    return new


def train(labelled: DataFrame, pieces_file: str, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 9) -> Model:
    """Learn from rows (doc_id, text, lang) with a text and a language.

    Of each language ``sample`` different rows at most are read, chosen by a
    hash of id and text; all their words count, however long or rare.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: max(1, r[1]) for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text"))).collect()}  # one row for each language
    langs = sorted(sizes)
    size = len(lattice(pieces_file).pieces)
    prob = np.full((size + 1, len(langs)), 1.0 / size)
    prob[-1] = 0
    if not langs:
        return Model([], prob, pieces_file)
    spark = labelled.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the work is in the segmentations, not in the bytes
    tally = common.staged(_tallied(_sampled(rows, sizes, sample, seed), langs).repartition(spread, "word"), "word-counts")
    for _ in range(rounds):
        prob = _maximised(tally, prob, pieces_file)
    return Model(langs, prob, pieces_file)


class Scorer:
    """Scores blocks of texts; keeps the likelihoods of recent words (``kept`` bounds them, not the result)."""

    def __init__(self, model: Model, kept: int = 150_000):
        self.model, self.kept = model, kept
        self.lattice = lattice(model.pieces_file)
        self.known: dict[str, int] = {}
        self.table = np.empty((0, len(model.langs)))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        words: list[str] = []
        ends = [0]
        for text in texts:
            words += words_of(text)
            ends.append(len(words))
        if not self.model.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        distinct = dict.fromkeys(words)
        if len(self.known) + len(distinct) > self.kept:
            self.known, self.table = {}, self.table[:0]
        new = [w for w in distinct if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.table = np.concatenate([self.table, self.lattice.log_likelihood(new, self.model.prob)])
        rows = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        langs, scores = [], []
        for a, b in zip(ends, ends[1:]):
            if a == b:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = np.zeros(len(self.model.langs))
            for i in range(a, b, 1 << 16):  # bounded blocks of a very long text
                total += self.table[rows[i : min(b, i + (1 << 16))]].sum(axis=0)
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            langs.append(self.model.langs[best])
            scores.append(float(odds[best] / odds.sum()))
        return langs, scores


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (the posterior under equal priors).

    A text that is null or has no letter is ``und`` with score 0, as is every
    text if nothing was learned. Equal likelihoods go to the language first in
    alphabetical order. Repeated rows are predicted each; other columns are not read.
    """
    own: list[Scorer] = []

    def run(ids: list, texts: list[str]) -> dict:
        if not own:
            own.append(Scorer(model))
        langs, scores = own[0].predict(texts)
        return {"doc_id": ids, "lang_pred": langs, "score": scores}

    return common.map_blocks(docs, run, "doc_id long, lang_pred string, score double", id_col, text_col)


def held_out() -> F.Column:
    return common.crc_mod(F.col("doc_id"), 3) == 1


def identify(docs: DataFrame, pieces_file: str) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out; predict all: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(F.coalesce(~held_out(), F.lit(False))).select("doc_id", "text", "lang"), pieces_file)
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, pieces_file: str, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that are ``und`` or whose language has a score below ``least``, with all columns."""
    model = train(docs.where(F.coalesce(~held_out(), F.lit(False))).select("doc_id", "text", "lang"), pieces_file)
    own: list[Scorer] = []

    def test(texts: list[str]) -> list[bool]:
        if not own:
            own.append(Scorer(model))
        langs, scores = own[0].predict(texts)
        return [lang != UNDETERMINED and score >= least for lang, score in zip(langs, scores, strict=True)]

    return common.keep_rows(docs, test)
