"""Removal of long repeated passages, by an FM-index for each shard of shared text.

A window is ``WINDOW`` consecutive words. Its anchor is the smallest hash of
its runs of ``RUN`` words, so equal windows have equal anchors. Anchors that
occur in one document only can't belong to a repeated window; the stretches
of text around the others, equal ones once with their smallest document, are
dealt to shards by anchor. A shard indexes its stretches, and each of them is
streamed backwards through the index: matching statistics against documents
with smaller ids give the intervals of ``WINDOW`` words or more that occur
there. An anchor with more than ``HOT`` different stretches (a passage that
stands in very many contexts) is dealt window by window instead, so no group
grows with the number of copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .fm_index import FmIndex
from .hyperminhash import mix

WINDOW, RUN = 50, 12
#: Windows of a stretch at most, stretches of a shard (expected), and different stretches of an anchor before it is split.
STRETCH, SHARD, HOT = 64, 4000, 1000
_LAST = (1 << 63) - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((a * _A) ^ ((b << np.uint64(1)) | (b >> np.uint64(63))) * _B)


def runs_of(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` word hashes from each position on, for positions with as many."""
    by_width, width = {1: h}, 1
    while 2 * width <= size:
        own = by_width[width]
        by_width[2 * width] = _join(own[:-width], own[width:])
        width *= 2
    out, covered = by_width[width], width
    while covered < size:
        width = max(w for w in by_width if w <= size - covered)
        n = len(h) - covered - width + 1
        out = _join(out[:n], by_width[width][covered : covered + n])
        covered += width
    return out


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    out, covered = values, 1
    while covered < width:
        step = min(covered, width - covered)
        out = np.minimum(out[:-step], out[step:])
        covered += step
    return out


class Anchored:
    """Words of a block of texts, with the anchor of every window."""

    def __init__(self, texts: list[str], hashes: common.WordHashes, window: int, run: int):
        self.words: list[bytes] = []
        ends = [0]
        for text in texts:
            self.words += text.encode().split()
            ends.append(len(self.words))
        self.ends, self.window = ends, window
        h = np.fromiter(map(hashes.__getitem__, self.words), dtype=np.uint64, count=len(self.words))
        self.anchor = sliding_minimum(runs_of(h, run), window - run + 1).view(np.int64) if len(h) >= window else np.empty(0, dtype=np.int64)

    def of(self, k: int) -> np.ndarray:
        """Anchors of text k's windows."""
        return self.anchor[self.ends[k] : max(self.ends[k], self.ends[k + 1] - self.window + 1)]

    def stretches(self, k: int, shared: set[int]):
        """(anchor, first word, end) for runs of windows with the same shared anchor."""
        own = self.of(k)
        if not len(own):
            return
        cut = np.flatnonzero(np.diff(own, prepend=own[0] + 1) != 0)
        for a, b in zip(cut, [*cut[1:], len(own)], strict=True):
            if int(own[a]) in shared:
                for i in range(a, b, STRETCH):
                    yield int(own[a]), int(i), int(min(b, i + STRETCH) - 1 + self.window)

    def text(self, k: int, first: int, end: int) -> str:
        return b" ".join(self.words[self.ends[k] + first : self.ends[k] + end]).decode()


def _squeezed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, body): the text compressed for the shuffle."""

    def run(rows: list, texts: list[str]) -> dict:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        return {"doc_id": [r["doc_id"] for r in rows], "row": [r["row"] for r in rows], "body": [squeeze.compress(t.encode()) for t in texts]}

    return common.map_blocks(docs.select(F.struct("doc_id", "row").alias("key"), "text"), run, "doc_id long, row long, body binary", "key", "text")


def _opened(bodies: list[bytes]) -> list[str]:
    import zstandard

    expand = zstandard.ZstdDecompressor()
    return [expand.decompress(b).decode() for b in bodies]


def _map_bodies(df: DataFrame, fn, schema: str) -> DataFrame:
    """Apply fn(keys, texts, extras) to (key, body, extra) rows, about a block of text at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            keys, bodies, extras = (batch.column(i) for i in range(3))
            at = 0
            while at < batch.num_rows:
                size, end = 0, at
                while end < batch.num_rows and size < common.BLOCK_CHARS // 2:
                    size += len(bodies[end].as_buffer())
                    end += 1
                n = end - at
                out = fn(keys.slice(at, n).to_pylist(), _opened(bodies.slice(at, n).to_pylist()), extras.slice(at, n).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
                at = end

    return df.mapInArrow(run, schema)


def _anchors(docs: DataFrame, window: int, run: int) -> DataFrame:
    """(anchor, doc_id, row): the anchors of each document, once each."""
    hashes = common.WordHashes()

    def find(keys: list, texts: list[str]) -> dict:
        own = Anchored(texts, hashes, window, run)
        each = [np.unique(own.of(k)) for k in range(len(texts))]
        n = [len(x) for x in each]
        return {"anchor": np.concatenate(each), "doc_id": np.repeat([k["doc_id"] for k in keys], n), "row": np.repeat([k["row"] for k in keys], n)}

    return common.map_blocks(docs.select(F.struct("doc_id", "row").alias("key"), "text"), find, "anchor long, doc_id long, row long", "key", "text")


def _stretches(docs: DataFrame, shared: DataFrame, window: int, run: int) -> DataFrame:
    """(doc_id, row, start, anchor, s1, s2, words) of the stretches with a shared anchor."""
    hashes = common.WordHashes()

    def cut(keys: list, texts: list[str], anchors: list[list[int]]) -> dict:
        own = Anchored(texts, hashes, window, run)
        out: dict[str, list] = {n: [] for n in ("doc_id", "row", "start", "anchor", "s1", "s2", "words")}
        for k, key in enumerate(keys):
            for anchor, first, end in own.stretches(k, set(anchors[k])):
                words = own.text(k, first, end)
                digest = hashlib.blake2b(words.encode(), digest_size=16).digest()
                for n, v in zip(out, (key["doc_id"], key["row"], first, anchor, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), words)):
                    out[n].append(v)
        return out

    # a document's own anchors, so as many as it is long
    wanted = shared.groupBy("doc_id", "row").agg(F.collect_list("anchor").alias("anchors"))
    rows = _squeezed(docs).join(wanted, ["doc_id", "row"]).select(F.struct("doc_id", "row").alias("key"), "body", "anchors")
    return _map_bodies(rows, cut, "doc_id long, row long, start int, anchor long, s1 long, s2 long, words string")


def _indexed(different: DataFrame, shards: int, window: int) -> DataFrame:
    """(s1, s2, first, spans) for the stretches that have windows of a smaller document."""

    def run(group: dict[str, list]) -> dict:
        known: dict[str, int] = {}
        passages = [np.array([known.setdefault(w, len(known) + 1) for w in t.split(" ")], dtype=np.int64) for t in group["words"]]
        owner = np.unique(np.array(group["first"]), return_inverse=True)[1]
        spans = FmIndex(passages, owner, max(map(len, passages))).matches(owner, window)
        hit = [k for k, s in enumerate(spans) if s]
        return {n: [group[n][k] for k in hit] for n in ("s1", "s2")} | {"spans": [[{"s": s, "e": e} for s, e in spans[k]] for k in hit]}

    dealt = different.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))
    return common.map_groups(dealt.select("shard", "s1", "s2", "first", "words"), ["shard"], run, "s1 long, s2 long, spans array<struct<s:int,e:int>>", "s1")


def _by_window(hot: DataFrame, window: int) -> DataFrame:
    """The same for stretches of hot anchors, each window a passage of its own."""
    words = F.split("words", " ")
    each = hot.select("s1", "s2", "first", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.array_join(F.slice(words, i + 1, F.lit(window)), " "))).alias("at", "passage"))
    least = common.staged(each.groupBy("passage").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most").select("passage", "least"), "hot-windows")
    met = each.join(least, "passage").where("least < first")
    return met.groupBy("s1", "s2").agg(F.collect_list(F.struct(F.col("at").alias("s"), (F.col("at") + window).alias("e"))).alias("spans"))


def removed(docs: DataFrame, window: int = WINDOW, run: int = RUN, hot: int = HOT) -> DataFrame:
    """(doc_id, row, spans): word intervals to remove, of documents that have any; ``docs`` is (doc_id, row, text)."""
    anchors = common.staged(_anchors(docs, window, run), "anchors")
    several = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    shared = anchors.join(common.staged(several, "shared-anchors"), "anchor")
    found = common.staged(_stretches(docs, shared, window, run), "stretches")
    different = common.staged(found.groupBy("anchor", "s1", "s2", "words").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "different-stretches")
    crowded = common.staged(different.groupBy("anchor").count().where(F.col("count") > hot).select("anchor", F.lit(True).alias("hot")), "hot-anchors")
    marked = different.join(crowded, "anchor", "left")
    shards = max(1, -(-different.count() // SHARD))
    spans = _indexed(marked.where("hot is null"), shards, window).union(_by_window(marked.where("hot"), window))
    spans = common.staged(different.select("s1", "s2", "first", "n", F.size(F.split("words", " ")).alias("size")).join(spans, ["s1", "s2"], "left").where("n > 1 or spans is not null"), "spans")
    # of equal stretches, all but the first document's occur in a smaller document as a whole
    whole = F.array(F.struct(F.lit(0).alias("s"), F.col("size").alias("e")))
    own = found.select("doc_id", "row", "start", "s1", "s2").join(spans, ["s1", "s2"]).withColumn("spans", F.when(F.col("doc_id") > F.col("first"), whole).otherwise(F.col("spans")))
    placed = own.where("spans is not null").select("doc_id", "row", F.explode("spans").alias("x"), "start").select("doc_id", "row", (F.col("start") + F.col("x.s")).alias("s"), (F.col("start") + F.col("x.e")).alias("e"))
    return placed.groupBy("doc_id", "row").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept (the kept words joined by one space).

    Words are runs of anything but ASCII white space. A word goes if a window
    that covers it starts in a document with a smaller id too; windows are
    judged on the input. Null text has no words. A null id counts as larger
    than any other; rows of the same id never remove each other's words.
    Columns besides id and text are not read.
    """
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(_LAST)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    spans = removed(rows, window, run, hot)
    joined = _squeezed(rows).join(spans, ["doc_id", "row"], "left").select(F.struct("doc_id", "row").alias("key"), "body", "spans")

    def finish(keys: list, texts: list[str], spans: list) -> dict:
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")}
        for key, text, cuts in zip(keys, texts, spans, strict=True):
            words = text.encode().split()
            n = len(words)
            if cuts:
                gone = np.zeros(n + 1, dtype=np.int64)
                np.add.at(gone, [c["s"] for c in cuts], 1)
                np.add.at(gone, [c["e"] for c in cuts], -1)
                words = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
            kept = b" ".join(words)
            for name, v in zip(out, (None if key["doc_id"] == _LAST else key["doc_id"], n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                out[name].append(v)
        return out

    return _map_bodies(joined, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def digests(docs: DataFrame) -> DataFrame:
    return clean(docs).drop("kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     k AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
     win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM k WHERE i + 49 <= len(w)),
     first AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
     hit AS (SELECT win.doc_id, i FROM win JOIN first USING (s) WHERE m < win.doc_id),
     gone AS (SELECT DISTINCT doc_id, i + o AS i FROM hit, range(0, 50) t(o)),
     kept AS (SELECT doc_id, count(*) AS n, string_agg(w[i], ' ' ORDER BY i) AS t FROM k ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
