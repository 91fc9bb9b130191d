"""Near-duplicate detection with HyperMinHash sketches.

A document's set of word shingles is hashed into buckets; a bucket's register
keeps the smallest hash as its leading-zero count and the mantissa bits after
the first one. Documents that agree in a band of registers meet; their Jaccard
similarity is estimated from the registers, corrected for chance collisions,
and documents that no estimate tells apart form candidate clusters. Inside a
cluster, pairs are confirmed on their full sets, until everything is either
connected or refuted.

Only one document of each distinct set takes part, under a number of its own, so
null and repeated ids link nothing. A cluster of more than
``BLOCK`` documents is dealt over tasks in blocks: links inside blocks first,
then links between central members of blocks, and then documents that meet in
a band and are of different components by then, each against the blocks that
hold such partners. Of bands with too many documents, each one outside the main
component is compared with all, so no link is lost, while copies that hang
together are never compared pair by pair.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

#: Bands, and their registers from a similarity of 0.85 on and below; 26 mantissa bits and 6 bits for leading zeros.
#: A pair at the threshold meets in no band with a chance of (1 - s**rows)**BANDS: 1e-6 at 0.85, 2e-5 at 0.8.
BANDS, ROWS, FEWER, MANTISSA = 36, 7, 6, 26
EMPTY = np.uint32(0xFFFFFFFF)
#: What travels with documents that meet: all registers, with SHORT mantissa bits.
SHORT = 10
SHORT_EMPTY = np.uint16(0xFFFF)
#: Documents that meet in one band and are estimated pair by pair; more are taken as one candidate cluster.
MEETING = 1024
#: Documents of one block, and central members that stand for each of a block's largest components.
BLOCK, HUBS, LARGEST = 512, 8, 3
#: An estimate below the threshold by so many standard errors refutes a pair; one at the threshold is refuted with a chance of 3e-7.
ERRORS = 5.0
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _one(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` word hashes."""
    count = len(h) - width + 1
    out = np.full(count, width * int(_C) & _MASK, dtype=np.uint64)
    for k in range(width):
        out = (out ^ mix(h[k : count + k] + np.uint64(k * int(_A) & _MASK))) * _B
        out ^= out >> np.uint64(29)
    return mix(out)


def shingles(texts: list[str], hashes: common.WordHashes, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; of fewer words the whole sequence is one."""
    words: list[bytes] = []
    ends = [0]
    for text in texts:
        words += text.encode().lower().split()
        ends.append(len(words))
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    del words
    runs = _one(h, size) if len(h) >= size else None
    out = []
    for a, b in zip(ends, ends[1:]):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        else:
            out.append(_one(h[a:b], b - a) if b > a else np.empty(0, dtype=np.uint64))
    return out


def rows_for(percent: int) -> int:
    return ROWS if percent >= 85 else FEWER


def sketches(sets: list[np.ndarray], rows: int = ROWS) -> np.ndarray:
    """Packed registers (a row for each set) of sorted sets of hashes."""
    size = BANDS * rows
    registers = np.full((len(sets), size), EMPTY)
    if not sets:
        return registers
    flat = np.concatenate(sets)
    bucket = (((flat >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
    bucket += np.repeat(np.arange(len(sets)) * size, [len(s) for s in sets])
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # the smallest hash of each bucket of each set
    value = flat[first] * np.uint64(size)  # its place inside the bucket, as a fraction of 2**64
    zeros = np.where(value > 0, 64 - np.frexp(value.astype(np.float64))[1], 63).clip(0, 62).astype(np.uint64)
    mantissa = (value << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    registers.ravel()[bucket[first]] = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint32)
    return registers


@functools.cache
def _lenders(size: int) -> np.ndarray:
    """For each register, all registers in an order of its own."""
    k = np.arange(size * size, dtype=np.uint64).reshape(size, size)
    return np.argsort(mix(k * _A + _C), axis=1, kind="stable")


def densified(registers: np.ndarray) -> np.ndarray:
    """Empty registers filled from the first one in use in an order of their own, so that two sets agree in each with a chance of their similarity, however small they are.

    A band of a small set would else hold an element or two, and all sets with
    one common line would meet in it.
    """
    out, order = registers.copy(), _lenders(registers.shape[1])
    row, own = np.nonzero((registers == EMPTY) & (registers != EMPTY).any(axis=1)[:, None])
    for t in range(registers.shape[1]):
        if not len(row):
            break
        value = registers[row, order[own, t]]
        got = value != EMPTY
        out[row[got], own[got]] = value[got]
        row, own = row[~got], own[~got]
    return out


def band_keys(registers: np.ndarray) -> list[np.ndarray]:
    """For each sketch, a 64-bit key of each band that has a register."""
    rows = registers.reshape(len(registers), BANDS, -1)
    key = np.tile(np.array([b * int(_A) & _MASK for b in range(1, BANDS + 1)], dtype=np.uint64), (len(rows), 1))
    for k in range(rows.shape[2]):
        key = mix((key ^ rows[:, :, k].astype(np.uint64)) * _B)
    used = (rows != EMPTY).any(axis=2)
    return [k[u] for k, u in zip(key.view(np.int64), used, strict=True)]


def shortened(registers: np.ndarray) -> np.ndarray:
    """All registers with fewer mantissa bits: 6 + SHORT bits each."""
    return np.where(registers == EMPTY, SHORT_EMPTY, (registers >> np.uint32(MANTISSA - SHORT)).astype(np.uint16))


def chance_collisions(n: np.ndarray, m: np.ndarray, registers: int, mantissa: int) -> np.ndarray:
    """Expected equal registers of two disjoint sets of n and m elements (the HyperMinHash paper's approximation)."""
    ratio = np.maximum(n, m) / np.maximum(1, np.minimum(n, m))
    return 0.1699 * registers * 2.0**-mantissa * 4 * ratio / (1 + ratio) ** 2


def estimate(one: np.ndarray, n: np.ndarray, other: np.ndarray, m: int, mantissa: int = MANTISSA) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimates, 1 / sqrt(registers used)) of sketches ``one`` (rows) with the sketch ``other``."""
    nothing = EMPTY if mantissa == MANTISSA else SHORT_EMPTY
    full = (one != nothing) | (other != nothing)
    both = full.sum(axis=1)
    equal = ((one == other) & full).sum(axis=1)
    chance = chance_collisions(n, np.full(len(n), m), one.shape[1], mantissa)
    return (equal - chance) / np.maximum(both, 1), 1 / np.sqrt(np.maximum(both, 1))


def likely(sketch: np.ndarray, n: np.ndarray, i: int, others: np.ndarray, percent: int, mantissa: int = MANTISSA) -> tuple[np.ndarray, np.ndarray]:
    """(others, estimates) that neither the sizes nor the estimates refute as partners of i.

    The registers in use are as many elements of the union, drawn without
    repeats: of a small union they are nearly all, and the estimate is nearly
    exact. A pair at the threshold has a union of (n + m) / (1 + threshold).
    """
    low, high = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
    others = others[(100 * low >= percent * high) & (low > 0)]
    if not len(others):
        return others, np.empty(0)
    j, error = estimate(sketch[others], n[others], sketch[i], int(n[i]), mantissa)
    least = percent / 100
    union = (n[others] + n[i]) / (1 + least)
    unseen = np.maximum(union - error**-2, 0) / np.maximum(union - 1, 1)
    chance = chance_collisions(n[others], np.full(len(others), n[i]), sketch.shape[1], mantissa) * error**2
    good = j + chance >= least - ERRORS * np.sqrt(least * (1 - least) * unseen) * error - 1e-9  # the standard error of a pair at the threshold
    return others[good], j[good]


def root_of(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


class Linker:
    """Full sets, sketches and components of the documents of one block."""

    def __init__(self, ids: list[int], texts: list[str], size: int, percent: int, hashes: common.WordHashes):
        self.ids, self.percent = ids, percent
        self.sets = shingles([t or "" for t in texts], hashes, size)
        self.n = np.array([len(s) for s in self.sets])
        self.sketches = sketches(self.sets, rows_for(percent))
        self.parent = list(range(len(ids)))

    def root(self, i: int) -> int:
        return root_of(self.parent, i)

    def union(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if self.ids[a] > self.ids[b]:
            a, b = b, a
        self.parent[b] = a

    def linked(self, i: int, j: int) -> bool:
        common_ = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
        return 100 * common_ >= self.percent * (self.n[i] + self.n[j] - common_) > 0

    def candidates(self, i: int, others: np.ndarray) -> list[tuple[float, int]]:
        """(estimate, other) of the likely partners."""
        others, j = likely(self.sketches, self.n, i, others, self.percent)
        return list(zip(j.tolist(), others.tolist(), strict=True))

    def connect(self) -> np.ndarray:
        """Connect all linked pairs; returns how many likely partners each document has."""
        order = np.argsort(self.n, kind="stable")
        pairs, degree = [], np.zeros(len(self.ids), dtype=np.int64)
        for place, i in enumerate(order):
            for j, other in self.candidates(int(i), order[place + 1 :]):
                pairs.append((-j, int(i), other))
                if 100 * j >= self.percent:
                    degree[i] += 1
                    degree[other] += 1
        for _, i, j in sorted(pairs):
            if self.root(i) != self.root(j) and self.linked(i, j):
                self.union(i, j)
        return degree

    def meet(self, queries: list[int], members: np.ndarray, label: list[int]) -> list[tuple[int, int]]:
        """Links of the queries with members of other components, one for each query and component."""
        out = []
        for q in queries:
            seen = {label[q]}
            for _, other in sorted(self.candidates(q, members), reverse=True):
                if label[other] not in seen and self.linked(q, other):
                    seen.add(label[other])
                    out.append((self.ids[q], self.ids[other]))
        return out


def features(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_sha256, n_shingles, s1, s2, bands, sketch): s1 and s2 identify the set."""
    own: list[common.WordHashes] = []

    def run(ids: list, texts: list[str]) -> dict:
        if not own:
            own.append(common.WordHashes())
        sets = shingles(texts, own[0], size)
        n = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        at = np.concatenate([[0], np.cumsum(n)])
        sums = [np.concatenate([[0], np.cumsum(mix(flat * _A))]).astype(np.uint64), np.concatenate([[0], np.cumsum(mix(flat ^ _C))]).astype(np.uint64)]
        s1, s2 = ((x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums)
        registers = sketches(sets, rows_for(percent))
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        return {"doc_id": ids, "text_sha256": digests, "n_shingles": n, "s1": s1, "s2": s2, "bands": band_keys(densified(registers)), "sketch": [r.tobytes() for r in shortened(registers)]}

    return common.map_blocks(docs, run, "doc_id long, text_sha256 string, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary", id_col, text_col)


def _blocked(members: DataFrame, sizes: DataFrame, block: int, seed: int) -> DataFrame:
    """Members (id, cluster, ...) with their block and their cluster's number of blocks."""
    return members.join(common.sized(sizes), "cluster").withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).drop("size").withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), "blocks").cast("int"))


def _link_blocks(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """In each (cluster, block): (cluster, block, blocks, id, root, hub, text); hub marks central members of the largest components."""

    def run(group: dict[str, list]) -> dict:
        ids = group["id"]
        own = Linker(ids, group["text"], size, percent, hashes)
        degree = own.connect()
        roots = [own.root(i) for i in range(len(ids))]
        several = group["blocks"][0] > 1
        hub = [False] * len(ids)
        if several:
            inside: dict[int, list[int]] = {}
            for i, r in enumerate(roots):
                inside.setdefault(r, []).append(i)
            for r in sorted(inside, key=lambda x: (-len(inside[x]), x))[:LARGEST]:
                for i in sorted(inside[r], key=lambda i: (-degree[i], ids[i]))[:HUBS]:
                    hub[i] = True
        return group | {"root": [ids[r] for r in roots], "hub": hub, "text": group["text"] if several else [None] * len(ids)}

    hashes = common.WordHashes()
    return common.map_groups(rows.select("cluster", "block", "blocks", "id", "text"), ["cluster", "block"], run, "cluster long, block int, blocks int, id long, root long, hub boolean, text string")


def _meet(met: DataFrame, percent: int) -> DataFrame:
    """Of the rows (first, band, id, n_shingles, sketch): edges (a, b) that span all pairs of a band that no estimate refutes.

    Bands with the same first document are taken together, as they hold mostly
    the same others, and each document has one edge, to its component's smallest id.
    """

    def run(group: dict[str, list]) -> dict:
        ids, at, own = np.unique(np.array(group["id"]), return_index=True, return_inverse=True)
        n = np.array(group["n_shingles"])[at]
        sketch = np.frombuffer(b"".join(group["sketch"][k] for k in at), dtype=np.uint16).reshape(len(ids), -1)
        label = np.arange(len(ids))
        for members in np.split(own, np.flatnonzero(np.diff(np.array(group["band"])) != 0) + 1):
            for k, i in enumerate(members.tolist()):
                others = members[k + 1 :]
                for other in likely(sketch, n, i, others[label[others] != label[i]], percent, SHORT)[0].tolist():
                    a, b = sorted((label[i], label[other]))
                    if a != b:
                        label[label == b] = a
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return {"a": ids[moved].tolist(), "b": ids[label[moved]].tolist()}

    return common.map_groups(met, ["first"], run, "a long, b long", "band")


def _pairs_asked(group: dict[str, list], queries: np.ndarray, stock: np.ndarray, percent: int, sketch: np.ndarray) -> dict:
    """(cluster, block, id, label): each query with the blocks that hold likely partners of another label."""
    n, label, block = (np.array(group[k]) for k in ("n_shingles", "label", "block"))
    out: dict[str, list] = {"cluster": [], "block": [], "id": [], "label": []}
    for q in queries.tolist():
        for b in np.unique(block[likely(sketch, n, q, stock[label[stock] != label[q]], percent, SHORT)[0]]).tolist():
            for name, value in zip(out, (group["cluster"][q], b, group["id"][q], group["label"][q]), strict=True):
                out[name].append(value)
    return out


def _sketched(group: dict[str, list]) -> np.ndarray:
    return np.frombuffer(b"".join(group["sketch"]), dtype=np.uint16).reshape(len(group["id"]), -1)


ASKED = "cluster long, block int, id long, label long"


def _asked(known: DataFrame, meetings: DataFrame, stars: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(cluster, block, id, label): documents with the blocks where sketches leave a partner of another component.

    ``known`` is (id, cluster, block, label). Only documents that meet are
    compared: in each band those of different components. Of bands in which
    more than MEETING meet, the documents that hang together form crowds, and
    those outside a crowd's main component are compared with all of it.
    """
    rows = meetings.where(F.col("n") <= MEETING).select("band", "id").join(known, "id")
    apart = rows.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band")
    met = rows.join(apart, "band").join(sketches, "id").select("band", "id", "cluster", "block", "label", "n_shingles", "sketch")

    def in_band(group: dict[str, list]) -> dict:
        label = np.array(group["label"])
        values, own, counts = np.unique(label, return_inverse=True, return_counts=True)
        order = np.lexsort((-values, counts))  # labels of many documents last
        rank = np.empty(len(values), dtype=np.int64)
        rank[order] = np.arange(len(values))
        place = rank[own]
        sketch = _sketched(group)
        out: dict[str, list] = {"cluster": [], "block": [], "id": [], "label": []}
        for r in range(len(values) - 1):  # each pair once: the rarer label asks
            made = _pairs_asked(group, np.flatnonzero(place == r), np.flatnonzero(place > r), percent, sketch)
            for name in out:
                out[name] += made[name]
        return out

    asked = common.map_groups(met, ["band"], in_band, ASKED)
    if stars.isEmpty():
        return asked.distinct()
    crowds = known.join(connected_components(stars, "crowds").withColumnRenamed("component", "crowd"), "id")
    counts = crowds.groupBy("crowd", "label").count()
    main = counts.groupBy("crowd").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("main"), F.sum("count").alias("size"), F.max("count").alias("most"))
    main = main.withColumn("parts", F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int")).where("parts > 0").withColumn("shares", F.ceil(F.col("size") / BLOCK).cast("int")).select("crowd", "main", "parts", "shares")
    rows = crowds.join(common.sized(common.staged(main, "main-components")), "crowd").join(sketches, "id")
    part, share = F.pmod(F.xxhash64("id", F.lit(3)), "parts").cast("int"), F.pmod(F.xxhash64("id", F.lit(4)), "shares").cast("int")
    queries = rows.where("label <> main").withColumn("part", part).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    stock = rows.withColumn("share", share).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    names = ["crowd", "share", "part", "id", "cluster", "block", "label", "n_shingles", "sketch"]
    dealt = queries.select(*names, F.lit(True).alias("query")).union(stock.select(*names, F.lit(False)))

    def in_crowd(group: dict[str, list]) -> dict:
        query = np.array(group["query"])
        return _pairs_asked(group, np.flatnonzero(query), np.flatnonzero(~query), percent, _sketched(group))

    return asked.union(common.map_groups(dealt, ["crowd", "share", "part"], in_crowd, ASKED)).distinct()


def map_groups_of(dealt: DataFrame, run, schema: str) -> DataFrame:
    return common.map_groups(dealt, ["cluster", "block", "part"], run, schema)


def _outside(members: DataFrame, labels: DataFrame, meetings: DataFrame, stars: DataFrame, sketches: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between the components that the blocks have left.

    Sketches choose the blocks that a document is compared with; only then are
    texts dealt, those of the chosen documents and blocks.
    """
    known = members.drop("text").join(labels, "id", "left").select("id", "cluster", "block", F.coalesce("component", "id").alias("label"))
    asked = common.staged(_asked(common.staged(known, "known"), meetings, stars, sketches, percent), "asked")
    parts = asked.groupBy("cluster", "block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    labelled = members.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id"))
    queries = asked.join(members.select("id", "text"), "id").join(parts, ["cluster", "block"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), "parts").cast("int"))
    stock = labelled.join(parts, ["cluster", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    names = ["cluster", "block", "part", "id", "label", "text"]
    dealt = queries.select(*names, F.lit(True).alias("query")).union(stock.select(*names, F.lit(False)))

    def run(group: dict[str, list]) -> dict:
        own = Linker(group["id"], group["text"], size, percent, hashes)
        asked = np.array(group["query"])
        found = own.meet(np.flatnonzero(asked).tolist(), np.flatnonzero(~asked), group["label"])
        return {"a": [a for a, _ in found], "b": [b for _, b in found]}

    hashes = common.WordHashes()
    return map_groups_of(dealt, run, "a long, b long")


def _sha256(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def _marked(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, block: int) -> DataFrame:
    """One row per document: doc_id, text_sha256, n_shingles, component_id, kept."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = common.staged(features(named, size, percent, "doc_id", "text").withColumn("id", F.monotonically_increasing_id()), "sketches")
    sets = ["n_shingles", "s1", "s2"]
    firsts = common.staged(found.where("n_shingles > 0").groupBy(*sets).agg(F.min("id").alias("id"), F.min("doc_id").alias("doc_id")), "sets")
    first = found.join(firsts.select("id"), "id", "left_semi")
    banded = first.select("id", F.explode("bands").alias("band"))
    # bands in which the same documents meet count once
    met = banded.groupBy("band").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("id").alias("last"), F.sum(F.xxhash64("id").bitwiseAND((1 << 40) - 1)).alias("who")).where("n > 1")
    met = common.staged(met.groupBy("n", "first", "last", "who").agg(F.min("band").alias("band")).select("band", "first", "n"), "bands")
    rows = common.staged(banded.join(met, "band").select("band", "id", "first", "n"), "meetings")
    stars = rows.where((F.col("n") > MEETING) & (F.col("id") != F.col("first"))).select(F.col("id").alias("a"), F.col("first").alias("b"))
    small = rows.where(F.col("n") <= MEETING).select("first", "band", "id").join(found.select("id", "n_shingles", "sketch"), "id").select("first", "band", "id", "n_shingles", "sketch")
    candidates = common.staged(_meet(small, percent).union(stars).distinct(), "candidates")
    members = connected_components(candidates, "clusters").withColumnRenamed("component", "cluster")
    sizes = common.staged(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster-sizes")
    texts = named.select(F.col("doc_id").alias("own"), _sha256("text").alias("sha256"), "text")
    wanted = _blocked(members, sizes, block, 1).join(first.select("id", "doc_id", "text_sha256"), "id")
    dealt = wanted.join(texts, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("text_sha256") == F.col("sha256"))).select("id", "cluster", "block", "blocks", "text")
    dealt = dealt.dropDuplicates(["id"])  # rows equal in id and text
    linked = common.staged(_link_blocks(dealt, size, percent), "links")
    links = linked.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    several = linked.where("blocks > 1").select("cluster", "block", "blocks", "id", "text")
    if not several.isEmpty():
        level, seed, before = linked, 2, linked.count()
        while True:  # each level has fewer members; the last step below finds whatever these leave apart
            hubs = common.staged(level.where("hub and blocks > 1").select("id", "cluster", "text"), "hubs")
            now = hubs.count()
            if not 0 < now < before:
                break
            before = now
            again = common.staged(hubs.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster-sizes")
            level = common.staged(_link_blocks(_blocked(hubs, again, 2 * block, seed), size, percent), "links")
            links = links.union(level.where("id <> root").select("id", "root"))
            seed += 1
        so_far = connected_components(links, "so-far")
        links = links.union(common.staged(_outside(several, so_far, rows, stars, found.select("id", "n_shingles", "sketch"), size, percent), "outside"))
    labels = connected_components(links, "near-duplicates")
    least = labels.join(firsts.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = labels.join(least, "component").select("id", "component_id")
    marked = firsts.join(labels, "id", "left").select(*sets, F.coalesce("component_id", "doc_id").alias("component_id"))
    return (
        found.select("doc_id", "text_sha256", *sets)
        .join(marked, sets, "left")
        .select("doc_id", "text_sha256", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def components(docs: DataFrame, size: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A-Z are lower-cased, words are runs of anything but ASCII white space, and
    documents whose sets have 100 * intersection >= percent * union are
    linked. Null and empty texts have an empty set, are linked with nothing and
    stay. Rows with equal sets are linked whatever their number; rows of the
    same id are not, unless their sets are. The smallest id of a component
    stays. Rows of the component that repeat that id all stay; a null id stays
    only in a component without any other id. Columns besides id and text are
    not read.
    """
    return _marked(docs, size, percent, id_col, text_col, block).drop("text_sha256")


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``components`` keeps, with all their columns. Null and repeated ids are told apart by text."""
    gone = _marked(docs, size, percent, id_col, text_col, BLOCK).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__text"))
    named = docs.withColumn("__sha256", _sha256(text_col))
    return named.join(gone.distinct(), F.col(id_col).eqNullSafe(F.col("__gone")) & (F.col("__sha256") == F.col("__text")), "left_anti").drop("__sha256")


ORACLE = rf"""
WITH RECURSIVE
     d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     k AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0),
     sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM k),
     n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
     pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
     links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
     e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
     reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.doc_id)
SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
