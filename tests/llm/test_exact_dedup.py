from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from seisframe.llm import exact_dedup
from seisframe.llm.common import LOWER, UPPER


def brute(rows):
    norm = {r[0]: (r[1] or "").translate(str.maketrans(UPPER, LOWER)) for r in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {(i, max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def test_matches_brute_force_with_splitting_buckets(docs, rows):
    for options in ({"capacity": 1}, {"capacity": 4096}, {"capacity": 3, "rows": 2}, {"size": 1}):
        got = exact_dedup.mark(docs, **options)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert {tuple(r) for r in got.collect()} == brute(rows)


def top(bits):
    """A key whose last ``bits`` bits alone differ."""
    return lambda norm: F.shiftrightunsigned(F.xxhash64(norm), 64 - bits)


def test_directory_doubles_until_buckets_fit(docs):
    for key_of, capacity in ((F.xxhash64, 1), (F.xxhash64, 5), (top(9), 1), (top(7), 4)):
        index = exact_dedup.build_index(docs, capacity=capacity, key_of=key_of)
        got = index.select("bucket", "local_depth", "key").distinct().collect()
        held, depth = {}, {}
        for r in got:
            assert r.local_depth == 0 or (r.key ^ r.bucket) & ((1 << 64) - 1) < 1 << (64 - r.local_depth)
            held[r.bucket] = held.get(r.bucket, 0) + 1
            depth[r.bucket] = r.local_depth
        assert max(held.values()) <= capacity < len(got)
        ranges = sorted((b & ((1 << 64) - 1), 1 << (64 - d)) for b, d in depth.items())
        assert all(a + n <= b for (a, n), (b, _) in zip(ranges, ranges[1:]))  # buckets are disjoint ranges of keys
    assert max(depth.values()) > 50  # keys that agree in their first 57 bits


def test_colliding_keys_are_told_apart_by_bytes(docs, rows):
    few = lambda norm: F.pmod(F.xxhash64(norm), F.lit(3))
    for options in ({}, {"rows": 5}):
        index = exact_dedup.build_index(docs, key_of=few, **options)
        texts = len({r[4] for r in brute(rows)})
        assert index.where("chain > 0").count() > 0
        assert index.select("bucket", "key", "chain").distinct().count() == index.select("text_sha256").distinct().count() == texts
        assert {tuple(r) for r in exact_dedup.mark(docs, key_of=few, **options).collect()} == brute(rows)


def test_the_directory_decides(docs, rows, monkeypatch):
    """A directory that sends rows of one key to different buckets gives other groups."""
    right = exact_dedup.routed
    monkeypatch.setattr(exact_dedup, "routed", lambda r, levels: right(r, levels).withColumn("bucket", F.col("bucket") + F.col("doc_id") % 2))
    assert {tuple(r) for r in exact_dedup.mark(docs).collect()} != brute(rows)


def test_null_and_repeated_ids(spark):
    got = exact_dedup.mark(spark.createDataFrame([(None, "a"), (None, "A"), (1, "b"), (1, "b"), (None, "b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.keep_id, r.group_size, r.kept) for r in got if r.keep_id) == [(False, 1, 3, True), (False, 1, 3, True), (True, 1, 3, False)]
    assert all(r.kept for r in got if r.keep_id is None)


def test_deduplicate_with_null_and_repeated_ids(spark):
    rows = [(1, "a"), (1, "b"), (2, "B"), (None, "b"), (None, "c"), (None, "C"), (3, None), (4, "")]
    got = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "a"), (2, "B"), (None, "c"), (None, "C"), (4, "")]))


def test_empty_table_and_columns(nothing, docs, rows):
    assert exact_dedup.mark(nothing).collect() == []
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in brute(rows) if r[3]}
