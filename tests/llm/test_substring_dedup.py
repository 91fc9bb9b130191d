from __future__ import annotations

import hashlib

import numpy as np
import pytest

from seisframe.llm import substring_dedup
from seisframe.llm.fm_index import BitVector, FmIndex, RangeMinimum, WaveletMatrix, suffix_order


def brute(rows, window):
    words = {r[0]: (r[1] or "").encode().split() for r in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = set()
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.add((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "run", "hot"), [(50, 12, 1000), (50, 12, 1), (10, 4, 1000)])
def test_matches_brute_force(docs, rows, window, run, hot):
    got = substring_dedup.clean(docs, window=window, run=run, hot=hot).drop("kept")
    assert {tuple(r) for r in got.collect()} == brute(rows, window)


def test_empty_table_and_null_ids(spark, nothing):
    assert substring_dedup.clean(nothing).collect() == []
    text = " ".join(map(str, range(60)))
    got = substring_dedup.clean(spark.createDataFrame([(None, text), (4, text), (5, None), (4, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 60, 60), (4, 60, 0), (4, 60, 0), (5, 0, 0)]


def test_index_parts_against_plain_loops():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, 200).astype(bool)
    assert (BitVector(bits).rank(np.arange(201)) == np.concatenate([[0], np.cumsum(bits)])).all()
    text = rng.integers(0, 9, 300)
    matrix = WaveletMatrix(text, 8)
    at, symbol = rng.integers(0, 301, 100), rng.integers(0, 9, 100)
    assert matrix.rank(symbol, at).tolist() == [int((text[:a] == s).sum()) for a, s in zip(at, symbol)]
    low = rng.integers(0, 299, 100)
    high = low + 1 + rng.integers(0, 300 - low)
    assert RangeMinimum(text).least(low, high).tolist() == [int(text[a:b].min()) for a, b in zip(low, high)]
    order = suffix_order(text, 400)
    assert order.tolist() == sorted(range(300), key=lambda i: text[i:].tolist())


def test_matching_statistics_against_plain_search():
    rng = np.random.default_rng(4)
    passages = [rng.integers(1, 4, rng.integers(6, 30)) for _ in range(40)]
    owner = rng.integers(0, 12, 40)
    found = FmIndex(passages, owner, 40).matches(owner, 6)
    for k, p in enumerate(passages):
        smaller = {tuple(q[i : i + 6]) for j, q in enumerate(passages) if owner[j] < owner[k] for i in range(len(q) - 5)}
        want = set()
        for i in range(len(p) - 5):
            if tuple(p[i : i + 6]) in smaller:
                want.update(range(i, i + 6))
        assert {x for a, b in found[k] for x in range(a, b)} == want
