from __future__ import annotations

import numpy as np
import pytest

from seisframe.llm import common, hyperminhash
from seisframe.llm.components import connected_components


def brute(rows, size, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*(w[k:] for k in range(size)))) if len(w) >= size else {tuple(w)} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 512), (5, 80, 512), (3, 85, 5)])
def test_matches_brute_force(docs, rows, size, percent, block):
    got = hyperminhash.components(docs, size, percent, block=block)
    assert {tuple(r) for r in got.collect()} == brute(rows, size, percent)


def test_large_meetings_become_one_cluster(docs, rows, monkeypatch):
    monkeypatch.setattr(hyperminhash, "MEETING", 3)
    assert {tuple(r) for r in hyperminhash.components(docs, block=6).collect()} == brute(rows, 3, 85)


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) << np.uint64(1)
        n = int(4000 * share)
        a, b = np.unique(pool[: (4000 + n) // 2]), np.unique(pool[(4000 - n) // 2 :])
        both = hyperminhash.sketches([a, b])
        size = np.array([len(a)])
        for registers, mantissa in ((both, hyperminhash.MANTISSA), (hyperminhash.shortened(both), hyperminhash.SHORT)):
            j, error = hyperminhash.estimate(registers[:1], size, registers[1], len(b), mantissa)
            assert abs(j[0] - share) < 4 * error[0]


def test_short_and_empty_sets():
    sets = hyperminhash.shingles(["", "a", "A", "a b", "a b c", "a b c d"], common.WordHashes(), 3)
    assert [len(s) for s in sets] == [0, 1, 1, 1, 1, 2]
    assert sets[1] == sets[2] and sets[1] != sets[3]
    keys = hyperminhash.band_keys(hyperminhash.sketches(sets))
    assert len(keys[0]) == 0 and len(keys[1]) == 1


def test_empty_table_nulls_and_columns(spark, nothing, docs):
    assert hyperminhash.components(nothing).collect() == []
    got = hyperminhash.components(spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (8, None), (9, "")], "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == {(None, 3, 7, False), (7, 3, 7, True), (8, 0, 8, True), (9, 0, 9, True)}
    assert hyperminhash.deduplicate(docs).columns == docs.columns


def test_null_and_repeated_ids_link_nothing(spark):
    words = [f"w{k}" for k in range(60)]
    one, two, other = " ".join(words), " ".join(words[:30]), "some more words that are nowhere else"
    # a null near copy of 7 and one of 9, an unlinked null, and a repeated id with a copy of 9 and a text of its own
    rows = [(7, one), (None, one + " x"), (9, two), (None, two + " y"), (None, other), (12, two + " z"), (12, "nothing like it at all"), (5, None)]
    rows += [(None, "null ids only here a b c"), (None, "Null ids only here a b c")] + [(None, one + " x")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in hyperminhash.components(frame, 3, 85).collect()}
    assert got == {(7, 58, 7, True), (None, 59, 7, False), (9, 28, 9, True), (None, 29, 9, False), (None, 5, None, True), (12, 29, 9, False), (12, 3, 12, True), (5, 0, 5, True)}
    kept = sorted(map(str, map(tuple, hyperminhash.deduplicate(frame, 3, 85).collect())))
    assert kept == sorted(map(str, [rows[0], rows[2], rows[4], *rows[6:10]]))


def test_components_of_a_long_chain(spark):
    order = [(k * 37) % 101 for k in range(101)]
    edges = spark.createDataFrame([*zip(order, order[1:]), (500, 501), (None, 3)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == dict.fromkeys(range(101), 0) | {500: 500, 501: 500}


def test_recall_at_the_threshold(spark):
    """Pairs whose similarity is just at or above 0.85 are all found, those just below are not linked."""
    rng = np.random.default_rng(2)
    rows, linked = [], {}
    for k in range(400):
        words = [f"p{k}w{j}" for j in range(242)]  # 240 shingles; a change at one place alters three of them
        changed = 6 if k % 2 else 7
        other = list(words)
        for at in rng.choice(np.arange(3, 236, 4), changed, replace=False):
            other[at] += "x"
        common_ = 240 - 3 * changed
        linked[2 * k + 1] = 100 * common_ >= 85 * (480 - common_)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    assert 0 < sum(linked.values()) < 400
    got = {r.doc_id: r.kept for r in hyperminhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] != linked[i] for i in linked)


def test_boilerplate_without_a_main_component(spark, monkeypatch):
    """Documents that share most of their text but are no near copies, and pairs of copies among them."""
    shared = [f"common{j}" for j in range(120)]
    rows = [(k, " ".join(shared + [f"own{k // 2 if k < 40 else k}n{j}" for j in range(30)] + ([f"end{k}"] if k < 40 else []))) for k in range(120)]
    for meeting in (1024, 8):
        monkeypatch.setattr(hyperminhash, "MEETING", meeting)
        got = hyperminhash.components(spark.createDataFrame(rows, "doc_id long, text string"), block=16)
        assert {tuple(r) for r in got.collect()} == brute(rows, 3, 85)


def test_short_texts_with_a_common_line_do_not_meet(spark):
    """One line in many short, different texts brings few of them together; short near copies still meet."""
    line = " ".join(f"common{j}" for j in range(16))
    rows = [(k, f"{line} " + " ".join(f"own{k}n{j}" for j in range(12))) for k in range(2000)]
    rows += [(3000 + k, f"{rows[k][1]} end") for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bands = [b for r in hyperminhash.features(frame, 3, 85, "doc_id", "text").select("bands").collect() for b in r.bands]
    assert np.unique(bands, return_counts=True)[1].max() < 500
    got = {r.doc_id: r.component_id for r in hyperminhash.components(frame).collect()}
    assert got == {i: i - 3000 if i >= 3000 else i for i, _ in rows}


def test_small_sets_are_told_apart_by_estimates():
    """Of a union that the registers nearly exhaust, the estimate is nearly exact; a pair at the threshold stays."""
    for n in (7, 20, 40, 100, 300):
        pool = np.sort(hyperminhash.mix(np.arange(1, 2 * n, dtype=np.uint64) * hyperminhash._A))
        pick = np.random.default_rng(n).permutation(pool)
        alike = -(-85 * n // 100)
        near, far = [np.sort(pick[:n]), np.sort(pick[:alike])], [np.sort(pick[:n]), np.sort(pick[n // 2 : n // 2 + n])]
        for sets, want in ((near, 1), (far, 0)):
            registers = hyperminhash.sketches(sets)
            for sketch, mantissa in ((registers, hyperminhash.MANTISSA), (hyperminhash.shortened(registers), hyperminhash.SHORT)):
                size = np.array([len(x) for x in sets])
                assert len(hyperminhash.likely(sketch, size, 0, np.array([1]), 85, mantissa)[0]) == want


def test_candidate_edges_do_not_grow_with_bands(spark):
    """Near copies that meet in many bands have about one edge each."""
    base = [f"w{j}" for j in range(300)]
    rows = [(k, " ".join([*base[: 2 * k], f"x{k}", *base[2 * k + 1 :]])) for k in range(140)]
    found = hyperminhash.features(spark.createDataFrame(rows, "id long, text string"), 3, 85, "id", "text").withColumnRenamed("doc_id", "id")
    met = [(r.id, r.n_shingles, bytes(r.sketch), b) for r in found.collect() for b in r.bands]
    first: dict[int, int] = {}
    for i, _, _, b in met:
        first[b] = min(i, first.get(b, i))
    frame = spark.createDataFrame([(first[b], b, i, n, s) for i, n, s, b in met], "first long, band long, id long, n_shingles long, sketch binary")
    assert hyperminhash._meet(frame, 85).distinct().count() < 8 * len(rows)
