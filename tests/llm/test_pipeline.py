from __future__ import annotations

import corpus_pipeline
from seisframe.llm import queries
from seisframe.llm.common import staged

from .test_exact_dedup import brute as exact
from .test_hyperminhash import brute as near
from .test_packing import check
from .test_pii import base


def test_stages_follow_each_other(spark, docs, rows):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact copies", "near copies", "personal data", "packing"]
    left, frame = [r for r in rows], docs.select("doc_id", "text", "lang", "source", "n_chars")
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = staged(stage(spark, frame, ""), "test")
        assert frame.columns == columns
        got = {r.doc_id: r for r in frame.collect()}
        if name == "language":
            letters = {r[0] for r in left if any(c.isalpha() for c in r[1] or "")}
            assert got.keys() <= letters and len(got) > 0.9 * len(letters)
            left = [r for r in left if r[0] in got]
        elif name == "exact copies":
            left = [r for r in left if r[0] in {x[0] for x in exact(left) if x[3]}]
        elif name == "near copies":
            left = [r for r in left if r[0] in {x[0] for x in near(left, 5, 80) if x[3]}]
        assert got.keys() == {r[0] for r in left}
    for i, t, *_ in left:
        assert got[i].text == t or base(t)
        assert not base(got[i].text) and got[i].n_chars == (len(got[i].text) if base(t) else len(t))
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, "").collect()
    assert check(packed, {i: r.text for i, r in got.items()}) == 0


def test_every_query_is_registered_and_runs(spark, data_dir):
    own = queries.queries()
    assert [n.split("_")[0] for n in own] == [f"op{k}" for k in range(1, 11)] + ["pipeline"]
    assert set(queries.oracle_sql()) <= set(own)
    assert corpus_pipeline.run(spark, data_dir).count() > 0


