from __future__ import annotations

import zlib

import numpy as np
from tokenizers import Tokenizer

from seisframe.llm import packing, vocabulary


def check(pieces, texts, window=1024):
    """Every id lies in one piece, pieces fill sequences without gaps, and crc, totals and padding hold."""
    exact = Tokenizer.from_file(vocabulary.path(vocabulary.BYTE_BPE))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == texts.keys()
    for i, own in by_doc.items():
        ids = np.array([*exact.encode(texts[i] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_corpus_is_packed_without_padding(docs, rows):
    assert check(packing.pack(docs).collect(), {r[0]: r[1] for r in rows}) == 0


def test_small_window_and_special_strings(spark):
    texts = {1: "a <|endoftext|> b", 2: None, 3: "", 4: "word " * 500, 5: "é日本🙂 \n\t x"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert check(packing.pack(frame, window=64).collect(), texts, 64) == 0


def test_ids_are_those_of_the_library(monkeypatch):
    own = packing.ByteTokenizer()
    for text in (" " * 5_000_000, "\n" * 5_000_000 + "x", "a" * 5_000_000):
        assert own.encode_all([text])[0] == own._whole(text)
    odd = "\u0558 \u058b a\u0c5c1 \U00010940 \x85\xa0\u2003\u3000 ½²Ⅷ ١٢ \x00\x1c\x1f é日本🙂 ﬁ İ ß"
    texts = ["", " ", "  a  ", "don't", "1a!?", " x", "<|endoftext|>", "a <|endoftext|>b", "ab" * 3000, "\x00\n\n ", odd, "\n".join(odd), "one two  three four\nfive 6 seven é ß x " * 40, "word " * 9, *(f"a{chr(c)}a 1{chr(c)}1 .{chr(c)}. {chr(c)}{chr(c)}\n{chr(c)} 's '{chr(c)}" for c in range(128))]
    for kept in (500_000, 0):
        monkeypatch.setattr(packing.ByteTokenizer, "KEPT", kept)
        assert own.encode_all(texts) == [own._whole(t) for t in texts]
    assert own.odd and not own.odd & set("é日本½²")


def test_solution_approaches_the_histogram():
    parts = packing.combinations()
    assert (parts.sum(axis=1) == packing.WINDOW).all() and len(np.unique(parts, axis=0)) == len(parts)
    histogram = np.random.default_rng(0).poisson(30, packing.WINDOW)
    histogram[0] = 0
    x = packing.solve(histogram, parts)
    made = np.bincount(parts.ravel(), (x[:, None] * (parts > 0)).ravel(), packing.WINDOW)
    assert (x >= 0).all() and np.abs(made - histogram)[1:].sum() < 0.15 * histogram.sum()
    times = packing.rounded(x, parts, histogram)
    used = np.bincount(parts.ravel(), (times[:, None] * (parts > 0)).ravel(), packing.WINDOW)
    assert (used <= histogram).all() and (histogram - used) @ np.arange(packing.WINDOW) < 0.1 * (histogram @ np.arange(packing.WINDOW))
    left = histogram - used
    assert not ((parts == 0) | (left[parts] >= ((parts[:, :, None] == parts[:, None, :]).sum(axis=2)))).all(axis=1).any()  # nothing more fits
    assert not packing.solve(np.zeros(packing.WINDOW), parts).any()


def test_one_length_for_all_documents(spark):
    text = "a b c d e f g " * 100  # every rest has the same length, which no combination can use
    frame = spark.createDataFrame([(k, text) for k in range(300)], "doc_id long, text string").repartition(4)
    assert check(packing.pack(frame).collect(), {k: text for k in range(300)}) == 0


def test_the_solution_governs_all_tasks(spark):
    """However many tasks there are, nearly all tokens of rests stand in windows that combinations fill."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    shares = []
    for n in (1, 8):
        got = packing.pack(docs.repartition(n)).where(f"sequence_id >= {packing.FILLED}").collect()
        shares.append(sum(p.length for p in got if p.sequence_id >= packing.RESIDUAL) / sum(p.length for p in got))
    assert shares[0] == shares[1] < 0.25


def test_empty_table_and_null_ids(spark, nothing):
    assert packing.pack(nothing).collect() == []
    got = packing.pack(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")).collect()
    assert sum(p.length for p in got) == 9
