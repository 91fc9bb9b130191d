from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from seisframe.llm import piece_bpe, vocabulary

FILE = vocabulary.path(vocabulary.PIECES)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


def test_corpus_equals_library(docs, rows, library):
    got = {r.doc_id: r for r in piece_bpe.digests(docs, FILE).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_hard_texts_equal_library(library):
    rng = random.Random(1)
    parts = ["-", "*", "=", " ", "  ", "a", "b", "e", "text", "enc", "ence", "tex", "t", "\n", "\t", "é", "日", "🙂", "\x00", "▁", "<s>", "<0x41>", "​", "the", "ing", "    ", "."]
    texts = ["".join(rng.choice(parts[: rng.choice([3, 6, len(parts)])]) for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    texts += [" " * k for k in range(150)] + [" " * k + "foo" for k in range(80)] + ["-" * k for k in range(120)] + ["ab" * 6000]
    codec = piece_bpe.Codec(FILE)
    ids, offsets = codec.encode(texts)
    decoded = codec.decode_all(ids, offsets)
    for k, want in enumerate(library.encode(texts)):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want, texts[k]
        assert decoded[k].decode() == library.decode(want)


def test_decoding_any_ids(library):
    codec, rng = piece_bpe.Codec(FILE), random.Random(2)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 8))]
        assert codec.decode(np.array(ids, dtype=int)) == library.decode(ids)


def test_forgetting_words_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(piece_bpe, "CACHE_WORDS", 5)
    codec = piece_bpe.Codec(FILE)
    for text in ("one two three four five six", "two three seven", "one two three four five six"):
        assert codec.encode([text])[0].tolist() == library.encode(text)


def test_column_and_empty_table(spark, nothing, library):
    assert piece_bpe.digests(nothing, FILE).collect() == []
    got = piece_bpe.encode_column(spark.createDataFrame([(None, "a b"), (2, None)], "doc_id long, text string"), FILE).collect()
    assert {r.doc_id: r.ids for r in got} == {None: library.encode("a b"), 2: []}


def test_long_segments_go_through_the_same_rounds(monkeypatch, library):
    """Segments split for low ranks first give the library's ids, whatever their length."""
    rng = random.Random(9)
    pieces = [p.text for p in vocabulary.piece_model(FILE).pieces if p.kind == vocabulary.NORMAL and vocabulary.SPACE not in p.text]
    parts = ["rio", "***", "//", "tha", "eston", "-----", "aci", "gin", "a", "b", "日本", "é", "==", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 300))) for _ in range(150)] + ["".join(rng.sample(pieces, 60)) for _ in range(60)] + ["a" * 20_000, "ab" * 9000, "*" * 9001]
    want = library.encode(texts)
    for long in (4, 50, 4096):
        monkeypatch.setattr(piece_bpe, "LONG_SEGMENT", long)
        own = piece_bpe.Codec(FILE)
        flat, offsets = own.encode(texts)
        assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want


def test_a_million_letters_without_a_space(library):
    rng = random.Random(1)
    text = "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(1_000_000))
    assert piece_bpe.codec(FILE).encode([text])[0].tolist() == library.encode(text)
