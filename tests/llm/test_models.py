from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from seisframe.llm import language_id, quality, vocabulary

FILE = vocabulary.path(vocabulary.PIECES)
SYLLABLES = {"aa": ["tion", "the", "ing", "er"], "bb": ["ung", "sch", "ein", "keit"], "cc": ["eau", "que", "oi", "ment"]}


def languages(n=240):
    rng = random.Random(4)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 30))), lang))
    return out


def test_forward_sums_all_segmentations():
    lattice = language_id.Lattice(["▁", "a", "b", "ab", "▁a", "ba"])
    prob = np.vstack([np.random.default_rng(1).uniform(0.05, 0.3, (6, 2)), np.zeros((1, 2))])
    p = dict(zip(lattice.pieces, prob, strict=False))

    def total(word):
        if not word:
            return np.ones(2)
        return sum((p[word[:k]] * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in p), np.zeros(2))

    words = ["▁ab", "▁aba", "▁", "▁abab", "▁bb"]
    assert np.allclose(lattice.log_likelihood(words, prob), [np.log(total(w)) for w in words])


def test_long_words_against_brute_force():
    """Scaled and plain sums agree, over the whole vocabulary and a word of 10,000 letters."""
    lattice = language_id.lattice(FILE)
    rng = np.random.default_rng(3)
    prob = np.vstack([rng.dirichlet(np.ones(len(lattice.pieces)), 2).T, np.zeros((1, 2))])
    p = dict(zip(lattice.pieces, prob, strict=False))
    text = "".join(rng.choice(list("station"), 10_000)) + "schlichkeit日本x"
    for word in (text, text[:40], "internationalization", "½"):
        logs, ratio = np.zeros((len(word) + 1, 2)), None
        for j in range(1, len(word) + 1):
            terms = [logs[j - s] + np.log(np.maximum(p.get(word[j - s : j], np.zeros(2)), 1e-9 if s == 1 else 1e-300)) for s in range(1, min(j, lattice.longest) + 1)]
            ratio = np.max(terms, axis=0)
            logs[j] = ratio + np.log(np.exp(np.array(terms) - ratio).sum(axis=0))
        assert np.allclose(lattice.log_likelihood([word], prob)[0], logs[-1], rtol=1e-9)
    assert lattice.longest > 12


def test_fit_raises_likelihood(spark):
    lattice = language_id.lattice(FILE)
    words, counts = ["▁station", "▁nation", "▁einung" + "ung" * 30], [[5, 0], [4, 0], [0, 9]]
    tally = spark.createDataFrame(list(zip(words, counts)), "word string, counts array<long>")
    prob = np.full((len(lattice.pieces) + 1, 2), 1 / len(lattice.pieces))
    prob[-1] = 0
    scores = []
    for _ in range(3):
        prob = language_id._maximised(tally, prob, FILE)
        scores.append((lattice.log_likelihood(words, prob) * np.array(counts)).sum())
    assert scores == sorted(scores) and np.allclose(prob.sum(axis=0), 1)


def test_letters_and_words_seen_once(spark):
    assert language_id.words_of("½ ² Ⅷ ① 12 _ a1b") == ["▁a", "▁b"]
    rows = [(2, "zug haltestelle", "de"), (3, "fenster gardine", "de"), (6, "railway carriage", "en"), (8, "window curtain", "en"), (10, "½ ² Ⅷ ①", "de"), (11, "haltestelle gardine", None), (12, "carriage window", None)]
    rows = [(i + 1000 * next(k for k in range(99) if zlib.crc32(str(i + 1000 * k).encode()) % 3 != 1), t, lang) for i, t, lang in rows]
    got = [(r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), FILE).orderBy("doc_id").collect()]
    by_text = {t: g for (_, t, _), g in zip(sorted(rows), got, strict=True)}
    assert by_text["½ ² Ⅷ ①"] == ("und", 0.0)
    assert by_text["haltestelle gardine"][0] == "de" and by_text["carriage window"][0] == "en"


def test_sample_is_bounded_and_equal_rows_count_once(spark):
    rows = spark.createDataFrame([(None, "same text", "en")] * 500 + [(i, f"text {i}", "de") for i in range(300)], "doc_id long, text string, lang string")
    got = language_id._sampled(rows, {"en": 1, "de": 300}, 50, 9).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got}["en"] == 1 and 30 <= {r["lang"]: r["count"] for r in got}["de"] <= 50


def test_language_accuracy_on_held_out(spark):
    rows = languages()
    extra = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !? \n", None), (1003, "schung einkeit", None), (1004, "x" * 5000, "aa")]
    frame = spark.createDataFrame([(*r, "src") for r in rows + extra], "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r for r in language_id.identify(frame, FILE).collect()}
    assert len(got) == len(rows) + len(extra)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in rows)
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.95
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got.values())


def test_nothing_learned_and_empty_table(spark, nothing):
    assert language_id.identify(nothing, FILE).collect() == []
    frame = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_id.identify(frame, FILE).first().lang_pred == "und"


def test_filter_keeps_columns_and_drops_und(spark):
    frame = spark.createDataFrame([(*r, 5) for r in languages(60)] + [(900, "!!", "aa", 5), (901, None, "aa", 5)], "doc_id long, text string, lang string, n_chars long")
    kept = language_id.keep_identified(frame, FILE)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == list(range(60))


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randint(5, 40))]
        docs.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words), "x"))
        labels.append((i, int(good) if i % 50 else None, 0))
    docs += [(900, None, "x"), (901, "", "x"), (902, "w" * 4000, "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3), spark.createDataFrame([*labels, (5000, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_on_held_out(graded):
    docs, labels = graded
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 603
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in range(600))
    assert np.mean([got[i].predicted == truth[i] for i in held if truth[i] is not None]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert got[900].score == got[901].score


def plain_scores(rows, asked, bits, updates):
    """Learning and scoring by plain loops over dictionaries; rows are (text, label) in the order of learning."""
    import math
    import re

    import xxhash

    mask, a, b = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

    def features(text):
        tokens = re.findall(r"\w+|[^\w\s]+", text)
        if not tokens:
            return {3: 1.0, 4: 1.0}
        h = [xxhash.xxh64_intdigest(t.lower()) for t in tokens]
        counts = {}
        for gram in h + [((((x * a) & mask) ^ ((y * b) & mask)) * a) & mask for x, y in zip(h, h[1:])]:
            at = (((gram * b) & mask) >> (64 - bits)) + 8
            counts[at] = counts.get(at, 0) + 1
        values = {k: 1 + math.log(n) for k, n in counts.items()}
        length = math.sqrt(sum(v * v for v in values.values()))
        return {3: 1.0, 1: sum(map(str.isupper, tokens)) / len(h), 2: sum(x == y for x, y in zip(h, h[1:])) / len(h)} | {k: v / length for k, v in values.items()}

    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= quality.L1:
            return 0.0
        return -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    for _ in range(min(quality.MOST, max(2, updates // len(rows)))):
        for text, label in rows:
            x = features(text)
            own = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(own[k] * v for k, v in x.items())))))
            for k, v in x.items():
                g = (p - label) * v
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / quality.ALPHA * own[k]
                n[k] = n.get(k, 0.0) + g * g
    return [1 / (1 + math.exp(-sum(weight(k) * v for k, v in features(t).items()))) for t in asked]


def test_quality_against_plain_loops(spark, graded):
    docs, labels = graded
    known = labels.where("quality is not null and doc_id < 80").selectExpr("doc_id", "quality as label")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = docs.join(known, "doc_id").selectExpr("doc_id", "label", "pmod(xxhash64(doc_id, coalesce(text, ''), 10), 1 << 30) as draw").orderBy("draw", "doc_id").collect()
    model = quality.train(docs, known, updates=400, bits=12)
    asked = docs.where("doc_id < 40 or doc_id >= 900")
    got = {r.doc_id: r.score for r in quality.score(asked, model).collect()}
    want = plain_scores([(texts[r.doc_id], r.label) for r in order], [texts[i] for i in got], 12, 400)
    assert np.allclose(list(got.values()), want, atol=1e-5) and max(want) - min(want) > 0.3


def test_quality_repeated_and_contradicting_labels(spark, graded):
    docs, labels = graded
    once = quality.train(docs, labels.where("quality is not null").selectExpr("doc_id", "quality as label"), updates=200)
    twice = labels.where("quality is not null").selectExpr("doc_id", "quality as label")
    assert np.array_equal(once.weights, quality.train(docs, twice.union(twice), updates=200).weights)
    both = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, label int")
    repeated = spark.createDataFrame([(1, "good words here")] * 900 + [(1, "other text")], "doc_id long, text string")
    score = quality.score(repeated, quality.train(repeated, both, sample=5, updates=10)).collect()
    assert len(score) == 901 and all(0.2 < r.score < 0.8 for r in score)


def test_quality_without_labels_or_rows(graded, nothing):
    docs, labels = graded
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(nothing, labels).collect() == []


def test_ftrl_learns_one_feature_and_stays_sparse():
    learner = quality.Ftrl(8)
    for _ in range(300):
        learner.learn(np.array([3, 9]), np.array([1.0, 0.5]), 1, 1.0)
        learner.learn(np.array([3, 20]), np.array([1.0, 0.5]), 0, 1.0)
    w = learner.weights()
    assert w[9] > 0.5 > -0.5 > w[20] and (w[[5, 30, 100]] == 0).all()
