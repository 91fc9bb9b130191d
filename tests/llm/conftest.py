from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, key string, bands int"


def corpus(seed: int = 5) -> list[tuple]:
    """Small documents with copies, near copies, shared passages, personal data, nulls, empties and one long text."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(80)
    texts: list[str | None] = [None, "", " ", "\n\t", "one", "Two words", "É è ß 日本", "x" * 3000, None, ""]
    for _ in range(40):
        texts.append(text(rng.randint(3, 150)))
    base = text(200)
    for _ in range(30):
        own = base.split()
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    for k in range(20):
        texts.append(text(rng.randint(0, 40)) + " " + passage + " " + text(rng.randint(0, 40)))
    texts += [t.upper() if t else t for t in texts[10:20]] + texts[12:18]
    texts += ["line of words\n" * 60, "a b c d e f g " * 100, "a b c d e f g " * 90, "write to bob.k@mail.example.com or +1 (706) 555-3138, 10.0.0.255, card 4111-1111 1111 1111."]
    texts.append(text(3000))
    rng.shuffle(texts)
    return [(i * 3 + 1, t, rng.choice(["en", "de", None]), "src", len(t or ""), "n", "k", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    """The corpus with extra columns whose names the operators use inside."""
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
