import random

import pytest


def prose(seed, words):
    rng = random.Random(seed)
    syllables = ["on", "the", "er", "tion", "is", "an", "re", "ly", "ou", "wh"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def make_prose():
    return prose


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty, blank and very long texts, repeated rows, and columns whose names operators use."""
    long = prose(1, 40_000)
    base = prose(2, 300)
    data = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail", "en", None), (4, None, "en", "b"),
        (5, "", None, "b"), (6, " \n\t ", "de", "b"), (None, base, None, None), (None, None, None, None), (7, long, "en", "c"),
        (8, long[1000:], "en", "c"), (9, "two words", "de", "c"), (10, "two words", None, "c"), (11, "1234 567 !?", "de", "a"),
    ]
    columns = "doc_id bigint, text string, lang string, source string"
    rows = [(*r, len(r[1] or ""), 0.5, "x", [1], "y", "z", 1, b"k") for r in data]
    return spark.createDataFrame(
        rows, columns + ", n_chars bigint, score double, spans string, ids array<int>, mark string, key string, n int, keys binary").coalesce(2)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("1 = 0")
