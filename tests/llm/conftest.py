import random

import pytest


def prose(seed, n, words=("the", "river", "ran", "over", "old", "stones", "and", "birds", "sang", "near", "green", "fields", "while", "children", "played")):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in all columns, empty and blank and very long texts, repeated rows, odd characters, extra columns that
    clash with names the operators use."""
    rows = [
        (1, prose(1, 60), "en", "a"),
        (1, prose(1, 60), "en", "a"),
        (2, prose(1, 60), None, None),
        (3, None, "en", "b"),
        (4, "", "fr", "b"),
        (5, " \n\t ", None, "c"),
        (None, prose(2, 50), "en", None),
        (None, None, None, None),
        (6, "12345 !!! 678", "de", "d"),
        (7, "wörter 日本語 \U0001f600 \u0000 end", "de", "d"),
        (8, prose(3, 40_000), "en", "e"),
        (9, "x" * 50_000, "en", "e"),
        (10, "one", "en", "e"),
    ]
    extra = [(*r, i, "z", i, 0.5, "q") for i, r in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, row long, base string, n long, score double, w string")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
