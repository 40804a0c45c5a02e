import random

import pytest

#: Columns that clash with names that the operators use themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, score double, leaks string, row string, tk string, node string, h string, taken int"


def words(rng, n, kind="abc"):
    return " ".join("".join(rng.choice(kind) for _ in range(rng.randint(2, 6))) for _ in range(n))


def frame(spark, rows):
    """rows: (doc_id, text, lang, source)"""
    return spark.createDataFrame([(d, t, g, s, None, 1, 2.0, "x", "y", "z", "n", "h", 3) for d, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank, very long and repeated texts, a null doc_id, ties."""
    rng = random.Random(5)
    base = words(rng, 60)
    return [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t", None, None),
        (4, base, "en", "a"),
        (4, base, "en", "a"),
        (5, base, "en", "b"),
        (6, base.replace(" ", "  ").upper(), "en", "b"),
        (7, words(rng, 30_000), "en", "b"),
        (8, "x" * 200_000, None, "c"),
        (None, words(rng, 40, "xyz"), "fr", None),
        (None, None, None, None),
        (9, "1234 5678 !!", "fr", "c"),
        (10, "\U0001f600 é ß   end", "fr", "c"),
        (11, base + " one more", None, "c"),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    return frame(spark, odd_rows)


@pytest.fixture
def none(spark):
    return frame(spark, [])
