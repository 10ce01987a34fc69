import random

import pytest

ODD = [None, "", " ", "  a  b ", "x", "one two", "a\n b\n\n", "Ünïcode 😀 ÀÉß", "don't DON'T", "word " * 20_000, "a" * 30_000, "\x00\x1c　 z", "same text here again", "same text here again"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, a null id, repeated rows, and columns named like results."""
    rows = [(None if k == 3 else k, t, "en" if k % 2 else None, "s", len(t or ""), 1, "2", 3.0) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, lang string, source string, n_chars long, n_words int, spans string, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture
def rng():
    return random.Random(5)
