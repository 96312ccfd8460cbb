"""Small documents with every odd case: nulls, empty, blank, very long, ties, repeats, clashing columns."""

import pytest

LONG = "the quick brown fox jumps over the lazy dog " * 4000
TEXTS = [
    None, "", "   \n ", "a", "!!! ??? 123", "Straße ÀÉ 中文字 ΑΣ don't", LONG, "x" * 30_000,
    "one two three four five six seven eight nine ten eleven twelve",
    "One TWO three, four five six seven eight nine ten eleven twelve",
    "one two three four five six seven eight nine ten eleven thirteen",
]


@pytest.fixture(scope="session")
def odd(spark):
    """doc_id, text and columns whose names the operators' outputs use; two rows are repeated."""
    rows = [(k, t, None if k % 3 else "en", "s", k, "clash", 0.5) for k, t in enumerate(TEXTS)]
    rows += [rows[8], (None, "no id here at all", None, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_words long, hits string, score double"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
