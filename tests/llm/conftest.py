import pytest

#: What every operator on documents must take: nulls in any column, empty and blank texts,
#: a very long text, ties, repeated rows, and columns named like its own.
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 10, "x", 1),
    (2, "the quick brown fox jumps over the lazy dog", None, "a", None, None, 2),
    (2, "the quick brown fox jumps over the lazy dog", None, "a", None, None, 2),
    (3, None, "en", None, 0, "x", None),
    (4, "", "en", "b", 0, "x", 4),
    (5, " \n\t ", "en", "b", 0, "x", 5),
    (6, LONG, "en", "b", 0, "x", 6),
    (None, "no id here at all", "en", "b", 0, "x", 7),
    (None, None, None, None, None, None, None),
    (9, "the quick brown fox jumps over the lazy cat", "en", "a", 10, "x", 1),
    (10, "Zürich 中文 ’quotes’ \U0001f600 x", "de", "a", 10, "x", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp long"


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
