import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and blank texts, repeated rows, odd characters, a long text."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(6000))
    return [
        (1, "The quick brown fox jumps over the lazy dog. " * 8, "en", "a", 1),
        (2, None, "en", None, None),
        (3, "", None, "a", 0),
        (4, " \t\n ", "de", "a", 4),
        (5, "The quick brown fox jumps over the lazy dog. " * 8, "en", "a", 1),
        (5, "The quick brown fox jumps over the lazy dog. " * 8, "en", "a", 1),
        (None, "no id but text that is here", "en", "b", 3),
        (None, None, None, None, None),
        (7, long, "en", "a", 9),
        (8, long + " tail", "en", "a", 9),
        (9, "ÉTÉ ▁ été  日本 🙂 a b   x\n\n\ty " * 5, "fr", "c", 5),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
