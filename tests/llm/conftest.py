import pytest

#: Rows that every operator on texts must stand: null, empty and long texts, ties, repeats.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, None),
    (3, ""),
    (4, "   \n\t\n"),
    (5, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (6, "Line one is here for all\nshort\nLine two is here for all\n"),
    (7, "  line ONE is here for all \nother words follow\nLine two is here for all"),
    (8, "é" * 50 + " ünïcödé wörds — with “quotes” and 数字 12345 and ΟΔΟΣ"),
    (9, "word " * 30000),
    (10, "x"),
    (None, "a row without an id\nLine one is here for all"),
    (11, "same row twice"),
    (11, "same row twice"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """documents with odd rows and columns whose names clash with results."""
    rows = [(i, t, None if i is None or i % 2 else "en", "s", len(t or ""), 7, "x") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, found string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
