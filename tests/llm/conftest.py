import pytest


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) rows, with columns whose names clash with inner ones."""
    def make(rows):
        names = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, text_key long, part int, kept string, row long, key string"
        return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 1 else None, len(t or ""), 7, "x", 9, 5, "k", 3, "y") for i, t in rows], names)
    return make


HARD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a"), (5, "a b"), (6, "A B c"), (7, "a b C"), (None, "a b c"), (None, None),
    (8, "one two three"), (8, "one two three"), (9, "é" * 300 + " ñ  x"), (10, "w " * 5000), (11, " ".join(f"v{i}" for i in range(30_000))),
    (12, "\x00 odd   line\x85 end "), (13, "\U0001f600 \U0001f600"),
]


@pytest.fixture
def hard(docs):
    """NULLs, empty and very long texts, ties and repeated rows."""
    return docs(HARD)
