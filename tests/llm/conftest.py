import pytest

#: Texts that every operator has to take: null, empty, blank, short, repeated, not ASCII, long.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "word"),
    (5, "word"),
    (6, "Ünïcödé wörds ﬁ ẞ 你好 🙂 and more words here, one two three four five six seven"),
    (7, "a" * 5000),
    (8, ("to be or not to be " * 40 + "\n") * 30),
    (9, ("to be or not to be " * 40 + "\n") * 30),
    (None, "a row without an id"),
    (9, ("to be or not to be " * 40 + "\n") * 30),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with columns whose names clash with those used inside."""
    rows = [(i, t, None if i is None else "en", None, i, "x", 0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id long, row string, fp int")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
