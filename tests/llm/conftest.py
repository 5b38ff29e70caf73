import pytest

#: Texts that every operator must take: null, empty, blank, short, long, repeated, ties.
ODD = [None, "", " \n\t", "a", "!!!", "word " * 3000, "é🙂日本語 text", "Same text twice here", "Same text twice here"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, h string, w string, key string, spans string, c int"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in any column, repeated rows and ids, and columns named like the operators' own."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, 1, "x", "y", "k", "s", 1) for i, t in enumerate(ODD)]
    rows += [rows[7], (None, "no id at all", "fr", "s", 3, 1, "x", "y", "k", "s", 1), (None, None, None, None, None, None, None, None, None, None, None), (3, "another text of the same id", "en", "s", 1, 1, "x", "y", "k", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
