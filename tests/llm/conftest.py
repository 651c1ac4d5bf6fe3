import pytest

#: Clashing names, and a column that no operator knows.
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, _t string, kept boolean, key string"


def odd_rows():
    long = "lorem ipsum dolor, sit amet. " * 4000
    texts = [None, "", "", "one", "one", "A line that is long enough\nA line that is long enough\nshort", "a line that is long enough \n\n", long, long, long + "x", "\n\n\n", "😀 emoji, text. 😀"]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i % 5 else None, i, "d", "t", True, "k") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "one", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, a repeated row, names that clash."""
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
