import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts, start=0):
    return [(start + i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, an extra column."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t", "en", None, 3), (4, "one", None, "s", 3),
            (5, word * 3000, "en", "s", 1), (6, word * 2, "en", "s", 1), (6, word * 2, "en", "s", 1), (7, word * 2, "de", "s", 1),
            (None, word + "x", "en", "s", 1), (8, "Ünïcödé 日本語 😀 ﬁn\x00al", "fr", "s", 1), (9, "a" * 40000, "de", "s", 1)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
