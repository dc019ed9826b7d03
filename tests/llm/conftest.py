import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, size int, block long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def row(doc_id, text, lang="en", source="src0"):
    """A row with columns whose names the operators use inside."""
    return (doc_id, text, lang, source, None if text is None else len(text), 1.0, 7, 3, 9)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and very long texts, ties, and repeated rows."""
    rows = [
        row(1, " ".join(WORDS)), row(2, " ".join(WORDS)), row(2, " ".join(WORDS)), row(3, None), row(4, ""), row(5, " \n\t"),
        row(6, "one"), row(None, "one two"), row(7, " ".join(WORDS * 3000), None, None), row(8, "ÀÉ ß Straße İ 漢字   x", "de"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
