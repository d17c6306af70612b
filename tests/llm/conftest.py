import pytest

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, h string, kept string, size double, n_words string, part int"
EXTRA = (7, "x", "y", 0.5, "z", 1)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal texts, extra columns with names that clash."""
    long = "once upon a time there was " * 3000
    mixed = "The Ärger of naïve words, 中文 text & <tags> | 42!\nsecond line of words here\nsecond line of words here\n" * 2
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "word", None, None), (3, "word", None, None), (None, "word", "de", "b"), (None, None, None, None), (5, long, "en", "b"), (6, long, "en", "c"), (7, mixed, "de", "a"), (8, " \n\t ", "fr", "d"), (9, "a b", "en", "e"), (10, "12 34 \x00 56", "en", "a"), (11, "   x" * 3, "es", "f")]
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), *EXTRA) for i, t, lang, source in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
