import pytest

LONG = "lorem ipsum dolor " * 20_000
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, "The cat and the dog are in the house of the king, and it is warm.", "en", "a", 10, 1, "x"),
        (2, None, "en", "a", None, 1, None),
        (3, "", None, "b", 0, 2, "y"),
        (4, LONG, "en", None, len(LONG), 3, "z"),
        (5, "Der Hund und die Katze sind nicht in dem Haus.", "de", "b", 5, 4, "x"),
        (5, "Der Hund und die Katze sind nicht in dem Haus.", "de", "b", 5, 4, "x"),
        (6, " \t\n ", "fr", "c", 4, 5, "x"),
        (7, "ö日本語😀 tail", "ja", "c", 9, 6, None),
        (8, BASE, "en", "c", len(BASE), 7, None),
        (9, BASE.upper(), "en", "c", len(BASE), 7, None),
        (None, "no number here", "en", "a", 14, 8, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, kept string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
