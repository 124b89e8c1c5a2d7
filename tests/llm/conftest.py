import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component long, bands string"


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns whose names the operators also use."""
    base = "the quick brown fox jumps over the lazy dog and runs away from every other animal in this rather old forest near town "
    rows = [
        (1, base * 4, "en"), (2, base * 4, "en"), (2, base * 4, "en"), (3, base * 4 + "today", None), (4, "", "en"), (5, None, None), (None, base * 4, "en"), (None, None, None),
        (6, "   \n\t ", "de"), (7, "123 456 !!!", None), (8, "word " * 30_000, "en"), (9, "der hund und die katze sind nicht im haus aber auf dem dach " * 5, "de"),
        (10, "der hund und die katze sind nicht im haus aber auf dem baum " * 5, "de"), (11, "\u0000\U0001f600 é́ ǅ", "de"), (12, "one two", "en"), (13, "ONE two", "en"),
    ]
    return spark.createDataFrame([(i, t, lang, None, None, 7, "x") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (8, 0, None), (9, None, 1), (None, 1, 1), (10, 1, 1), (10, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
