import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rep string, size string, `key` string, h string"
LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(40_000))
ROWS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "two words"), (6, "the same text here again and again"), (7, "the same text here again and again"),
    (7, "the same text here again and again"), (8, LONG), (9, LONG + " tail"), (10, "x" * 300_000), (None, "no id at all for this one"), (None, None), (11, "émigré – ünïcödé 😀 text"), (12, "...!!!"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Null ids, texts, languages and sources, empty and very long texts, repeated rows, and columns with awkward names."""
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, 1.5, "a", "b", "c", "d") for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in (4, 5, 6, 7, 8, 9, 10)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
