import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, shard int, keys string, lang string"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with those that operators use."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "a"), (5, "a"), (6, "ab " * 9000), (7, base), (8, base), (8, base), (9, base + "tail"), (10, "x" * 49), (11, "x" * 50), (12, "x" * 120),
        (None, base), (13, "é" * 60 + " naïve café — ok   \U0001f600"), (14, "é" * 60), (15, "\n\n\nA\n\nB\n"), (16, "A B C"), (17, "a b c"), (18, "abc" * 40), (19, "zabc" + "abc" * 40),
    ]
    return spark.createDataFrame([(i, t, 0, "k", None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})
