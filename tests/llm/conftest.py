import pytest

ROWS = "doc_id long, text string, keep_id string, Fingerprint int, kept string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and blank texts, a very long one, ties, repeated rows, clashing column names."""
    long = "lorem ipsum dolor " * 20_000
    rows = [(1, "same text here now", "x", 1, "y"), (2, "same  text\there now", None, None, None), (2, "same  text\there now", None, None, None), (3, None, "x", 1, "y"), (4, "", "x", 1, "y"), (5, " \t\n", "x", 1, "y"), (6, long, "x", 1, "y"), (7, long + "x", "x", 1, "y"), (None, "no id", "x", 1, "y"), (None, None, None, None, None), (8, "one", "x", 1, "y"), (9, "😀 ünï — ＡＢ   　 <|endoftext|>", "x", 1, "y")]
    return spark.createDataFrame(rows, ROWS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ROWS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
