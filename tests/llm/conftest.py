import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


@pytest.fixture(scope="session")
def documents(spark):
    """Edge cases, repeated rows and clashing column names."""
    p = " ".join(f"word{i % 17}x{i % 5}" for i in range(60))
    rows = [
        (1, p, "en", "a"), (2, p, "en", "a"), (2, p, "en", "a"), (3, p + " tail", "en", None), (4, None, None, "b"),
        (5, "", "fr", "b"), (6, " \t\n", "fr", "b"), (7, "ab", "fr", "c"), (8, "long " * 20000, "de", "c"),
        (9, "x y", None, "c"), (10, "Été " * 30 + p, "fr", "d"), (11, p.upper(), "en", "d"),
    ]
    return spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string")


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.where("false")
