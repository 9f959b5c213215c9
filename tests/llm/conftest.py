import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def con(sf):
    import check_queries

    return check_queries.connect(sf)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns."""
    long = "alpha beta gamma delta " * 60_000
    line = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [
        (1, line, "en", "a", 1, "x"), (2, line, "en", "a", 1, "y"), (2, line, "en", "a", 1, "y"),
        (3, None, "en", "b", None, None), (4, "", None, None, 0, "x"), (None, line + " more", "fr", "b", 2, "x"),
        (None, None, None, None, None, None), (5, " \t\n ", "de", "a", 3, "x"), (6, long, "en", "c", 9, "x"),
        (7, "été ÉTÉ \U0001f600 x\x00y", "fr", "\U0001f600", 4, "x"), (8, "12345 !!", "en", "c", 5, "x"),
    ]
    extra = "size string, shard_ string, score_ string"
    frame = spark.createDataFrame([r[:5] + (r[5], r[5], r[5]) for r in rows], f"{DOCS}, {extra}")
    return frame.withColumnRenamed("shard_", "shard").withColumnRenamed("score_", "score")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def near():
    return lambda a, b: math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
