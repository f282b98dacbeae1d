import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ["score", "predicted", "fp", "row", "component_id", "fingerprint", "representative", "domain", "tokens", "epoch", "spans", "items", "n", "key", "label", "cell", "language", "kept"]
CLEAN = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix twelve potions near some old castle wall"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"word{k % 997}x{k % 89}" for k in range(120_000))
    rows = [
        (1, CLEAN, "en", "src1", 10), (1, CLEAN, "en", "src1", 10), (2, CLEAN + " indeed", "en", "src1", None), (3, None, "en", "src2", 0), (4, "", None, None, 0),
        (5, " \t\n ", "de", "src2", 3), (None, "no id here " * 9, "fr", None, 5), (None, None, None, None, None), (6, long, "es", "src3", len(long)), (7, "\u0000�😀 é̂ ß 漢字", "xx", "", 9),
        (8, "a", "en", "src1", 1), (9, "word " * 400, "en", "src1", 2000),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in EXTRA])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tables():
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    return folder
