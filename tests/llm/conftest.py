import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, columns with clashing names."""
    rows = [
        (1, "Alpha beta  gamma delta epsilon zeta", "en", "s0"),
        (2, "alpha beta gamma delta epsilon zeta", "en", "s0"),
        (3, "Alpha beta gamma\tdelta epsilon zeta", None, None),
        (4, None, "en", "s1"),
        (5, "", "fr", "s1"),
        (6, " \n ", None, "s1"),
        (7, "one", "de", None),
        (7, "one", "de", None),
        (8, "un deux trois " * 4000, "fr", "s0"),
        (9, "Éé ß <|endoftext|> \U0001f600 12,5", "fr", "s2"),
        (None, "no id", "en", "s2"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = ["digest", "keep_id", "hash", "fp", "shard", "bucket", "mix_copy", "parts", "cdf", "slot", "w", "score", "size"]
    return df.selectExpr("*", *[f"'x' as {c}" for c in clash])


@pytest.fixture(scope="session")
def with_ids(odd_docs):
    return odd_docs.filter("doc_id is not null")


@pytest.fixture(scope="session")
def none(odd_docs):
    return odd_docs.limit(0)
