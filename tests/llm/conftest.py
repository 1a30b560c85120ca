from __future__ import annotations

import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = "word " * 30000 + "tail"
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n", None, None, None), (4, "Same text here", "en", "a", 14), (5, "Same\ntext  here", "en", "b", 15),
        (6, "Same text here ", "en", "b", 15), (None, "Same text here", "de", None, 14), (7, long, "en", "a", len(long)), (8, "repeated row", "en", "a", 12),
        (8, "repeated row", "en", "a", 12), (9, "Ünïcode \U0001F600   text \x1c end <|endoftext|> x", "fr", "a", 3)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(documents):
    """Extra columns named as the operators' own."""
    from pyspark.sql import functions as F

    extra = {c: F.lit("x") for c in ("_key", "key", "fp", "n", "length", "copies", "copy", "rate", "_keep", "kept", "spans", "rid", "word", "_rank", "part", "score", "held_out", "label")}
    return documents.withColumns(extra)
