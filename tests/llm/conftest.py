import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

PROSE = " ".join(f"{a}{b}" for a in ("river", "stone", "light", "field", "morning", "winter") for b in ("", "s", "er", "ing", "ful", "less", "side", "bank", "ward", "land"))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like results."""
    rows = [
        (0, PROSE, "en", "a", 1), (1, PROSE, "en", "a", 1), (1, PROSE, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "", 0),
        (4, " \n\t ", None, "a", 4), (None, PROSE + " tail", "en", None, 9), (5, "one", "en", "b", 3), (6, "a b c", "de", "b", 5),
        (7, "word " * 30_000, "en", "b", 150_000), (8, "x" * 100_000, "fr", "b", 100_000), (9, "\x00 é 😀 ▁ �   end", None, "c", 10),
        (10, PROSE.replace("river ", "brook "), "en", "c", 1), (None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, FIELDS)
    for name in ("score", "cls", "n", "a", "b", "prefix", "label", "slot", "shard", "held_out", "signature", "coverage", "features", "__word", "found"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], FIELDS)


def crc(key, parts):
    return zlib.crc32(str(key).encode()) % parts
