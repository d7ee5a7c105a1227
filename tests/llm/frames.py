"""Small tables of the corpus tests."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    # names that operators use themselves, to be ignored or replaced
    T.StructField("n_lines", T.StringType()),
    T.StructField("component_id", T.StringType()),
    T.StructField("score", T.StringType()),
    T.StructField("hash", T.StringType()),
])


def docs(spark, rows):
    """Rows of (doc_id, text); the other columns hold text that nobody may read."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "h") for i, t in rows], SCHEMA)


def words(seed, n, vocabulary=60):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def prose(seed, n, vocabulary=60):
    return " ".join(words(seed, n, vocabulary))


ODD = [
    (None, None),
    (None, "no id at all, just a text"),
    (1, ""),
    (2, None),
    (3, " \n\n \t"),
    (4, "\n"),
    (5, "é" * 40 + " ß" * 40),
]
