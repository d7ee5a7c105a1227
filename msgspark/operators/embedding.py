"""Embedding of texts: built-in hashed terms, or any user-supplied model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import DIM, term_vector

BATCH = 100


def hashed_embeddings(df: DataFrame, dim: int = DIM, text: str = "text") -> DataFrame:
    """Add ``buckets`` and ``weights``: hashed term frequencies, L2-normalised."""
    made = df.withColumn("_v", term_vector(F.col(text), dim))
    return made.withColumn("buckets", F.col("_v.buckets")).withColumn(
        "weights", F.col("_v.weights")
    ).drop("_v")


def vector_rows(df: DataFrame, key: str = "id") -> DataFrame:
    """Sparse vectors as rows ``key, bucket, weight``."""
    pairs = F.arrays_zip("buckets", "weights")
    rows = df.select(key, F.explode_outer(pairs).alias("_p")).filter(F.col("_p").isNotNull())
    return rows.select(
        key, F.col("_p.buckets").alias("bucket"), F.round("_p.weights", 6).alias("weight")
    )


def embed_batches(
    df: DataFrame,
    model: Callable[[list[str]], np.ndarray],
    batch_size: int = BATCH,
    text: str = "text",
) -> DataFrame:
    """Add ``embedding`` from a model that maps a list of texts to one row per text.

    The model is called with at most ``batch_size`` texts, in row order; an empty
    partition never calls it. A failed call fails the task, and Spark retries it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), batch_size):
                part = frame.iloc[first : first + batch_size]
                vectors = np.asarray(model(part[text].tolist()), dtype=np.float32)
                if len(vectors) != len(part):
                    raise ValueError("the model must return one vector per text")
                yield part.assign(embedding=list(vectors))

    schema = T.StructType(df.schema.fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return df.mapInPandas(run, schema)


def embed_or_reject(
    df: DataFrame,
    model: Callable[[list[str]], np.ndarray],
    batch_size: int = BATCH,
    text: str = "text",
) -> DataFrame:
    """Add ``embedding`` and ``reason``: texts that the model fails for do not stop the others.

    A batch that fails is tried again text by text; a text that fails alone gets no
    embedding and the failure as its reason, all others have none. Write the result
    before it is split with ``embedded`` and ``rejected``, so the model is called once.
    """

    def attempt(texts: list[str]) -> tuple[list, list]:
        try:
            vectors = np.asarray(model(texts), dtype=np.float32)
            if len(vectors) != len(texts):
                raise ValueError("the model must return one vector per text")
            return list(vectors), [None] * len(texts)
        except Exception as failed:  # whatever a user's model raises
            if len(texts) == 1:
                return [None], [f"{type(failed).__name__}: {failed}"]
        tried = [attempt([t]) for t in texts]
        return [v for own, _ in tried for v in own], [r for _, own in tried for r in own]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), batch_size):
                part = frame.iloc[first : first + batch_size]
                vectors, reasons = attempt(part[text].tolist())
                yield part.assign(embedding=vectors, reason=reasons)

    added = [T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("reason", T.StringType())]
    return df.mapInPandas(run, T.StructType(df.schema.fields + added))


def embedded(tried: DataFrame) -> DataFrame:
    """Rows of ``embed_or_reject`` with an embedding."""
    return tried.filter("reason is null").drop("reason")


def rejected(tried: DataFrame) -> DataFrame:
    """Rows of ``embed_or_reject`` that failed, with the reason."""
    return tried.filter("reason is not null").drop("embedding")


def embed_missing(
    df: DataFrame,
    existing: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    vector: list[str],
) -> DataFrame:
    """Embed only the rows without a vector for the same id and the same text.

    ``existing`` holds ``id``, ``text_hash`` (md5 of the text) and the ``vector``
    columns that ``embed`` adds. Decided row by row, not by the first row.
    Of several vectors for one id and text any one is used.
    Output: the columns of ``df``, the vector columns and ``reused``.
    """
    keyed = df.withColumn("text_hash", F.md5("text"))
    known = existing.select("id", "text_hash", *vector).dropDuplicates(["id", "text_hash"])
    kept = keyed.join(known, ["id", "text_hash"]).withColumn("reused", F.lit(True))
    todo = keyed.join(known.select("id", "text_hash"), ["id", "text_hash"], "left_anti")
    made = embed(todo).withColumn("reused", F.lit(False))
    columns = [*df.columns, *vector, "reused"]
    return kept.select(columns).unionByName(made.select(columns))
