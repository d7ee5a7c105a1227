import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from msgspark.functions import vectors
from msgspark.operators import index


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEXTS = ["a b a", "...", "", None, "漢字 go 漢", "Ünï İx ǅ x-x_y", " lead  trail ", "z " * 90, "１２ 12 ①"]


@pytest.mark.parametrize("most", [1, 4, 1 << 20])
def test_term_vectors_are_those_of_the_terms(spark, monkeypatch, most):
    made = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    rows = made.select(
        "id", vectors._words(F.col("text")).alias("words"),
        F.transform(vectors.terms(F.col("text")), lambda w: vectors.term_bucket(w, 7)).alias("own"),
        vectors.term_vector(F.col("text"), 7).alias("v"),
    ).orderBy("id").collect()
    monkeypatch.setattr(vectors, "WORDS", most)
    here = vectors.weighed(pa.array([r.words for r in rows], pa.list_(pa.string())), 7).to_pylist()
    for r, v in zip(rows, here, strict=True):
        found, counts = np.unique(np.array(r.own or [], dtype=int), return_counts=True)
        assert r.v.buckets == v["buckets"] == found.tolist()
        assert r.v.weights == v["weights"] == (counts / np.sqrt((counts * counts).sum()) if len(counts) else counts).tolist()
    assert vectors.weighed(pa.array([], pa.list_(pa.string())), 7).to_pylist() == []


def test_words_are_hashed_in_one_python_step(spark):
    made = spark.createDataFrame([("1", "x y")], "id string, text string")
    found = plan(index.with_vectors(made))
    assert found.count("ArrowEvalPython") == 1 and "md5(lambda" not in found
