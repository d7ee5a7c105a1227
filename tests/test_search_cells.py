import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from msgspark.functions import topk
from msgspark.operators import retrieval


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_sets_of_cells_are_placed_by_one_python_worker(spark):
    draw = np.random.default_rng(5)
    rows = spark.createDataFrame([(str(i), draw.normal(size=4).tolist()) for i in range(60)], "id string, embedding array<double>")
    sets = [rows.filter(F.col("id").cast("int") % 3 == k) for k in range(3)]
    placed = retrieval._in_sets(rows, sets, 2)
    assert plan(placed).count("MapInArrow") == 1
    single = [{r.id: r.cells for r in retrieval.place_in_cells(rows, own, 2).collect()} for own in sets]
    for r in placed.collect():
        assert r.cells == [f"{k}:{c}" for k in range(3) for c in single[k][r.id]]


def test_questions_of_a_cell_take_a_byte_each():
    cells = pa.array([["a", "b"], ["b", "c"], [], ["a", "a"]], pa.list_(pa.string()))
    found = topk.by_cell(cells)
    assert {c: a.tolist() for c, a in found.items()} == {
        "a": [True, False, False, True], "b": [True, True, False, False], "c": [False, True, False, False],
    }
    assert all(a.nbytes == 4 for a in found.values())
