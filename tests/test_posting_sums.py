import numpy as np
import pyarrow as pa

from msgspark.functions.postings import BestOfLists, Part, invert
from msgspark.operators import postings


def test_long_lists_are_added_up_while_many_rows_can_win(monkeypatch):
    """Rows of like weights: a lookup for nearly every row would cost more than the list."""
    draw = np.random.default_rng(2)
    weights = draw.uniform(0.9, 1.1, (600, 6))
    names = [f"{i:04}" for i in range(600)]
    listed = pa.array([list(range(6))] * 600, pa.list_(pa.int32()))
    table = pa.table({"id": names, "buckets": listed, "weights": weights.tolist()})
    asked = np.full(6, 6**-0.5)
    looked_up, plain = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda at, rows: looked_up.append(len(rows)) or plain(at, rows))
    best = BestOfLists([(list(range(6)), asked)], 4)
    for n, first in enumerate(range(0, 600, 300)):
        best.add_part(Part([invert(n, table.slice(first, 300))]))
    scores = np.round(weights / np.linalg.norm(weights, axis=1, keepdims=True) @ asked, 6)
    assert best.rows[0] == sorted((-s, i) for s, i in zip(scores.tolist(), names, strict=True))[:4]
    assert best.there == 3600 and max(looked_up, default=0) < 300 / 3  # of a list's 300 entries


def test_a_scan_is_narrowed_only_where_much_is_left_out(spark, tmp_path):
    rows = [(i, b) for i in range(3) for b in range(-1, 300)]
    made = spark.createDataFrame(rows, "part long, bucket int").selectExpr(
        "part", "bucket", "0.0D AS top", "array(1) AS at", "array(1.0D) AS weights", "cast(null AS array<string>) AS ids"
    )
    made.write.parquet(str(tmp_path / "lists"))
    for asked, most in ((list(range(0, 300, 3)), 300), ([b for b in range(300) if b % 5], 1), ([4, 5, 280], 2), ([], 0)):
        read = postings.read_postings(spark, str(tmp_path / "lists"), asked)
        pushed = next(x for x in read._jdf.queryExecution().executedPlan().toString().split("\n") if "PushedFilters" in x)
        assert pushed.split("PushedFilters")[1].count("LessThanOrEqual") <= most
        assert sorted((r.part, r.bucket) for r in read.collect()) == [(i, b) for i in range(3) for b in [-1, *asked]]
