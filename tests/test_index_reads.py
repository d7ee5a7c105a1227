import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from msgspark.operators import index
from msgspark.schemas import CHUNK
from msgspark.sources.storage import fresh_path


def chunk(id, text):
    return (id, text, "c", "c", "u", "1", "", 0)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_index_of_one_write_is_only_scanned_whatever_its_size(spark, monkeypatch):
    monkeypatch.setattr(index, "MOST_SENT", 0)
    path = fresh_path(spark, "one")
    rows = [chunk("a", "one"), chunk("a", "two"), chunk("b", "three"), chunk(None, "lost")]
    index.append(spark.createDataFrame(rows, "id string, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in CHUNK.fields if f.name != "id")), path, 1)
    opened = index.current(spark, path)
    assert "hashpartitioning" not in plan(opened) and "SortMergeJoin" not in plan(opened)
    assert sorted((r.id, r.text) for r in opened.collect()) == [("a", "one"), ("b", "three")]
    index.append(spark.createDataFrame([chunk("b", "new")], CHUNK), path, 2)
    assert sorted((r.id, r.text) for r in index.current(spark, path).collect()) == [("a", "one"), ("b", "new")]


def many(spark, first, last, text, version="1"):
    return spark.range(first, last, 1, 3).selectExpr(
        "concat('c', id, '-chunk-0') AS id", f"'{text}' AS text", "'c' AS channel", "'c' AS channel_name",
        "'u' AS user", "'1' AS ts", "'' AS permalink", "0 AS chunk_index", f"'{version}' AS version",
    )


@pytest.mark.parametrize("compacted", [True, False])
def test_many_late_rows_are_merged_by_bits_that_mark_the_replaced_ones(spark, monkeypatch, compacted):
    path = fresh_path(spark, "marks")
    index.append(many(spark, 0, 120_000, "old"), path, 1)
    if compacted:
        assert index.compact(spark, path)
    index.append(many(spark, 70_000, 130_000, "new"), path, 2)
    index.append(many(spark, 60_000, 71_000, "older", "0"), path, 3)
    index.append(many(spark, 129_990, 129_999, "last", "2").unionByName(
        many(spark, 0, 1, "lost").withColumn("id", F.lit(None).cast("string"))), path, 4)

    def seen():
        rows = index.current(spark, path)
        return {r.text: (r.n, r.s) for r in rows.groupBy("text").agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s")).collect()}

    monkeypatch.setattr(index, "MOST_SENT", 0)
    found = seen()
    assert {k: n for k, (n, _) in found.items()} == {"old": 70_000, "new": 59_991, "last": 9}
    opened = index.current(spark, path)
    assert "bitmap_construct_agg" in plan(opened) and "SortMergeJoin" not in plan(opened)
    monkeypatch.setattr(index, "MOST_MARKED", 0)
    assert "bitmap_construct_agg" not in plan(index.current(spark, path)) and seen() == found
    monkeypatch.undo()
    assert seen() == found
    monkeypatch.setattr(index, "MOST_SENT", 0)
    assert index.compact(spark, path) and seen() == found
    assert index.count(spark, path) == 130_000


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for f in Path(d.getPath()).rglob("shuffle_*.data")}


def test_a_compaction_of_many_rows_goes_in_rounds_and_leaves_no_shuffle_files(spark, monkeypatch):
    path = fresh_path(spark, "rounds")
    before = shuffle_files(spark)
    index.append(many(spark, 0, 3000, "old").unionByName(many(spark, 0, 10, "twice")), path, 1)
    index.append(many(spark, 1000, 2000, "new"), path, 2)
    monkeypatch.setattr(index, "MOST_SENT", 0)
    assert index.compact(spark, path)
    for _ in range(50):  # they go beside the job
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    base = index.state(spark, path)["base"]
    assert len(base) == 64 and len({b["folder"] for b in base.values()}) == index.ROUNDS
    assert sum(b["rows"] for b in base.values()) == index.current(spark, path).count() == 3000
    assert index.current(spark, path).filter("text = 'new'").count() == 1000
    index.append(many(spark, 5, 6, "newer", "3"), path, 3)
    (touched,) = index.state(spark, path)["late"][0]["touched"]
    assert index.compact(spark, path)
    after = index.state(spark, path)["base"]
    assert {k for k in after if after[k] != base[k]} == {str(touched)}
    assert index.compact(spark, path, buckets=3) and set(index.state(spark, path)["base"]) == {"0", "1", "2"}
    assert index.current(spark, path).count() == index.count(spark, path) == 3000
