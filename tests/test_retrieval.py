import numpy as np
import pytest
from pyspark.sql import functions as F

from msgspark.functions.vectors import cosine, score, term_vector
from msgspark.operators import embedding, retrieval
from msgspark.plans.bindings import Tables
from msgspark.plans.registry import topk_approx_rows, topk_dense_rows

rng = np.random.default_rng(3)
VECTORS = rng.normal(size=(900, 16)).astype(np.float32)
VECTORS[300:600] = VECTORS[5]  # a third of all rows are copies of one vector
QUERIES = np.vstack([VECTORS[5], rng.normal(size=(12, 16)).astype(np.float32)])


def brute(k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(QUERIES.astype(float)) @ unit(VECTORS.astype(float)).T, 6)
    out = set()
    for q, row in enumerate(scores):
        best = sorted((-s, str(i)) for i, s in enumerate(row))[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(str(i), [float(x) for x in v]) for i, v in enumerate(VECTORS)]
    return spark.createDataFrame(rows, "id string, embedding array<float>").repartition(4)


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(QUERIES)]
    return spark.createDataFrame(rows, "query_id bigint, embedding array<float>")


def hits(df):
    return {(r.query_id, r["rank"], r.id, r.score) for r in df.collect()}


def test_shipped_questions_are_exact(corpus, asked):
    assert hits(retrieval.top_k(corpus, asked)) == brute(5)


@pytest.mark.parametrize("most", [1, 4, 5])
def test_blocks_of_questions_are_exact(corpus, asked, most):
    assert hits(retrieval.top_k(corpus, asked, block_bytes=16 * 8 * most)) == brute(5)


def test_nothing_is_shuffled_below_the_winners(corpus, asked):
    plan = retrieval.top_k(corpus, asked)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "hashpartitioning" not in below and "Generate" not in plan and "Join" not in plan


def test_no_questions(corpus, asked):
    assert retrieval.top_k(corpus, asked.filter("false")).count() == 0


def test_fewer_rows_than_k(corpus, asked):
    few = corpus.filter("id in ('1', '2')")
    assert retrieval.top_k(few, asked).count() == 2 * len(QUERIES)


def test_cells_recall(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    corpus, asked = t.vectors(), t.centroids()
    centres = asked.select(F.col("query_id").cast("string").alias("id"), "embedding")
    placed = retrieval.cell_index(corpus, centres)
    exact = {(r.query_id, r.id) for r in retrieval.top_k(corpus, asked).collect()}
    near = {(r.query_id, r.id) for r in retrieval.top_k_cells(placed, centres, asked, probes=2).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    sizes = [r["count"] for r in placed.groupBy("cell").count().collect()]
    assert sum(sorted(sizes)[-2:]) <= 0.3 * sum(sizes)  # what a question searches
    full = hits(retrieval.top_k_cells(placed, centres, asked, probes=len(sizes)))
    assert {(q, i) for q, _, i, _ in full} == exact  # all cells probed: nothing is lost


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_every_fiftieth_row(spark, sf):
    t = Tables(spark, f"/root/testdata/{sf}")
    asked, corpus = t.row_questions(), t.vectors()
    assert asked.count() == corpus.where("cast(id as bigint) % 50 = 0").count() > 0
    exact = {(r.query_id, r.id) for r in topk_dense_rows(t).collect()}
    got = [(r.query_id, r.id) for r in topk_approx_rows(t).collect()]
    assert len(got) == len(set(got)) == len(exact) == 5 * asked.count()
    assert len(exact & set(got)) / len(exact) >= 0.9
    others = {(q, i) for q, i in exact if str(q) != i}  # without the row itself
    recall = len(others & set(got)) / len(others)
    centres = t.row_centres()
    cells = {r.id: set(r.cell) for r in retrieval.cell_index(corpus, centres).collect()}
    wide = retrieval._in_sets(asked, centres, 5).collect()
    share = sum(bool(cells[i] & set(r.cells)) for r in wide for i in cells) / len(wide) / len(cells)
    print(sf, "recall", len(exact & set(got)) / len(exact), "without itself", recall, "share", share)
    assert recall >= 0.9 and share < 0.6


def partitions_read(node):
    """Partitions that the scans of an executed plan have read."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return partitions_read(node.executedPlan())
    if name.endswith("QueryStage"):
        return partitions_read(node.plan())
    if name.startswith("Scan parquet"):
        return node.metrics().get("numPartitions").get().value()
    children = node.children()
    return sum(partitions_read(children.apply(k)) for k in range(children.size()))


def test_only_files_of_probed_cells_are_read(spark, tmp_path):
    t, path = Tables(spark, "/root/testdata/sf0.01"), str(tmp_path / "cells")
    centres = t.row_centres()[:3]
    retrieval.write_cells(t.vectors(), centres, path)
    placed = retrieval.cell_index(t.vectors(), centres)
    asked = t.row_questions()
    for probes, some in ((1, asked.limit(2)), (4, asked)):
        found = retrieval.top_k_cell_files(path, centres, some, probes=probes)
        assert hits(found) == hits(retrieval.top_k_cells(placed, centres, some, probes=probes))
    few = retrieval.top_k_cell_files(path, centres, asked.limit(2), probes=1)
    few.collect()
    plan = few._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "Scan parquet" in x and "cell" in x)
    assert "concat_ws(:" in scan.split("PartitionFilters")[1].split("]")[0]
    everything = {f.rpartition("/")[0] for f in spark.read.parquet(path).inputFiles()}
    assert 0 < partitions_read(few._jdf.queryExecution().executedPlan()) <= 6 < len(everything)


def test_one_scan_of_the_corpus_whatever_the_number_of_questions(spark, tmp_path):
    path = str(tmp_path / "rows")
    rng = np.random.default_rng(1)
    rows = [(str(i), rng.normal(size=8).tolist()) for i in range(400)]
    spark.createDataFrame(rows, "id string, embedding array<double>").write.parquet(path)
    corpus = spark.read.parquet(path)
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(200)], "query_id int, embedding array<double>")
    whole = retrieval.top_k(corpus, asked)
    many = retrieval.top_k(corpus, asked, block_bytes=8 * 8 * 7)  # 29 files of questions at least
    assert many.schema["query_id"].dataType.simpleString() == "int" and hits(many) == hits(whole)
    assert many._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_rows_are_held_in_bounded_runs(corpus, asked, monkeypatch):
    monkeypatch.setattr(retrieval, "HELD_BYTES", 1)
    assert hits(retrieval.top_k(corpus, asked, block_bytes=16 * 8 * 3)) == brute(5)


def test_a_failing_text_stops_no_other(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no such text")
        return np.array([[len(t)] for t in texts], dtype=float)

    df = spark.range(40).selectExpr("id", "if(id % 9 = 4, concat('bad ', id), repeat('x', cast(id as int))) AS text")
    tried = embedding.embed_or_reject(df.repartition(2), model, batch_size=6).cache()
    assert {r.id: r.reason for r in embedding.rejected(tried).collect()} == {
        k: "RuntimeError: no such text" for k in range(4, 40, 9)
    }
    assert all(r.embedding[0] == r.id for r in embedding.embedded(tried).collect())
    assert embedding.embedded(tried).count() == 35
    short = embedding.embed_or_reject(df.limit(3), lambda texts: np.zeros((0, 1)))
    assert {r.reason for r in short.collect()} == {"ValueError: the model must return one vector per text"}


def test_hits_are_joined_without_shuffling_the_chunks(spark, tmp_path):
    path = str(tmp_path / "index")
    spark.range(500).selectExpr(
        "cast(id as string) AS id", "concat('w', id) AS text", "'c' AS channel_name", "'' AS permalink"
    ).write.parquet(path)
    chunks = spark.read.parquet(path)
    asked = spark.createDataFrame([("q1", "w7 w8")], "query_id string, text string")
    full = retrieval.with_chunk_fields(retrieval.top_k_text(chunks, asked), chunks)
    assert sorted(r.text for r in full.collect() if r.score > 0) == ["w7", "w8"]
    plan = full._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_stored_vectors_are_used(spark):
    chunks = spark.createDataFrame([("1", "red apple"), ("2", "pear")], "id string, text string")
    asked = spark.createDataFrame([("q1", "red")], "query_id string, text string")
    ready = embedding.hashed_embeddings(chunks).drop("text")
    assert hits(retrieval.top_k_text(ready, asked)) == hits(retrieval.top_k_text(chunks, asked))


def test_cosine_column(spark):
    row = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>"
    ).select(
        F.round(cosine(F.col("a"), F.col("b")), 6).alias("ab"),
        cosine(F.col("a"), F.col("z")).alias("az"),
        score(F.lit(0.25)).alias("s"),
    ).first()
    assert tuple(row) == (0.707107, 0.0, 0.75)


def test_term_vector(spark):
    df = spark.createDataFrame([("a b a",), ("...",), ("漢字 go",)], "text string")
    rows = [r.v for r in df.select(term_vector(F.col("text"), 1 << 20).alias("v")).collect()]
    assert sorted(round(w, 6) for w in rows[0].weights) == [0.447214, 0.894427]
    assert rows[1].buckets == [] and rows[1].weights == []
    assert len(rows[2].buckets) == 3


def test_text_hits_are_the_nearest_whatever_their_score(spark):
    chunks = spark.createDataFrame([("1", "red apple"), ("2", "green pear"), ("3", "red red")], "id string, text string")
    asked = spark.createDataFrame([("q1", "red"), ("q2", "plum"), ("q3", "?")], "query_id string, text string")
    got = [tuple(r) for r in retrieval.top_k_text(chunks, asked).orderBy("rank").collect()]
    assert [g for g in got if g[0] == "q1"] == [("q1", 1, "3", 1.0), ("q1", 2, "1", 0.707107), ("q1", 3, "2", 0.0)]
    assert [g for g in got if g[0] != "q1" and g[1] == 1] == [("q2", 1, "1", 0.0), ("q3", 1, "1", 0.0)]


def test_embed_batches_calls_the_model_in_order(spark):
    def model(texts):
        assert 0 < len(texts) <= 7
        return np.array([[len(t), len(texts)] for t in texts], dtype=float)

    df = spark.range(50).selectExpr("id", "repeat('x', cast(id as int)) AS text").repartition(3)
    rows = embedding.embed_batches(df, model, batch_size=7).collect()
    assert len(rows) == 50 and all(r.embedding[0] == r.id for r in rows)


def test_embed_missing_is_decided_per_row(spark):
    df = spark.createDataFrame([("1", "old"), ("2", "changed"), ("3", "new")], "id string, text string")
    existing = spark.createDataFrame([("1", "old", 7), ("2", "was", 8)], "id string, text string, v int")
    existing = existing.select("id", F.md5("text").alias("text_hash"), "v")
    out = embedding.embed_missing(df, existing, lambda d: d.withColumn("v", F.lit(0)), ["v"])
    assert sorted((r.id, r.v, r.reused) for r in out.collect()) == [("1", 7, True), ("2", 0, False), ("3", 0, False)]


def test_text_plan_has_no_cross_join(spark):
    chunks = spark.createDataFrame([("1", "red apple")], "id string, text string")
    asked = spark.createDataFrame([("q1", "red")], "query_id string, text string")
    plan = retrieval.top_k_text(chunks, asked)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan
