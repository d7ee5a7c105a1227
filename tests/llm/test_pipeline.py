import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from msgspark.llm.queries import quality_labels
from test_contamination import brute as brute_items
from test_exact_and_lines import brute_lines
from test_near import brute as brute_near

from msgspark.llm.quality import fit, with_quality


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """The pipeline's decisions by plain code over collected rows; scores come from the operator."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = with_quality(docs, fit(docs, quality_labels(spark, sf_dir)), name="q").collect()
    rows = [(r.doc_id, r.text) for r in scored if r.q >= 0.5]
    rows = [(i, t) for i, t, n, gone, _ in brute_lines(rows) if gone < n]
    near = {eval(x)[0] for x in brute_near(rows) if eval(x)[3]}
    rows = [(i, t) for i, t in rows if i in near]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {eval(x)[0] for x in brute_items(rows, items) if eval(x)[4]}
    return {i: t for i, t in rows if i not in bad}


def test_run_keeps_what_plain_code_keeps(spark, sf_dir, kept):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.text for r in got} == kept
    assert all(r.round_trip and r.n_pieces == len(r.ids) and r.n_chars == len(r.text) for r in got)
    assert 0 < len(got) < spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    schema = docs.schema
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", None, 0), (-2, "a\nb\nc", None, "s", 5)], schema)
    both = docs.limit(30).unionByName(odd).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (both, docs.limit(0)):
            out = stage(spark, frame, sf_dir)
            assert out.columns == docs.columns, name
            out.collect()
    last = corpus_pipeline.STAGES[-1][1](spark, both, sf_dir)
    assert last.count() == both.count()
    assert hashlib and F


def test_near_copies_at_a_limit_of_80_percent(spark):
    base = [f"w{k}" for k in range(204)]  # 200 shingles; a new word takes 5 of them
    rows = [(1, " ".join(base))]
    for doc_id, changes in ((2, 4), (3, 5)):  # 180 / 220 = 0.82 and 175 / 225 = 0.78
        own = list(base)
        for k in range(changes):
            own[20 + 30 * k] = f"x{doc_id}y{k}"
        rows.append((doc_id, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "", percent=80).collect()) == [1, 3]


def test_the_last_stage_keeps_the_next_best_pieces(spark):
    docs = spark.createDataFrame([(1, "some words of a text, and others"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in corpus_pipeline.pieces(spark, docs, "").collect()}
    assert got[1].alternatives and all(a.score <= got[1].score for a in got[1].alternatives) and got[1].score < 0
    assert got[1].round_trip and got[1].n_pieces == len(got[1].ids)
