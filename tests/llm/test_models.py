import random

import numpy as np
import pytest
from frames import ODD, docs, prose
from pyspark.sql import functions as F

import __spark_entry__ as entry
from msgspark.llm import language
from msgspark.llm.quality import BLANK, FEATURES, bradley_terry, fit, with_quality


def junk(k):
    text = prose(k, 60)
    return [text.upper().replace(" ", "!! "), text.replace(" ", "### "), " | ".join(text.split()), "spam spam " * 60][k % 4]


def labelled(spark):
    rows = [(k, prose(k, 40 + k)) for k in range(120)] + [(1000 + k, junk(k)) for k in range(60)]
    marks = [(i, int(i < 1000)) for i, _ in rows] + [(5, None), (None, 1), (77_777, 0)]
    return rows, spark.createDataFrame(marks, "doc_id long, quality int").withColumn("text", F.lit("no"))


def test_quality_separates_held_out_junk(spark):
    rows, labels = labelled(spark)
    model = fit(docs(spark, rows), labels.where(F.coalesce(F.col("doc_id") % 3 != 1, F.lit(False))))
    fresh = [(5000 + k, prose(900 + k, 80)) for k in range(40)] + [(6000 + k, junk(700 + k)) for k in range(40)]
    got = with_quality(docs(spark, fresh), model).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id < 6000) for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_of_odd_rows_and_of_no_labels(spark):
    rows, labels = labelled(spark)
    model = fit(docs(spark, rows + ODD), labels)
    got = with_quality(docs(spark, ODD + [(9, prose(1, 20_000))]), model)
    assert got.columns == ["doc_id", "text", "n_lines", "component_id", "hash", "score"]
    assert all(0 <= r.score <= 1 for r in got.collect())
    blank = fit(docs(spark, rows), labels.where("quality = 1"))
    assert blank is BLANK
    assert {r.score for r in with_quality(docs(spark, rows[:3]), blank).collect()} == {0.5}
    assert with_quality(docs(spark, []), model).collect() == []
    assert fit(docs(spark, []), labels) is BLANK


def test_pairwise_weights_rank_a_known_order():
    draw = np.random.Generator(np.random.PCG64(1))
    true = np.array([2.0, -1.0, 0.0])
    x, y = draw.normal(size=(5000, 3)), draw.normal(size=(5000, 3))
    wins = draw.random(5000) < 1 / (1 + np.exp(-(x - y) @ true))
    w = bradley_terry(np.where(wins[:, None], x, y), np.where(wins[:, None], y, x))
    assert np.abs(w - true).max() < 0.2
    assert len(FEATURES) == len(set(FEATURES))


LANGUAGES = {
    "xx": "the and of to in is that it was for on are with as be this have from or had by".split(),
    "yy": "le la les et un une des est que pour dans qui sur pas plus avec tout mais nous vous".split(),
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который".split(),
}


def sentence(lang, seed, n=30):
    draw = random.Random(f"{lang}{seed}")
    return " ".join(draw.choice(LANGUAGES[lang]) for _ in range(n))


def corpus(spark):
    rows = [(k, sentence(lang, k), lang) for k in range(60) for lang in LANGUAGES] + [(None, None, "xx"), (1, "abc", None), (2, "", "yy")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))


def test_languages_and_spans(spark):
    model = language.fit(corpus(spark))
    mixed = sentence("xx", 1, 40) + ". " + sentence("yy", 2, 20) + "! " + sentence("ru", 3, 10)
    rows = [(k, sentence(lang, 500 + k)) for k, lang in enumerate(LANGUAGES)] + [(50, mixed), (51, sentence("yy", 7, 20_000))] + ODD
    rows += [(60, "12 34 !?"), (61, "…—«»"), (62, "Σ ελληνικά")]
    got = language.identify(docs(spark, rows), model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang for k in range(1)] == ["xx"] and by[51].lang == "yy"
    assert [s.lang for s in by[50].spans] == ["xx", "yy", "ru"] and by[50].lang == "xx"
    first = by[50].spans[0]
    assert mixed[first.start : first.stop] == sentence("xx", 1, 40)
    assert 0.4 < by[50].score < 0.8
    for k in (60, 61, 3, 4):
        assert (by[k].lang, by[k].score, by[k].spans) == ("und", 0.0, [])
    assert by[62].lang in LANGUAGES


def test_language_without_training(spark):
    model = language.fit(corpus(spark).where("lang is null"))
    assert language.identify(docs(spark, [(1, "abc")]), model).first().lang == "und"
    assert language.identify(docs(spark, []), model).collect() == []


def test_viterbi_against_all_paths():
    draw = np.random.Generator(np.random.PCG64(3))
    sizes = [0, 1, 5, 3, 7, 0]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    scores = draw.normal(size=(bounds[-1], 3)) * 3
    path = language.viterbi(scores, bounds, 2.0)
    import itertools

    def total(p, s):
        return sum(s[t, k] for t, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))

    for a, b in zip(bounds[:-1], bounds[1:]):
        best = max((total(p, scores[a:b]) for p in itertools.product(range(3), repeat=int(b - a))), default=0)
        assert total(path[a:b], scores[a:b]) == pytest.approx(best)


@pytest.mark.parametrize(("name", "column", "table", "least"), [
    ("op5_language_id", "lang", "documents", 0.97), ("op8_quality_classifier", "quality", "labels", 0.95)
])
def test_held_out_accuracy(spark, sf_dir, name, column, table, least):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    got = entry.queries()[name](spark, folder).where("held_out")
    truth = spark.read.parquet(f"{folder}/{table}.parquet").select("doc_id", column)
    found = got.columns[-1] if column == "quality" else "lang_pred"
    rows = got.join(truth, "doc_id").select((F.col(found) == F.col(column)).cast("int").alias("hit")).collect()
    assert len(rows) > 50 and np.mean([r.hit for r in rows]) >= least


def test_more_languages_than_a_byte_counts(spark):
    rows = [
        (1000 * k + n, " ".join(f"{chr(0x4E00 + 3 * k)}{chr(0x4E01 + 3 * k)}{chr(0x4E02 + 3 * k)}" for _ in range(12)), f"l{k:03}")
        for k in range(300) for n in range(1 + (k < 200))
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(frame)
    assert len(model.languages) == 300
    got = {r.doc_id: r.lang for r in language.identify(frame, model).collect()}
    assert got == {i: lang for i, _, lang in rows}
