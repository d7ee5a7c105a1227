import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from msgspark.functions import chunks, cuts
from msgspark.functions.text import strip
from msgspark.operators import chunking

PARTS = [
    "word", "an other", ". ", "! ", "?\n", "\n", "\n\n", "  ", "。", "！", "、", "漢字", "の文章です", "é à", "﷐", "﷒.",
    "﷓ ", "\U0001f600", "`code. here`", "```\nfenced. code\n\n```", "https://a.b/c?d=1. ", "<https://a.b|some text>",
    "\n- item. one", "\n１. 項目。", "\x1c", "　", "\xa0", "x" * 40, "。" * 9, "\n 1.\ttwo",
]


def texts(n, seed=1):
    draw = random.Random(seed)
    for k in range(n):
        some = draw.sample(PARTS, draw.randint(1, 9))
        yield k, "".join(draw.choice(some) for _ in range(draw.choice((3, 40, 120, 300))))


def own_tokens(text):
    return chunks.default_tokens(text)


@pytest.mark.parametrize("size, overlap, use_tokens, least", [(600, 0, True, 50), (600, 100, True, 50), (90, 30, False, 0), (37, 36, True, 20)])
def test_python_workers_cut_like_the_native_fold(spark, size, overlap, use_tokens, least):
    made = spark.createDataFrame(list(texts(250, size)), "id int, text string").repartition(3).cache()
    there = chunking.with_chunks(made, "text", "cut", size, overlap, use_tokens, least)
    folded = chunking.with_chunks(made, "text", "cut", size, overlap, use_tokens, least, own_tokens)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(there).count("ArrowEvalPython") == 1 and "ArrowEvalPython" not in plan(folded)
    assert sorted(there.collect()) == sorted(folded.collect())
    there = chunking.chunk_boundaries(made.withColumn("id", F.col("id").cast("string")), size, overlap, use_tokens)
    folded = chunking.chunk_boundaries(made.withColumn("id", F.col("id").cast("string")), size, overlap, use_tokens, own_tokens)
    assert sorted(there.collect()) == sorted(folded.collect())


def test_only_texts_of_more_than_one_chunk_and_bounded_bytes_are_sent(spark):
    words = ["w " * 300, "w " * 360, "w " * 20_000, "  ", None]
    made = spark.createDataFrame(list(enumerate(words)), "id int, text string")
    clean = made.withColumn("text", strip(F.col("text")))
    assert [r.id for r in clean.filter(chunks.is_sent(F.col("text"))).collect()] == [1]
    bad = made.selectExpr("id", "cast(concat(cast(text as binary), X'80') as string) AS text").filter("id = 1")
    assert bad.filter(chunks.is_sent(F.col("text"))).count() == 0
    found = chunking.with_chunks(made, "text", "cut").select("id", F.size("cut").alias("n")).collect()
    assert {r.id: r.n for r in found} == {0: 1, 1: 2, 2: 67}
    assert chunking.with_chunks(bad, "text", "cut").count() == 1


def test_pieces_of_a_batch_are_lists_of_its_rows():
    said, none = ["ab", None, "éc", "", "漢"], [[]] * 5
    one = lambda text, spans: [(k, k + len(spans), x) for k, x in enumerate(text)]
    at = pa.array([[1], *none[1:]], pa.list_(pa.int32()))
    made = cuts.rows(pa.array(said), at, at, one)
    made.validate(full=True)
    assert [[(x["s"], x["e"], x["text"]) for x in row] for row in made.to_pylist()] == [
        [(0, 1, "a"), (1, 2, "b")], [], [(0, 0, "é"), (1, 1, "c")], [], [(0, 0, "漢")]
    ]
    assert cuts.rows(pa.array([], pa.string()), at[:0], at[:0], one).to_pylist() == []


def test_the_fixed_values_are_those_of_the_native_fold():
    for name in ("MERGE_GROWTH", "CJK_HEAVY", "TOKENS_PER_CJK_CHAR", "TOKENS_PER_CHAR", "RETRY_SIZE", "RETRY_MIN_SPAN", "RETRY_MIN_KEPT"):
        assert getattr(cuts, name) == getattr(chunks, name)
    for name in ("OTHER", "NO_CUT", "STOP", "CJK_STOP", "OPEN", "HARD_BREAK", "NEWLINE", "SPACE", "CJK_COMMA"):
        assert getattr(cuts, name) == getattr(chunks, f"_{name}").replace("^.+", ".+")
