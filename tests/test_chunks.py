import random

import brute_chunks as brute
import pytest
from pyspark.sql import functions as F

from msgspark.functions.chunks import default_tokens
from msgspark.functions.spans import protected_spans
from msgspark.functions.text import strip
from msgspark.operators.chunking import (
    chunk_documents,
    merge_span_rows,
    span_rows,
    token_budget,
    with_chunks,
    with_pieces,
)

ATOMS = [
    "word", "a", "bb ccc", ". ", "! ", "?\n", "\n", "\n\n", " ", "  ", "。", "！", "？", "、",
    "漢字", "かな", "`code here`", "``` block\n more ```", "https://ex.com/a.b?c=1",
    "<https://ex.com/x y|la bel>", "\n- item one. yes", "\n1. num item! ok", "\n・項目です。",
    "\n① circ", "\n２．full", "😀", "\ufdd0", "\ufdd2", "\u3000", "\t", "\xa0", "`", "```",
    "x" * 30, "longer text with several words here",
]


def random_texts(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        some = rnd.sample(ATOMS, rnd.randint(2, len(ATOMS)))
        out.append("".join(rnd.choice(some) for _ in range(rnd.randint(1, 60))))
    return out


@pytest.fixture(scope="module")
def texts():
    return random_texts(400, 11)


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)


def test_spans_match_brute_force(frame, texts):
    found = frame.select("id", protected_spans(strip(F.col("text"))).alias("s")).collect()
    for row in found:
        want = brute.covered(texts[row.id].strip())[0]
        assert [[x.s, x.e] for x in row.s] == want, texts[row.id]


@pytest.mark.parametrize(
    "size, overlap, tokens",
    [(40, 0, None), (40, 15, None), (100, 30, None), (7, 3, None), (250, 60, F.length), (600, 100, None)],
)
def test_chunks_match_brute_force(frame, texts, size, overlap, tokens):
    spark_tokens, plain_tokens = (tokens, len) if tokens else (default_tokens, brute.default_tokens)
    cut = with_pieces(frame, "text", "p", size, overlap, True, spark_tokens)
    cut = with_chunks(cut, "text", "c", size, overlap, True, 20, spark_tokens)
    for row in cut.collect():
        want = brute.pieces(texts[row.id], size, overlap, True, plain_tokens)
        assert [tuple(p) for p in row.p] == want, texts[row.id]
        assert list(row.c) == brute.merged_texts([p[2] for p in want], size, 20)


def test_very_long_text_with_spans(spark):
    rnd = random.Random(5)
    parts = [rnd.choice(ATOMS[:27] + ["plain words go on and on. "] * 20) for _ in range(9000)]
    text = "".join(parts)
    df = spark.createDataFrame([(1, text)], "id int, text string")
    row = with_pieces(df, "text", "p", overlap=100).first()
    assert len(text) > 60_000
    assert [tuple(p) for p in row.p] == brute.pieces(text, 600, 100)


GOLDEN = [
    ("今日は会議です。明日は休みです、たぶん。来週の予定を確認してください！それから連絡します。", 20, [20, 15, 10]),
    (
        "Alpha beta gamma delta epsilon.\n\n- item one is here\n- item two is here\nend of the text now",
        40,
        [22, 28, 38],
    ),
    ("あいうえおかきくけこさしすせそたちつて\n・項目です。\n次の行の文章がここに続きますのでよろしく", 30, [19, 27]),
    ("x" * 50, 20, [20, 20, 10]),
    ("aa bb `" + "c" * 60 + "` dd ee ff gg hh ii jj", 20, [5, 62, 17, 2]),
    ("```a b```  text `x` then more words follow here and there", 30, [29, 27]),
]


@pytest.mark.parametrize("text, size, lengths", GOLDEN)
def test_golden_cases(spark, text, size, lengths):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    row = with_chunks(df, chunk_size=size, min_chunk=0, use_tokens=False).first()
    assert [len(c) for c in row.chunks] == lengths


def test_plain_properties(spark, sf_dir):
    """Without overlap the slices cover a text in order, with no gap."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS id", "text")
    for row in with_pieces(docs, out="p").collect():
        ends = [0] + [p.e for p in row.p]
        assert [p.s for p in row.p] == ends[:-1] and ends[-1] == len(row.text.strip())
        assert all(p.text.strip() for p in row.p)


def test_chunk_documents_rows(spark):
    docs = spark.createDataFrame(
        [("c-1", "c", None, " hello ", "u", "1", "9"), ("c-2", "c", "n", " \u3000\n", "u", "2", None)],
        "id string, channel string, channel_name string, text string, user string, ts string, thread_ts string",
    )
    out = chunk_documents(docs)
    assert out.columns == ["id", "text", "channel", "channel_name", "user", "ts", "permalink", "chunk_index"]
    assert [tuple(r) for r in out.collect()] == [("c-1-chunk-0", "hello", "c", "", "u", "1", "", 0)]


def test_chunk_plan_holds_the_fold_once_and_does_not_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("cast(doc_id as string) AS id", "text")
    plan = chunk_documents(docs)._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString()
    # one split for the blocks of the text and one scan per protected kind
    assert plan.optimizedPlan().toString().count("regexp_extract_all(") == 5


def test_span_rows_merge_to_the_same_spans(frame):
    named = frame.select(F.col("id").cast("string").alias("id"), "text")
    whole = span_rows(named)
    merged = merge_span_rows(span_rows(named, merged=False))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))


def test_token_budget_flags_cjk(spark):
    df = spark.createDataFrame([("a", "漢" * 800), ("b", "word " * 100)], "id string, text string")
    got = {r.id: (r.tokens, r.token_limit, r.over_budget) for r in token_budget(df).collect()}
    assert got == {"a": (800, 720, True), "b": (125, 210, False)}
