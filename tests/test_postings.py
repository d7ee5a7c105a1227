import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from msgspark.functions.postings import BestOfLists, Part, invert
from msgspark.operators import postings, retrieval

DIM = 300
draw = np.random.default_rng(11)


def vector(common):
    """Some buckets with frequencies; bucket 7 is in nearly every row."""
    buckets = np.unique(draw.zipf(1.3, size=12) % DIM)
    if common:
        buckets = np.union1d(buckets, [7])
    return [int(b) for b in buckets], [float(w) for w in draw.integers(1, 9, len(buckets))]


ROWS = [(f"c{i}", *vector(i % 10)) for i in range(700)]
ROWS += [(f"copy{i}", [7, 9], [1.0, 2.0]) for i in range(300)]  # copies of one vector
ROWS += [("empty", [], []), ("zero", [3], [0.0]), ("lone", [299], [5.0]), ("lone", [299], [5.0])]
ASKED = [(i, *vector(i % 2)) for i in range(20)] + [(90, [], []), (91, [299], [2.0]), (92, [DIM + 5], [1.0]), (93, [7, 9], [1.0, 2.0])]
SPARSE = "buckets array<int>, weights array<double>"


def dense(rows):
    out = np.zeros((len(rows), DIM + 6))
    for k, (_, buckets, weights) in enumerate(rows):
        out[k, buckets] = weights
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def brute(k):
    scores = np.round(dense(ASKED) @ dense(ROWS).T, 6)
    out = []
    for (q, *_), row in zip(ASKED, scores):
        best = sorted((-s, ROWS[i][0]) for i, s in enumerate(row))[:k]
        out += [(q, n, i, -s + 0.0) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def hits(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(ROWS, f"id string, {SPARSE}").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, f"query_id bigint, {SPARSE}")


@pytest.fixture(scope="module")
def path(corpus, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("postings") / "index")
    postings.write_postings(corpus, place, part_rows=50)
    return place


@pytest.mark.parametrize("k", [1, 5, 40])
def test_lists_find_what_comparing_all_pairs_finds(path, asked, k):
    assert hits(postings.top_k_postings(path, asked, k)) == brute(k)


def test_many_question_files(path, asked):
    assert hits(postings.top_k_postings(path, asked, block_bytes=100)) == brute(5)


def test_the_list_of_a_common_bucket_is_split(spark, path):
    lists = spark.read.schema(postings.POSTING).parquet(path).where("bucket = 7")
    assert lists.count() >= 20 and lists.agg(F.max(F.size("at"))).first()[0] <= 50


def test_few_questions_read_few_lists(spark, path, asked):
    few = asked.where("query_id in (91, 93)")
    rows = postings.read_postings(spark, path, [299, 7, 9])
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(bucket,7)" in pushed and "LessThanOrEqual(bucket,9)" in pushed
    whole = spark.read.parquet(path).agg(F.sum(F.size("at"))).first()[0]
    assert rows.agg(F.sum(F.size("at"))).first()[0] < 0.3 * whole
    assert hits(postings.top_k_postings(path, few)) == [h for h in brute(5) if h[0] in (91, 93)]


def test_ranges_of_buckets():
    assert postings._near([]) == []
    assert postings._near([5, 4, 9, 4], 9) == [(4, 5), (9, 9)]
    assert postings._near([1, 3, 100, 104, 900], 3) == [(1, 3), (100, 104), (900, 900)]
    assert postings._near([1, 3, 100], 1) == [(1, 100)]


def test_lists_that_cannot_reach_the_kth_score_are_left_out():
    """Every row has the common bucket 2, every fourth part rows with the rare bucket 1."""
    rows = [(f"{i:04}", [1, 2, 3], [5.0, 1.0, 1.0]) if i % 200 < 10 else (f"{i:04}", [2, 3], [1.0, 2.0 + i % 3]) for i in range(2000)]
    names, buckets, weights = zip(*rows)
    table = pa.table({"id": names, "buckets": pa.array(buckets, pa.list_(pa.int32())), "weights": weights})
    best = BestOfLists([([1, 2], np.array([0.9, 0.3]))], 3)
    for n, first in enumerate(range(0, len(rows), 50)):
        best.add_part(Part([invert(n, table.slice(first, 50))]))
    assert [i for _, i in best.rows[0]] == ["0000", "0001", "0002"]
    # the first part whole; then the rare list of every fourth part and its rows in the common one
    assert best.there == 2000 + 100 and best.met <= 60 + 9 * 20


def test_empty_tables(spark, path, corpus, asked, tmp_path):
    assert postings.top_k_postings(path, asked.where("false")).collect() == []
    postings.write_postings(corpus.where("false"), str(tmp_path / "none"))
    assert postings.top_k_postings(str(tmp_path / "none"), asked).collect() == []


def test_negative_weights(spark, tmp_path):
    rows = [(f"n{i}", [1, 2, 3 + i % 5], [1.0, -2.0 if i % 3 else 2.0, float(i % 7 - 3)]) for i in range(90)]
    own = spark.createDataFrame(rows, f"id string, {SPARSE}")
    questions = spark.createDataFrame([(1, [1, 2, 4], [1.0, 3.0, -1.0]), (2, [2, 5], [-1.0, 2.0])], f"query_id bigint, {SPARSE}")
    postings.write_postings(own, str(tmp_path / "signed"), part_rows=10)
    assert hits(postings.top_k_postings(str(tmp_path / "signed"), questions)) == hits(retrieval.top_k(own, questions, dim=20))
