import math

import numpy as np

from msgspark.llm import vector_forest as vf

SCHEMA = "vec_id long, embedding array<float>, digest int, ids string, bundle int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 2) for i, v in rows], SCHEMA)


def brute(rows, dim, most=20, every=20):
    good = {
        (i, tuple(np.float32(x) for x in v))
        for i, v in rows
        if i is not None and v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    ids = np.array([i for i, _ in good])
    matrix = np.array([v for _, v in good], dtype=np.float64).reshape(len(good), dim)
    out = {}
    for i, v in good:
        if i % every == 0:
            scores = np.zeros(len(good))
            for k in range(dim):
                scores += matrix[:, k] * float(v[k])
            order = [x for x in np.lexsort((ids, -scores)) if ids[x] != i][:most]
            out[i] = [(int(ids[x]), float(scores[x])) for x in order]
    return out


def search(spark, rows, **limits):
    vectors = frame(spark, rows)
    got = vf.nearest(vectors, vectors.where("vec_id % 20 = 0"), **limits)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def draw(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    return [(k, rng.normal(size=dim).tolist()) for k in range(n)]


def test_all_trees_to_the_end_is_the_exact_search(spark):
    rows = draw(600, 12)
    rows += [(1000 + k, rows[5][1]) for k in range(150)]  # a hot vector, also among the queries
    rows += [(None, rows[0][1]), (2000, None), (2020, [0.0] * 12), (2040, [math.nan] * 12), (2060, [1.0, None] * 6)]
    rows += [(2080, [1.0] * 5), (2100, []), (2120, [math.inf] + [1.0] * 11), (40, rows[40][1]), (-20, rows[3][1])]
    assert search(spark, rows, recall=1.0) == brute(rows, 12)
    small = search(spark, rows, recall=1.0, bundle_bytes=12 * 8 * 16, query_block=7)  # many blocks of both sides
    assert small == brute(rows, 12)


def test_recall_with_a_sample_smaller_than_the_table(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    rows = [(k, (centres[k % 40] + 0.4 * rng.normal(size=24)).tolist()) for k in range(6000)]
    want, got = brute(rows, 24), search(spark, rows, sample_rows=1500)
    assert got.keys() == want.keys()
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    exact = {q: dict(brute_all) for q, brute_all in brute(rows, 24, most=6000).items()}
    assert all(exact[q][i] == s for q, own in got.items() for i, s in own)


def test_norms_of_any_size(spark):
    rng = np.random.default_rng(8)
    rows = [(k, (rng.normal(size=8) * 10 ** rng.uniform(-3, 3)).tolist()) for k in range(900)]
    want, got = brute(rows, 8), search(spark, rows)
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_the_queue_visits_leaves_by_distance_and_stops_at_the_budget():
    rows = np.random.default_rng(2).normal(size=(3000, 6))
    forest = vf.Forest(rows, len(rows), float(np.linalg.norm(rows, axis=1).max()), 3, 500)
    own = forest.margins(forest.direction(rows[:1]))[0].tolist()
    order = list(forest.visit(own, math.inf))
    assert sorted(order) == list(range(len(forest.share)))
    some = list(forest.visit(own, 0.5))
    assert some == order[: len(some)] and 0.5 <= sum(forest.share[x] for x in some) < 0.6
    inside = forest.leaves(forest.place(rows))
    counts = np.bincount(inside.reshape(-1), minlength=len(forest.share)) / len(rows)
    assert np.allclose(counts, forest.share)


def test_few_rows_and_empty_tables(spark):
    assert search(spark, []) == {}
    assert search(spark, [(20, [1.0, 2.0])]) == {}
    assert search(spark, [(20, [1.0, 2.0]), (1, [3.0, 1.0])]) == {20: [(1, 5.0)]}
    assert search(spark, [(k, [1.0, 0.0]) for k in range(100)]) == brute([(k, [1.0, 0.0]) for k in range(100)], 2)
