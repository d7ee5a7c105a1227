import math
import random
import re
from collections import Counter

import numpy as np
from frames import ODD, docs, prose

from msgspark.llm import lexical_search as ls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, n string, terms int"


def terms(text):
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def brute(rows, items, most):
    counted = [(i, Counter(terms(t))) for i, t in rows]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    total, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        hits = []
        for i, c, n in counted:
            m = 50 + 50 * n * total // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in own
                if t in c
            )
            if score > 0:
                hits.append((-score, i is None, i or 0, i))
        for rank, h in enumerate(sorted(hits)[:most], 1):
            out.append((item, rank, h[3], -h[0]))
    return sorted(out, key=str)


def check(spark, rows, items, most=50, **limits):
    asked = spark.createDataFrame([(i, t, "n", 3) for i, t in items], ITEMS)
    got = ls.ranked_search(docs(spark, rows), asked, most=most, **limits)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, items, most)


ROWS = ODD + [
    (10, "One, two; THREE three_three 4x"), (10, "one two"), (10, "one two"), (11, "ÉCOLE école Ÿ1"), (12, "\x7f{}|~"),
    (13, prose(3, 30_000, 400)), *((100 + k, prose(k, 5 + k % 70, 150)) for k in range(200)),
    *((400 + k, "w1 w2 w3") for k in range(80)), (None, "w1 w2 w3"),
]
ASKED = [(k, prose(500 + k, 3 + k % 40, 150)) for k in range(60)] + [
    (70, None), (71, ""), (72, "?!"), (None, "one two"), (73, "one"), (73, "Two one"), (74, "w1 W2 w3"), (75, "w1 w2 w3"),
    (76, "nobody says this"), (77, "École 4X ÉCOLE"), (78, prose(3, 5000, 400)),
]


def test_ranks_against_scoring_every_pair(spark):
    check(spark, ROWS, ASKED)
    check(spark, ROWS, ASKED, most=3)


def test_items_in_several_parts(spark):
    check(spark, ROWS, ASKED, most=7, part_bytes=9000)


def test_empty_tables(spark):
    for rows, items in (([], ASKED), (ROWS, []), (ODD[2:5], ASKED), ([(1, "a")], [(1, "b")])):
        check(spark, rows, items)


def test_every_term_in_every_document(spark):
    check(spark, [(k, "the of and " * (k % 9 + 1)) for k in range(300)], [(1, "the of"), (2, "and the")])


def test_shared_sums_equal_plain_sums_and_save_additions():
    draw = random.Random(4)
    common = [draw.sample(range(300), 12) for _ in range(6)]
    items = [frozenset(draw.sample(range(300), 15) + common[k % 6] + common[(k + 1) % 6]) for k in range(120)]
    items += [frozenset(), frozenset({1}), items[0], frozenset(range(300))]
    sharing = ls.Sharing(items, 300)
    values = {t: np.array([t * t + 1, 7 * t], np.int64) for t in range(300) if t % 11}
    got = dict(sharing.evaluate(values))
    for i, own in enumerate(items):
        want = sum((values[t] for t in own if t in values), np.zeros(2, np.int64))
        assert (got.get(i, np.zeros(2)) == want).all()
    plain = sum(max(0, len(own) - 1) for own in items)
    assert sharing.additions() < 0.6 * plain


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(ls, "PIECE", 10)
    text = "Alpha-beta gamma_" * 50 + "x" * 100
    assert [w for part in ls.terms_of(text.encode()) for w in part] == [w.encode() for w in terms(text)]
