import random

import numpy as np
from frames import ODD, docs, prose, words

from msgspark.llm import near_dedup
from msgspark.llm.near_dedup import near_duplicates
from msgspark.llm.shingles import distinct_sets, shingle_hashes, sketches

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = [x for x in (text or "").translate(LOWER).translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 85 * (len(sets[x]) + len(sets[y]) - both):
                old, new = label[x], label[y]
                label = [new if k == old else k for k in label]
    least = {}
    for (i, _), k in zip(rows, label):
        least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
    return sorted(
        repr((i, len(s), least[k], least[k] is None or i == least[k]))
        for (i, _), s, k in zip(rows, sets, label)
    )


def near(base, seed, changes):
    w = base.split(" ")
    draw = random.Random(seed)
    for _ in range(changes):
        w[draw.randrange(len(w))] = f"new{draw.randrange(10_000)}"
    return " ".join(w)


def test_against_all_pairs(spark):
    base = [prose(100 + k, 150, 400) for k in range(6)]
    rows = list(ODD) + [(50 + k, b) for k, b in enumerate(base)]
    rows += [(200 + n, near(base[n % 6], n, n % 7)) for n in range(90)]
    rows += [(400, "Short text here"), (401, "short TEXT\there"), (402, "short text there"), (402, "short text there")]
    rows += [(500 + n, base[0].upper()) for n in range(40)]
    rows += [(600, " ".join(words(9, 12_000, 3000)))]
    random.Random(1).shuffle(rows)
    got = near_duplicates(docs(spark, rows)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)


def test_blocks_of_a_large_neighbourhood(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 8)
    base = prose(3, 200, 500)
    rows = [(n, near(base, n, 1 + n % 6)) for n in range(60)]
    got = near_duplicates(docs(spark, rows)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)


def test_empty_table(spark):
    assert near_duplicates(docs(spark, [])).collect() == []


def test_sketch_fills_and_estimates():
    import pyarrow as pa

    from msgspark.llm.arrays import utf8

    a = words(1, 2000, 100_000)
    b = a[:1500] + words(2, 500, 100_000)
    texts = [" ".join(a), " ".join(b), "one", ""]
    sets, bounds = distinct_sets(*shingle_hashes(*utf8(pa.array(texts)), 5))
    found = sketches(sets, bounds, 512)
    empty = np.iinfo(np.uint64).max
    assert (found[:3] != empty).all() and (found[3] == empty).all()
    x, y = shingle_set(texts[0]), shingle_set(texts[1])
    assert abs((found[0] == found[1]).mean() - len(x & y) / len(x | y)) < 0.08
