import re
from itertools import permutations

from frames import prose

from msgspark.llm import filter_audit as fa

LABELS = "doc_id long, quality int, toxic int, good string"
DOCS = "doc_id long, text string, source string, mask string, digest int, part int, first long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    """Every order is played through, document by document."""
    found = []
    for i, t, source in rows:
        t = t or ""
        w = WORD.findall(t)
        same = [k for k, u, _ in rows if (u or "") == t and k is not None and (i is None or k < i)]
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None,
            "E": bool(same),
        }
        good = any(k is not None and k == i and q == 1 for k, q, _ in labels)
        toxic = any(k is not None and k == i and x == 1 for k, _, x in labels)
        found.append((source or "", {f for f in fails if fails[f]}, good, toxic))
    out = {}
    for part in {f[0] for f in found}:
        own = [f[1:] for f in found if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = sum(f in d[0] for d in own)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in own),
                    sum(d[1] for d in gone), sum(d[2] for d in gone), f,
                ]
                shapley[f] += len(gone)
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return out


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def check(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, "x", 7, 8, 9) for i, t, s in rows], DOCS)
    marks = spark.createDataFrame([(*x, "z") for x in labels], LABELS)
    got = fa.filter_audit(docs, marks).collect()
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got})
    assert {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in got} == brute(rows, labels)


def test_every_order_against_playing_it_through(spark):
    own = " ".join(f"word{k}" for k in range(60))
    rows = [(None, None, None), (None, own, "a"), (1, "", "a"), (2, " \t\n", None), (3, None, "")]
    rows += [(10 + k, own, "a") for k in range(4)] + [(13, own, "b"), (13, own, "b"), (9, own, "b")]
    rows += [(20, own.upper(), "b"), (21, own + " #", "a"), (22, prose(1, 200, 20), "a"), (23, prose(2, 70, 5000), "a")]
    rows += [(24, "é" * 300 + "ABC $", "a"), (25, "ABCDEFGH " * 80 + "%", "b"), (26, "\x0bx\x0c" * 50, "c")]
    rows += [(100 + k, prose(k, 30 + 5 * k, 90) + (" |" if k % 3 else ""), "abc"[k % 3]) for k in range(40)]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(1, 130, 2)] + [(13, 0, 1), (13, 1, None), (None, 1, 1), (21, None, None)]
    check(spark, rows, labels)


def test_a_hot_text_an_empty_table_and_no_labels(spark):
    check(spark, [(k, "same text", "s") for k in range(400)] + [(500, "other", "s")], [])
    empty = spark.createDataFrame([], DOCS)
    assert fa.filter_audit(empty, spark.createDataFrame([], LABELS)).collect() == []


def test_long_texts_are_counted_in_pieces():
    raw = (" ".join(f"w{k % 7000} x{k}" for k in range(60_000)) + "\n").encode()
    whole = raw.split()
    for piece, one_set in ((1000, 4 << 20), (1000, 50_000), (len(raw), 10)):
        assert fa.word_counts(raw, piece, one_set) == (len(whole), len(set(whole)))
    assert fa.word_counts(b"a" * 5000 + b" b", 100, 100) == (2, 2)
    assert fa.word_counts(b"") == (0, 0)
