import hashlib
import time

from frames import ODD, docs, prose
from pyspark.sql import functions as F

from msgspark.llm.exact_dedup import exact_duplicates
from msgspark.llm.line_dedup import dedup_lines

SPACE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(SPACE), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        norm = (t or "").translate(SPACE)
        best = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))
        out.append((
            i, best[2], len(groups[norm]), i == best[2] and -len(t or "") == best[0],
            hashlib.sha256(norm.encode()).hexdigest(),
        ))
    return out


ROWS = ODD + [
    (10, "a b"), (11, "ab"), (12, "a  b"), (9, "a\tb "), (12, "a  b"), (13, "A b"), (14, "a b"),
    (20, prose(1, 4000)), (21, prose(1, 4000) + "\n"), (22, "ba"),
]


def key(rows):
    return sorted(map(repr, rows))


def test_exact_groups(spark):
    got = [tuple(r) for r in exact_duplicates(docs(spark, ROWS)).collect()]
    assert key(got) == key(brute_exact(ROWS))


def test_exact_compares_bytes_when_hashes_collide(spark):
    weak = exact_duplicates(docs(spark, ROWS), content_hash=lambda c: F.char_length(c).cast("string").cast("binary"))
    assert key([tuple(r) for r in weak.collect()]) == key(brute_exact(ROWS))


def test_exact_hot_group_and_empty_table(spark):
    rows = [(i, "same text") for i in range(500)] + [(1000 + i, f"own {i}") for i in range(50)]
    got = exact_duplicates(docs(spark, rows)).collect()
    assert sum(r.kept for r in got) == 51
    assert {r.keep_id for r in got if r.doc_id < 500} == {0}
    assert exact_duplicates(docs(spark, [])).collect() == []


def brute_lines(rows, size=3):
    """Places in order; windows seen before mark their lines."""
    places = sorted({(i is None, i or 0, t or "") for i, t in rows})
    assert len({p[:2] for p in places}) == len(places), "ids of different texts must differ here"
    seen, gone = set(), {}
    for none, i, t in places:
        lines = t.split("\n")
        hit = set()
        for p in range(len(lines) - size + 1):
            window = tuple(lines[p : p + size])
            if window in seen:
                hit.update(range(p, p + size))
            seen.add(window)
        gone[none, i] = hit
    out = []
    for i, t in rows:
        hit = gone[i is None, i or 0]
        lines = (t or "").split("\n")
        kept = "\n".join(x for k, x in enumerate(lines) if k not in hit) if hit else t
        spans = sum(k - 1 not in hit for k in hit)
        out.append((i, kept, len(lines), len(hit), spans))
    return out


def test_lines(spark):
    a, b, c, d = "one line", "two lines", "three", "four"
    rows = [
        (1, f"{a}\n{b}\n{c}\n{d}"),
        (2, f"x\n{a}\n{b}\n{c}\ny"),
        (3, f"{b}\n{c}\n{d}\n{a}\n{b}\n{c}"),
        (4, f"{a}\n{b}"),
        (5, None),
        (6, ""),
        (7, "\n\n\n\n"),
        (8, "r\n" * 50),
        (9, f"{a}\n{b}\n{c}\n{d}"),
        (9, f"{a}\n{b}\n{c}\n{d}"),
        (None, f"{b}\n{c}\n{d}\nend"),
        (12, "\n".join(f"{k % 7} {k // 20}" for k in range(3000))),
    ]
    got = dedup_lines(docs(spark, rows))
    assert got.columns[:2] == ["doc_id", "text"] and got.columns.count("n_lines") == 1
    found = [tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_removed", "n_spans").collect()]
    assert key(found) == key(brute_lines(rows))


def test_lines_of_a_very_long_text(spark):
    """Seconds, not hours: 200,000 lines, a shared passage at either end."""
    shared = "\n".join(["alpha", "beta", "gamma"])
    rows = [(k, shared + "\n" + "\n".join(f"line {k} {i}" for i in range(200_000)) + "\n" + shared) for k in (1, 2)]
    began = time.monotonic()
    got = {r.doc_id: r for r in dedup_lines(docs(spark, rows)).collect()}
    assert time.monotonic() - began < 60
    assert [got[k].n_removed for k in (1, 2)] == [3, 6] and [got[k].n_spans for k in (1, 2)] == [1, 2]
    assert got[2].text == rows[1][1][len(shared) + 1 : -len(shared) - 1]


def test_lines_of_one_id_and_of_an_empty_table(spark):
    text = "a\nb\nc\nd"
    got = dedup_lines(docs(spark, [(1, text), (1, text + "\ne")])).collect()
    assert sorted(r.n_removed for r in got) == [0, 4]
    assert dedup_lines(docs(spark, [])).collect() == []


def test_native_plans(spark):
    for made in (exact_duplicates(docs(spark, ROWS)), dedup_lines(docs(spark, ROWS))):
        plan = made._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
