import random
import re

from frames import ODD, docs, prose, words
from pyspark.sql import functions as F

from msgspark.llm.decontaminate import Automaton, contamination, without_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items):
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            v = split(text)
            size = min(13, len(v))
            for a in range(len(v) - size + 1 if v else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == v[a : a + size]:
                        hit.update(range(p, p + size))
                        found.add(item)
        out.append(repr((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))))
    return sorted(out)


ITEMS = [
    (1, prose(1, 40)), (2, prose(2, 13)), (3, prose(3, 5)), (4, "Unique!"), (5, ""), (6, None),
    (7, prose(1, 40)), (7, prose(1, 40)), (8, "w1 w2 w1 w2 w1 w2"), (9, "ÉTÉ chaud"),
]


def passage(k, a, b):
    return " ".join(split(ITEMS[k][1])[a:b])


ROWS = list(ODD) + [
    (20, prose(50, 60) + " " + passage(0, 5, 30).upper() + ". " + prose(51, 500)),
    (21, passage(0, 0, 12)),
    (22, passage(1, 0, 13) + ", " + passage(2, 0, 5)),
    (23, "so unique, (UNIQUE) uniquely"),
    (24, "w1 w2 " * 30),
    (25, "été chaud ÉTÉ chaud"),
    (26, passage(0, 0, 20) + "\n" + passage(0, 20, 40)),
    (27, passage(0, 0, 14)),
    (27, passage(0, 0, 14)),
    (28, prose(60, 30_000, 4000)),
    (29, passage(0, 0, 7)),
    (30, passage(0, 7, 14)),
]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit("no"))


def result(frame):
    got = frame.select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    return sorted(repr(tuple(r)) for r in got)


def test_against_plain_search(spark):
    frame = contamination(docs(spark, ROWS), items(spark, ITEMS))
    assert result(frame) == brute(ROWS, ITEMS)
    assert frame.columns[:2] == ["doc_id", "text"]


def test_items_in_several_parts(spark):
    frame = contamination(docs(spark, ROWS), items(spark, ITEMS), part_bytes=200)
    assert result(frame) == brute(ROWS, ITEMS)


def test_spans_are_the_bytes_of_the_hit_words(spark):
    text = "é one " + passage(1, 0, 13) + " two"
    row = contamination(docs(spark, [(1, text)]), items(spark, ITEMS[1:2])).first()
    assert [text.encode()[s.start : s.stop].decode() for s in row.spans] == [passage(1, 0, 13)]


def test_spans_are_the_same_in_several_parts(spark):
    def spans(**parts):
        found = contamination(docs(spark, ROWS), items(spark, ITEMS), **parts)
        return sorted(repr((r.doc_id, r.text, r.spans)) for r in found.collect())

    whole = spans()
    assert spans(part_bytes=200) == spans(part_bytes=60) == whole
    assert any("start" in x for x in whole)


def test_spans_over_a_limit_are_removed(spark):
    long = prose(70, 900, 4000)
    text = f"é {long} {passage(0, 5, 30)}, and {passage(2, 0, 5)}; end"
    rows = [(1, text), (2, passage(1, 0, 13) + " é"), (3, None), (4, "nothing here")]
    for size in (1 << 20, 100):
        found = contamination(docs(spark, rows), items(spark, [(1, ITEMS[0][1]), *ITEMS[1:3]]), part_bytes=size)
        got = {r.doc_id: r for r in without_spans(found).collect()}
        assert got[1].text == f"é {long} , and {passage(2, 0, 5)}; end" and len(got[1].spans) == 2
        assert (got[2].text, got[3].text, got[4].text) == (" é", None, "nothing here")
        kept = {r.doc_id: r.text for r in without_spans(found, longest=None).collect()}
        assert kept[1] == text and kept[2] == " é"


def test_empty_tables(spark):
    assert contamination(docs(spark, []), items(spark, ITEMS)).collect() == []
    row = contamination(docs(spark, [(1, "a b")]), items(spark, [(1, None)])).first()
    assert (row.n_words, row.n_hit, row["items"], row.contaminated) == (2, 0, [], False)


def test_automaton_reads_longest_matches():
    draw = random.Random(3)
    texts = [[draw.randrange(3) for _ in range(draw.randrange(1, 30))] for _ in range(8)]
    found = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    automaton = Automaton(list(enumerate(texts)), 5)
    stream = [draw.randrange(3) for _ in range(400)]
    for _, i, length in automaton.read(stream):
        want = max((n for n in range(i + 2) if tuple(stream[i + 1 - n : i + 1]) in found), default=0)
        assert length == want
    assert words(1, 2)
