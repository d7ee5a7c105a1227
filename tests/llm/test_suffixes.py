import random

import numpy as np
from frames import ODD, docs, prose

from msgspark.llm import suffix_dedup
from msgspark.llm.suffix_dedup import remove_repeats, repeated_windows


def brute(rows, size=100):
    """Every window of every text, in order, looked up in those before it."""
    seen, out = set(), {}
    for none, i, t in sorted({(i is None, i or 0, t or "") for i, t in rows}):
        data = t.encode()
        gone = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - size + 1):
            window = data[p : p + size]
            if window in seen:
                gone[p : p + size] = True
            seen.add(window)
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        out[none, i] = (len(data), spans, bytes(np.frombuffer(data, np.uint8)[~gone]))
    return out


def same(spark, rows):
    want = brute(rows)
    got = remove_repeats(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = [(s.start, s.stop) for s in r.spans]
        assert (r.n_bytes, spans, bytes(r.kept)) == want[r.doc_id is None, r.doc_id or 0], r.doc_id


def test_planted_passages(spark):
    passage, other = prose(1, 60), prose(2, 45)
    rows = [
        (1, prose(3, 80) + passage),
        (2, passage + prose(4, 80)),
        (3, prose(5, 10) + passage[:99]),
        (4, prose(5, 10) + passage[:150] + other + passage[100:300]),
        (5, other + other + other),
        (6, other),
        (6, other),
        (8, "a" * 1000),
        (9, "ab" * 300),
        (10, "äöü€" * 60),
        (11, "x" + "äöü€" * 60),
        (None, passage),
    ] + [(i, t) for i, t in ODD if i in (1, 2, 3)]
    rows = [(i + 100 if t is None or not t.strip() else i, t) if i else (i, t) for i, t in rows]
    same(spark, rows)


def test_random_texts_of_few_letters(spark):
    draw = random.Random(5)
    block = ["".join(draw.choice("ab ") for _ in range(draw.randrange(40, 160))) for _ in range(12)]
    rows = [(i, "".join(draw.choice(block) for _ in range(draw.randrange(1, 12)))) for i in range(60)]
    draw.shuffle(rows)
    same(spark, rows)


def test_long_text_and_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 12)  # of this process only
    long = prose(7, 30_000, 5000)
    rows = [(1, long), (2, long[5000:90_000]), (3, prose(8, 200))]
    rows += [(10 + i, prose(9, 50)) for i in range(200)]
    same(spark, rows)


def test_texts_of_one_id_are_ordered_by_a_hash(spark):
    passage = prose(1, 60)
    got = remove_repeats(docs(spark, [(1, passage + "!"), (1, passage + "?")])).collect()
    assert sorted(len(r.spans) for r in got) == [0, 1]


def test_empty_table(spark):
    assert remove_repeats(docs(spark, [])).collect() == []


def test_a_large_bucket_is_sorted_by_classes(monkeypatch):
    text = np.frombuffer((prose(1, 300) + prose(2, 100) + prose(1, 200)).encode(), dtype=np.uint8)
    starts = np.arange(len(text) - 99)
    whole = repeated_windows(text, starts)
    monkeypatch.setattr(suffix_dedup, "MOST_WINDOWS", 97)
    assert whole.any() and (repeated_windows(text, starts) == whole).all()


def test_passes_against_every_window_looked_up(monkeypatch):
    draw = random.Random(11)
    morse = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    flipped = morse.translate(str.maketrans("ab", "ba"))  # as polynomials modulo 2^64 the same
    cases = [morse + flipped, "a" * 350, "ab" * 50, "a" * 99, ""]
    for letters in ("ab", "abcdefgh", "\x00\xff"):
        parts = ["".join(draw.choice(letters) for _ in range(n)) for n in (92, 96, 99, 100, 101, 108, 150)]
        cases.append("".join(draw.choice(parts) for _ in range(60)))
    for most in (suffix_dedup.MOST_WINDOWS, 300):
        monkeypatch.setattr(suffix_dedup, "MOST_WINDOWS", most)
        for case in cases:
            data = case.encode("latin-1")
            starts = [p for p in range(len(data) - 99) if p % 7]
            seen, want = set(), []
            for p in starts:
                want.append(data[p : p + 100] in seen)
                seen.add(data[p : p + 100])
            got = repeated_windows(np.frombuffer(data, dtype=np.uint8), np.array(starts, dtype=np.int64))
            assert got.tolist() == want


def test_a_bucket_settles_copies_on_the_way(spark, monkeypatch):
    finals = 3
    passage = np.frombuffer(prose(1, 60).encode(), dtype=np.uint8)
    bucket = suffix_dedup._Bucket(finals)
    monkeypatch.setattr(suffix_dedup, "SETTLE", 5 * len(passage))
    out = []
    for k in (7, 3, 9, 1, 3, 8, 2, 5, 4, 6, 11, 12):  # id 3 comes twice
        meta = [np.array([v], dtype=t) for v, (_, t) in zip((0, k, 0, 0, len(passage)), suffix_dedup._META)]
        out += bucket.add(suffix_dedup._pack(meta), suffix_dedup._press(passage.tobytes()))
    assert sum(len(t) for t in bucket.text) <= 6 * len(passage)
    out += list(bucket.sorted())
    found = suffix_dedup._unpack([m for b in out for m in b.column(1).to_pylist()])
    assert sorted(found[1].tolist()) == [2, 3, 4, 5, 6, 7, 8, 9, 11, 12]
    assert set(found[4].tolist()) == {len(passage)}


def shares(rows, slots):
    """Share of the stretches' bytes that the fullest bucket of many gets."""
    data = np.frombuffer("".join(t for _, t in rows).encode(), dtype=np.uint8)
    sizes = [len(t.encode()) for _, t in rows]
    ends = np.repeat(np.cumsum(sizes), sizes)
    frequent = np.zeros(suffix_dedup.SLOTS, dtype=bool)
    frequent[slots] = True
    _, size, grams = suffix_dedup._stretches(data, ends, frequent)
    load = np.bincount((grams % np.uint64(97)).astype(int), weights=size, minlength=97)
    return load.max() / load.sum()


def test_a_phrase_of_many_documents_fills_no_bucket(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_PLACES", 100)  # read by the driver only
    for length in (60, 90):
        phrase = ("Licensed under the terms that the file named LICENCE gives; no warranty of any kind, none at all." * 2)[:length]
        rows = [(i, f"{prose(i, 12, 9999)} {phrase} {prose(i + 9000, 12, 9999)}") for i in range(400)]
        slots = suffix_dedup.frequent_slots(docs(spark, rows), 2)
        assert len(slots) >= length - 24
        assert shares(rows, []) > 0.15 and shares(rows, slots) < 0.05
        same(spark, rows[:80] + [(1000 + i, rows[i][1]) for i in range(120)] + [(2000, phrase * 3), (2001, "ab" + phrase * 4)])


def test_stretches_of_one_fingerprint_are_compared_byte_by_byte():
    text = np.frombuffer(b"abcabcabdabc", dtype=np.uint8)
    starts, sizes = np.array([0, 3, 6, 9, 9]), np.array([3, 3, 3, 3, 2])
    left, right = np.array([1, 2, 3, 4]), np.array([0, 0, 0, 0])
    assert suffix_dedup._same_bytes(text, starts, sizes, left, right).tolist() == [True, False, True, False]
    assert suffix_dedup._same_bytes(text, starts, sizes, left[:0], right[:0]).tolist() == []
