"""The queries of operators 5 and 8 against plain code, and their reading of very long texts."""

import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from frames import docs, prose

import __spark_entry__ as entry
from msgspark.llm import language, quality
from msgspark.llm.arrays import mix, spans_by_block, word_spans


def plain_measures(text):
    text = text or ""
    is_high = lambda c: ord(c) >= 0x80
    lower, upper, digit = (len(re.findall(p, text)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    high = sum(map(is_high, text))
    shout, bar, stop, pause = (len(re.findall(p, text)) for p in ("[!?]", r"\|", r"\.", "[,;:'\"-]"))
    sign = len(re.findall(r"[#$%&*@~^_<>{}\[\]\\/=+]", text))
    space = len(re.findall("[ \t\n\r]", text))
    chars = len(text)
    other = chars - lower - upper - digit - high - shout - bar - stop - pause - sign - space
    chars, letters = max(chars, 1), lower + upper + high
    inner = sum(
        bool(re.match("[A-ZÀ-Þ]", c)) and (bool(re.match("[a-zA-Z]", p)) or is_high(p))
        for p, c in zip(text, text[1:])
    )
    words = re.findall("[^ \t-\r]+", text)
    lines = re.findall("[^\n]+", text)
    n, m = len(words), len(lines)
    return [
        inner / (letters + 10), lower / (chars + 10), digit / (chars + 30), shout / (chars + 30), bar / (chars + 30),
        sign / (chars + 30), stop / (n + 2), pause / (n + 2), other / (chars + 2), high / (chars + 2),
        sum(a == b for a, b in zip(words, words[1:])) / (n + 2),
        len(set(words)) / (n + 2) * math.log2(2 + n) / 8,
        min(letters / (n + 2) / 10, 3), min(n / (m + 2) / 50, 3), (m - len(set(lines))) / (m + 2),
        sum(len(w.encode()) > 30 for w in words) / (n + 2), math.log1p(n) / 8,
    ]


TEXTS = [
    "A word. Another", "Ends in a letter", "The next begins with a capital", "", "ÀÉ xÀ ×", "\n\n a\n a\nb", "aA" * 40,
    "x" * 31 + " " + "é" * 16, "same same  same", "!?|#$\v\f\x00", prose(1, 200), "ß\nß\n\nß",
]


def arrow(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize("block", [1, 7, 1 << 18])
def test_measures_are_those_of_each_text_alone(monkeypatch, block):
    monkeypatch.setattr(quality, "BLOCK", block)
    got = quality.features(*arrow(TEXTS))
    assert got == pytest.approx(np.array([plain_measures(t) for t in TEXTS]))
    monkeypatch.setattr(quality, "HASHED", 5)
    assert quality.features(*arrow(TEXTS)) == pytest.approx(got)


@pytest.mark.parametrize("block", [1, 2, 5, 100])
def test_runs_by_block(block):
    data, offsets = arrow(TEXTS)
    for member in (quality._WORD, quality._LINE):
        whole, cut = word_spans(data, offsets, member), spans_by_block(data, offsets, member, block)
        assert [x.tolist() for x in whole] == [x.tolist() for x in cut]


def part(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_quality_query_against_plain_code(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").collect()
    known = sorted((r.doc_id, r.quality) for r in marks if r.doc_id in texts and r.quality is not None and part(r.doc_id, 3) != 1)
    measures = {i: np.array(plain_measures(t)) for i, t in texts.items()}
    expand = lambda x: np.concatenate([x, x / (x + 0.05)])
    x = np.array([expand(measures[i]) for i, _ in known])
    good = np.array([q == 1 for _, q in known])
    z = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-9)
    draw = np.random.Generator(np.random.PCG64(8))
    better, worse = (draw.choice(np.flatnonzero(g), quality.PAIRS) for g in (good, ~good))
    delta = z[better] - z[worse]
    w = np.zeros(delta.shape[1])
    for _ in range(60):  # the same optimum by weighted least squares
        p = 1 / (1 + np.exp(-delta @ w))
        root = np.sqrt(p * (1 - p))[:, None]
        target = (delta @ w + (1 - p) / np.maximum(p * (1 - p), 1e-12))[:, None]
        ridge = math.sqrt(quality.RIDGE * len(delta)) * np.eye(len(w))
        left, right = np.vstack([delta * root, ridge]), np.vstack([target * root, np.zeros((len(w), 1))])
        w = np.linalg.lstsq(left, right, rcond=None)[0][:, 0]
    scores = z @ w
    cuts = sorted(scores)
    wrong = [int(((scores > c) != good).sum()) for c in cuts[:-1]]
    gaps = [b - a if e == min(wrong) else -1.0 for a, b, e in zip(cuts, cuts[1:], wrong)]
    cut = int(np.argmax(gaps))
    limit = (cuts[cut] + cuts[cut + 1]) / 2
    got = entry.queries()["op8_quality_classifier"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (expand(measures[r.doc_id]) - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-9) @ w - limit
        assert r.score == pytest.approx(1 / (1 + math.exp(-min(max(raw, -30), 30))), abs=1e-4)
        assert r.held_out == (part(r.doc_id, 3) == 1) and r.predicted == int(r.score >= 0.5)


@cache
def bucket(gram):
    key = 0
    for order, c in enumerate(gram, 1):
        key = (key * 0x100000001B3 + c + order) % 2**64
    return int(mix(np.array([key], dtype=np.uint64))[0]) % language.BUCKETS


def script_of(c):
    return max((s for s in language.SCRIPTS if s[0] <= ord(c)), key=lambda s: s[0])[1]


@cache
def letter(c):
    return (c.lower() if len(c.lower()) == 1 else c, script_of(c)) if ord(c) < 0x30000 and c.isalpha() else None


def plain_words(text):
    """(lower-case word, script), words being runs of letters of one script."""
    found, before = [], None
    for c in text or "":
        now = letter(c)
        if now and before == now[1]:
            found[-1][0].append(now[0])
        elif now:
            found.append(([now[0]], now[1]))
        before = now and now[1]
    return [("".join(w), s) for w, s in found]


@cache
def grams(word):
    edged = [0, *(ord(c) + 1 for c in word), 0]
    return [bucket(tuple(edged[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(edged) - k + 1) if k > 1 or edged[i]]


def test_language_query_against_plain_code(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    assert Counter(r.lang for r in rows).most_common(1)[0][1] <= language.MOST_PER_LANGUAGE  # the fit reads every row
    words = {r.doc_id: plain_words(r.text) for r in rows}
    counts, letters = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        if part(r.doc_id, 5) and r.lang is not None and r.text is not None:
            for (w, s), n in Counter(words[r.doc_id]).items():
                letters[r.lang][s] += n * len(w)
                for b in grams(w):
                    counts[r.lang][b] += n
    names = sorted(counts)
    total = {k: sum(counts[k].values()) + language.SMOOTHING * language.BUCKETS for k in names}
    allowed = {k: {s for s, n in letters[k].items() if n >= language.SCRIPT_SHARE * sum(letters[k].values())} for k in names}

    @cache
    def scores(word, script):
        fit = [k for k in names if script in allowed[k]]
        if not fit:
            return [0.0] * len(names)
        own = [sum(math.log((counts[k][b] + language.SMOOTHING) / total[k]) for b in grams(word)) / 4 for k in names]
        return [x if k in fit else -1e4 for x, k in zip(own, names)]

    got = entry.queries()["op5_language_id"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (part(r.doc_id, 5) == 0)
        own = words[r.doc_id]
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        state, ways = [(s, (k,)) for k, s in enumerate(scores(*own[0]))], []
        for w in own[1:]:
            best = max(range(len(names)), key=lambda k: state[k][0])
            came = [k if state[k][0] >= state[best][0] - language.SWITCH else best for k in range(len(names))]
            ways.append(came)
            state = [(max(state[k][0], state[best][0] - language.SWITCH) + s, ()) for k, s in enumerate(scores(*w))]
        path = [max(range(len(names)), key=lambda k: state[k][0])]
        for came in reversed(ways):
            path.append(came[path[-1]])
        share = Counter()
        for (w, _), k in zip(own, reversed(path)):
            share[k] += len(w)
        k = min(share, key=lambda k: (-share[k], k))
        assert r.lang_pred == names[k]
        assert r.score == pytest.approx(share[k] / sum(share.values()))


@pytest.mark.parametrize("letters", [1, 10, 1 << 18])
def test_words_by_block(monkeypatch, letters):
    monkeypatch.setattr(language, "LETTERS", letters)
    texts = [*TEXTS, "ab ab abc", "", "Σαν σαν 漢字かな漢字 x\U00020000\U00031350\U0010FFFF", "ab"]
    got = language.words_of(*arrow(texts))
    points, bounds, scripts = got.distinct
    names = ["".join(map(chr, points[a:b])) for a, b in zip(bounds, bounds[1:])]
    for k, text in enumerate(texts):
        own = np.flatnonzero(got.owner == k)
        assert [(names[w], language.NAMES[s]) for w, s in zip(got.kind[own], got.script[own])] == plain_words(text)
        assert [text[a : a + n].lower() for a, n in zip(got.starts[own] - got.offsets[k], got.sizes[own])] == [w for w, _ in plain_words(text)]


def test_a_long_text_is_read_in_blocks():
    import tracemalloc

    data, offsets = arrow([" ".join(prose(k, 1000) for k in range(100)).replace("w", "wörtlich")])
    language.words_of(*arrow(TEXTS))
    tracemalloc.start()
    language.words_of(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data) > 1 << 20 and peak < 30 * len(data)


def test_a_long_text_is_measured_in_blocks(spark):
    import tracemalloc

    data, offsets = arrow([prose(3, 900_000)])  # some 4 MB
    quality.features(*arrow(TEXTS))
    tracemalloc.start()
    quality.features(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * len(data)  # words of four bytes
    model = quality.fit(docs(spark, []), docs(spark, []).selectExpr("doc_id", "1 as quality"))
    assert quality.with_quality(docs(spark, [(1, prose(3, 500_000))]), model).first().score == 0.5
