"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, mix, packed, ragged, slices

#: Documents per language that a fit reads, give or take what a random draw of this size varies.
MOST_PER_LANGUAGE = 1000
_SHARES = 10**12
#: Scores of words times languages that identify holds at once, as bytes of text times languages.
SLICE_WORK = 64 << 20
BUCKETS = 1 << 16
#: Letters whose words are fingerprinted at once (or one word).
LETTERS = 1 << 18
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
#: What a change of language between two words costs, in natural logarithms.
SWITCH = 8.0
#: Share of a language's letters that a script needs to count as one of its scripts.
SCRIPT_SHARE = 0.01
UNDETERMINED = "und"

#: First code points of script ranges, and the script from there on.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB07, "other"), (0xFF21, "latin"), (0xFF5B, "other"), (0xFF66, "kana"),
    (0xFFA0, "other"), (0x20000, "han"),
)
NAMES = tuple(sorted({name for _, name in SCRIPTS}))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: is it a letter, its lower case, its script."""
    top, every = 0x30000, 0x110000  # what lies beyond counts as no letter
    letter = np.zeros(every, dtype=bool)
    letter[:top] = np.fromiter((chr(c).isalpha() for c in range(top)), dtype=bool, count=top)
    lower = np.arange(every, dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    starts = np.array([s for s, _ in SCRIPTS])
    names = np.array([NAMES.index(n) for _, n in SCRIPTS])
    script = names.astype(np.int8)[np.searchsorted(starts, np.arange(every), "right") - 1]
    return letter, lower, script


@dataclass
class Words:
    """Words of a slice: maximal runs of letters of one script inside one document."""

    starts: np.ndarray
    sizes: np.ndarray
    owner: np.ndarray
    script: np.ndarray
    kind: np.ndarray  # which of the distinct words
    distinct: tuple[np.ndarray, np.ndarray, np.ndarray]  # code points end to end, bounds, scripts
    offsets: np.ndarray


def _word_prints(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of every word: the sum of mixed (letter, place in the word), block by block."""
    power = np.uint64(0x9E3779B97F4A7C15)
    out = np.empty(len(starts), dtype=U)
    stops = np.cumsum(sizes)  # in letters, words end to end
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(stops, stops[a] - sizes[a] + LETTERS, "right")))
        at = ragged(starts[a:b], sizes[a:b])
        place = (at - np.repeat(starts[a:b], sizes[a:b])).astype(U)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(low[at].astype(U) * power + place))])
        ends = np.cumsum(sizes[a:b])
        out[a:b] = sums[ends] - sums[ends - sizes[a:b]]
        a = b
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    letter, lower, script = _tables()
    lead = (data & 0xC0) != 0x80
    sizes = [np.count_nonzero(lead[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    del lead
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
    inside = letter[points]
    of = np.where(inside, script[points], np.int8(-1))
    same = np.zeros(len(points) + 1, dtype=bool)
    same[1:-1] = of[1:] == of[:-1]
    same[offsets] = False
    starts = np.flatnonzero(inside & ~same[:-1])
    sizes = np.flatnonzero(inside & ~same[1:]) + 1 - starts
    del inside, same
    low = lower[points]
    del points
    print_ = _word_prints(low, starts, sizes)
    _, first, kind = np.unique(print_, return_index=True, return_inverse=True)
    own = ragged(starts[first], sizes[first])
    return Words(
        starts,
        sizes,
        np.searchsorted(offsets, starts, "right") - 1,
        of[starts],
        kind,
        (low[own], np.concatenate([[0], np.cumsum(sizes[first])]), of[starts[first]]),
        offsets,
    )


def gram_buckets(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all letter grams of the words, edges marked, and the word of each."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    edged = np.zeros(len(points) + 2 * n, dtype=U)  # 0 marks both edges
    shift = np.repeat(2 * np.arange(n) + 1, sizes)
    edged[np.arange(len(points)) + shift] = points.astype(U) + U(1)
    owner = np.repeat(np.arange(n), sizes + 2)
    buckets, owners = [], []
    key = np.zeros(len(edged), dtype=U)
    for order in range(1, max(ORDERS) + 1):
        m = len(edged) - order + 1
        if m <= 0:
            break
        key = key[:m] * U(0x100000001B3) + edged[order - 1 :] + U(order)
        if order in ORDERS:
            fit = owner[:m] == owner[order - 1 :]
            if order == 1:
                fit &= edged != 0
            buckets.append((mix(key[fit]) % U(BUCKETS)).astype(np.int64))
            owners.append(owner[:m][fit])
    return np.concatenate(buckets), np.concatenate(owners)


def _count(languages: list[str]):
    """Gram and script counts by language of one partition of training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {name: k for k, name in enumerate(languages)}
        width = BUCKETS + len(NAMES)
        counts: dict[int, np.ndarray] = {}  # only of the languages that occur here
        for part, data, offsets in slices(packed(batches, "text", 1 << 20), "text"):
            lang = np.array([index[x] for x in part.column(1).to_pylist()])
            words = words_of(data, offsets)
            points, bounds, _ = words.distinct
            buckets, owner = gram_buckets(points, bounds)
            of = lang[words.owner]
            for k in np.unique(of).tolist():
                own = counts.setdefault(k, np.zeros(width))
                seen = np.bincount(words.kind[of == k], minlength=len(bounds) - 1)
                own[:BUCKETS] += np.bincount(buckets, weights=seen[owner], minlength=BUCKETS)
                script = np.bincount(words.script[of == k], weights=words.sizes[of == k], minlength=len(NAMES))
                own[BUCKETS:] += script
        for k in sorted(counts):
            at = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at), k, dtype=np.int32)),
                    pa.array(at.astype(np.int32)),
                    pa.array(counts[k][at].astype(np.int64)),
                ],
                names=["language", "bucket", "n"],
            )

    return run


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # log-probability of every bucket by language
    allowed: np.ndarray  # script by language

    def word_scores(self, words: Words) -> np.ndarray:
        """Score of every word in every language; languages without its script are out."""
        points, bounds, script = words.distinct
        n = len(bounds) - 1
        scores = np.zeros((n, len(self.languages)), dtype=np.float64)
        step = 1 << 15
        for a in range(0, n, step):
            b = min(a + step, n)
            buckets, owner = gram_buckets(points[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            for k in range(len(self.languages)):
                scores[a:b, k] = np.bincount(owner, weights=self.table[buckets, k], minlength=b - a)
        scores /= len(ORDERS)  # each letter is in a gram of every order
        fit = self.allowed[script]
        none = ~fit.any(axis=1)
        scores = np.where(fit | none[:, None], scores, -1e4)
        scores[none] = 0.0  # a script that no language has says nothing
        return scores[words.kind]


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word; sequences are read side by side, one word of each a step."""
    n, labels = scores.shape
    path = np.zeros(n, dtype=np.int64)
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = bounds[:-1][order], sizes[order]
    if not len(sizes) or not sizes[0]:
        return path
    came = np.zeros((n, labels), dtype=np.min_scalar_type(max(labels - 1, 0)))
    active = int((sizes > 0).sum())
    state = scores[first[:active]].copy()
    final = np.zeros(len(sizes), dtype=np.int64)
    own = np.arange(labels)
    for t in range(1, int(sizes[0]) + 1):
        live = int(np.searchsorted(-sizes, -t, "left"))  # longer than t words
        if live < active:
            final[live:active] = state[live:active].argmax(axis=1)
            active = live
            state = state[:active]
        if not active:
            break
        best = state.argmax(axis=1)
        jump = state[np.arange(active), best] - switch
        stay = state >= jump[:, None]
        at = first[:active] + t
        came[at] = np.where(stay, own, best[:, None])
        state = np.where(stay, state, jump[:, None]) + scores[at]
    last = final
    for t in range(int(sizes[0]) - 1, -1, -1):
        live = int(np.searchsorted(-sizes, -t, "left"))
        at = first[:live] + t
        path[at] = last[:live]
        if t:
            last[:live] = came[at, last[:live]]
    return path


def fit(docs: DataFrame, *, most: int = MOST_PER_LANGUAGE) -> LanguageModel:
    """Learn letter-gram scores of every lang of ``docs`` from its texts.

    Rows of a null lang or text are ignored, repeated rows count each; a table without
    any other row gives a model without languages. About ``most`` documents of each
    language are read, chosen by a hash of the row
    against the share that ``most`` is of all. Counts are added up in the
    tasks and by Spark; the driver gets one number per language and used bucket.
    """
    named = docs.where("lang is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("id"), "text", "lang"
    )
    counts = {r.lang: r["count"] for r in named.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0)), np.zeros((len(NAMES), 0), dtype=bool))
    limits = F.create_map(*[
        x
        for k in languages
        for x in (F.lit(k), F.lit(min(_SHARES, _SHARES * most // counts[k])).cast("long"))
    ])
    sample = named.where(
        F.pmod(F.xxhash64("id", "text"), F.lit(_SHARES).cast("long")) < limits[F.col("lang")]
    ).select("text", "lang")
    sums = (
        sample.mapInArrow(_count(languages), "language int, bucket int, n long")
        .groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    found = np.zeros((len(languages), BUCKETS + len(NAMES)))
    found[sums["language"], sums["bucket"]] = sums["n"]
    grams, scripts = found[:, :BUCKETS], found[:, BUCKETS:]
    chance = (grams + SMOOTHING) / (grams.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return LanguageModel(
        tuple(languages), np.log(chance).T.astype(np.float32), (share >= SCRIPT_SHARE).T
    )


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())])


def identify(docs: DataFrame, model: LanguageModel, *, switch: float = SWITCH) -> DataFrame:
    """Language of every whole text: (doc_id, lang, score, spans).

    Each word gets the scores of the languages that have its script; the best path
    through the words, paying ``switch`` for each change, labels them. lang is the
    language with most letters (of equals the first by name), score its share of the
    letters, spans the runs of one language as character ranges from the first word's
    start to the last word's end. A text that is null or has no letter, and every text
    when no language was learned, is ``und`` with score 0 and no spans. Repeated rows get
    equal answers, an empty table gives none. A very long text is labelled whole, in one
    task, with some tens of bytes for each of its own. Only doc_id and text are read, other
    columns may have any name; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(model.languages)
        size = max(1 << 16, min(4 << 20, SLICE_WORK // max(1, len(names))))
        for part, data, offsets in slices(packed(batches, "text", size), "text", size):
            n, labels = part.num_rows, len(names)
            words = words_of(data, offsets)
            if not labels or not len(words.starts):
                yield _answers(part, [UNDETERMINED] * n, np.zeros(n), [[]] * n)
                continue
            bounds = np.searchsorted(words.owner, np.arange(n + 1))
            path = viterbi(model.word_scores(words), bounds, switch)
            letters = np.bincount(
                words.owner * labels + path, weights=words.sizes, minlength=n * labels
            ).reshape(n, labels)
            total = letters.sum(axis=1)
            best = letters.argmax(axis=1)
            langs = [names[b] if t else UNDETERMINED for b, t in zip(best, total, strict=True)]
            score = letters[np.arange(n), best] / np.maximum(total, 1)
            change = np.ones(len(path) + 1, dtype=bool)
            change[1:-1] = (path[1:] != path[:-1]) | (words.owner[1:] != words.owner[:-1])
            first = np.flatnonzero(change)
            spans: list[list[dict]] = [[] for _ in range(n)]
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                o = int(words.owner[a])
                base = int(words.offsets[o])
                spans[o].append({
                    "start": int(words.starts[a]) - base,
                    "stop": int(words.starts[b - 1] + words.sizes[b - 1]) - base,
                    "lang": names[path[a]],
                })
            yield _answers(part, langs, score, spans)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang string, score double, spans array<struct<start:long,stop:long,lang:string>>"
    )


def _answers(part: pa.RecordBatch, langs: list[str], score: np.ndarray, spans: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.list_(_SPAN))],
        names=["doc_id", "lang", "score", "spans"],
    )
