"""Quality classifier: document scores from preference pairs (Bradley-Terry)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import HASHED, packed, slices, span_hashes, spans_by_block

#: Labelled documents that a fit reads at most, chosen by a hash of their id.
MOST_LABELLED = 20_000
PAIRS = 60_000
RIDGE = 1e-3
#: Bytes that are counted at once; the measures of a document do not depend on it.
BLOCK = 1 << 18
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LINE = np.ones(256, dtype=bool)
_LINE[0x0A] = False
_OTHER, _LOWER, _UPPER, _DIGIT, _SPACE, _DOT, _COMMA, _SHOUT, _BAR, _SIGN, _HIGH, _TAIL = range(12)
KINDS = 12


def _kinds() -> np.ndarray:
    kind = np.full(256, _OTHER, dtype=np.int64)
    kind[97:123], kind[65:91], kind[48:58] = _LOWER, _UPPER, _DIGIT
    for signs, k in ((b" \t\n\r", _SPACE), (b".", _DOT), (b",;:'\"-", _COMMA), (b"!?", _SHOUT), (b"|", _BAR), (b"#$%&*@~^_<>{}[]\\/=+", _SIGN)):
        kind[list(signs)] = k
    kind[0xC0:], kind[0x80:0xC0] = _HIGH, _TAIL
    return kind


_KIND = _kinds()
FEATURES = (
    "upper lower digit shout bar sign stop pause other high repeated_word distinct_words "
    "word_length line_words repeated_lines long_words size"
).split()


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of bounded style measures per document, all read from its whole text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    count, capitals = np.zeros((n, KINDS), dtype=np.int64), np.zeros(n, dtype=np.int64)
    for a in range(0, len(data), BLOCK):
        _count_block(data, offsets, a, min(a + BLOCK, len(data)), count, capitals)
    chars = np.maximum(sizes - count[:, _TAIL], 1)
    letters = count[:, _LOWER] + count[:, _UPPER] + count[:, _HIGH]
    # shares of few characters or words say little and are drawn to 0
    share = lambda x, of, few=2: x / (of + few)

    starts, ends = spans_by_block(data, offsets, _WORD, BLOCK)
    hashes = _hashes(data, starts, ends)
    of = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(of, minlength=n)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    repeated = np.bincount(of[again], minlength=n)
    long_words = np.bincount(of[ends - starts > 30], minlength=n)
    distinct = _distinct(hashes, of, n)
    starts, ends = spans_by_block(data, offsets, _LINE, BLOCK)
    of_line = np.searchsorted(offsets, starts, "right") - 1
    lines = np.bincount(of_line, minlength=n)
    distinct_lines = _distinct(_hashes(data, starts, ends), of_line, n)
    columns = [
        share(capitals, letters, 10),
        share(count[:, _LOWER], chars, 10),
        *(share(count[:, k], chars, 30) for k in (_DIGIT, _SHOUT, _BAR, _SIGN)),
        share(count[:, _DOT], words),
        share(count[:, _COMMA], words),
        share(count[:, _OTHER], chars),
        share(count[:, _HIGH], chars),
        share(repeated, words),
        # words of longer texts repeat anyway
        share(distinct, words) * np.log2(2 + words) / 8,
        np.minimum(share(letters, words) / 10, 3),
        np.minimum(share(words, lines) / 50, 3),
        share(lines - distinct_lines, lines),
        share(long_words, words),
        np.log1p(words) / 8,
    ]
    return np.stack(columns, axis=1)


def _count_block(
    data: np.ndarray, offsets: np.ndarray, a: int, b: int, count: np.ndarray, capitals: np.ndarray
) -> None:
    """Add the kinds of the bytes from ``a`` to ``b``, and the capitals inside words, to their documents'."""
    first, last = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
    bounds = np.clip(offsets[first : last + 1], a, b)
    owner = np.repeat(np.arange(last - first), np.diff(bounds))
    # one byte more at both sides, so that a block reads like the whole
    around = np.zeros(b - a + 2, dtype=np.uint8)
    low, high = max(a - 1, 0), min(b + 1, len(data))
    around[low - a + 1 : high - a + 1] = data[low:high]
    kind = _KIND[around]
    count[first:last] += np.bincount(owner * KINDS + kind[1:-1], minlength=(last - first) * KINDS).reshape(-1, KINDS)
    capital = kind[1:-1] == _UPPER
    # capitals of Latin-1: two fixed bytes
    capital |= (around[1:-1] == 0xC3) & (around[2:] >= 0x80) & (around[2:] <= 0x9E)
    capital &= np.isin(kind[:-2], (_LOWER, _UPPER, _TAIL))  # not the first of a word
    begin = offsets[first:last]
    capital[begin[begin >= a] - a] = False  # nor of a document
    capitals[first:last] += np.bincount(owner[capital], minlength=last - first)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of spans; one that is longer than a block is read as it lies."""
    long = ends - starts > HASHED
    if not long.any():
        return span_hashes(data, starts, ends)
    out = np.empty(len(starts), dtype=np.uint64)
    out[~long] = span_hashes(data, starts[~long], ends[~long])
    for k in np.flatnonzero(long).tolist():
        digest = hashlib.blake2b(np.ascontiguousarray(data[starts[k] : ends[k]]), digest_size=8).digest()
        out[k] = int.from_bytes(digest, "little")
    return out


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    bounds = np.searchsorted(owner, np.arange(n + 1))
    return np.array(
        [len(np.unique(hashes[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], dtype=np.int64
    )


def _expand(x: np.ndarray) -> np.ndarray:
    """Measures and their saturated forms, so that a little noise already counts."""
    return np.concatenate([x, x / (x + 0.05)], axis=1)


def bradley_terry(better: np.ndarray, worse: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights w that maximise the likelihood of every pair: P = 1 / (1 + exp(-w (x - y)))."""
    delta = better - worse
    w = np.zeros(delta.shape[1])
    for _ in range(rounds):  # Newton steps of the ridge-penalised logistic loss
        p = 1 / (1 + np.exp(-np.clip(delta @ w, -30, 30)))
        slope = delta.T @ (1 - p) / len(delta) - RIDGE * w
        curve = (delta * (p * (1 - p))[:, None]).T @ delta / len(delta) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (_expand(x) - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -30, 30)))


#: Used where no two labels can be compared: every score is 0.5.
BLANK = QualityModel(np.zeros(2 * len(FEATURES)), np.ones(2 * len(FEATURES)), np.zeros(2 * len(FEATURES)), 0.0)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in slices(packed(batches, "text", 1 << 20), "text"):
        x = features(data, offsets)
        values = pa.ListArray.from_arrays(
            np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.reshape(-1)
        )
        yield pa.RecordBatch.from_arrays([part.column(0), values], names=["doc_id", "x"])


def fit(docs: DataFrame, labels: DataFrame, *, most: int = MOST_LABELLED, pairs: int = PAIRS, seed: int = 8) -> QualityModel:
    """Learn document scores from pairs of one better and one worse labelled document.

    ``labels`` has doc_id and quality (1 better, 0 worse); rows without either are
    ignored, of several labels the greater counts. At most ``most`` labelled
    documents are read, those with the least hash of their id: the sample is the
    only thing that reaches the driver, as one row of measures each. The threshold is
    a quantile of the training scores (``quantile_threshold``). Without both labels
    the model is BLANK, as it is for empty tables. Of documents that share an id one
    counts, by its measures; a null text is measured as an empty one. ``pairs`` pairs of a
    better and a worse one are drawn. Other columns are ignored.
    """
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = own.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("doc_id", "text", "quality")
    measured = (
        read.select("doc_id", "text").mapInArrow(_measure, "doc_id long, x array<double>")
        .groupBy("doc_id").agg(F.min("x").alias("x"))
        .join(sample, F.col("doc_id") == F.col("id"))
        .orderBy("doc_id")
        .select("x", "quality")
        .toPandas()
    )
    good = measured["quality"].to_numpy() == 1
    if not len(measured) or good.all() or not good.any():
        return BLANK
    x = _expand(np.array(measured["x"].tolist()))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = (x - mean) / scale
    draw = np.random.Generator(np.random.PCG64(seed))
    better = draw.choice(np.flatnonzero(good), pairs)
    worse = draw.choice(np.flatnonzero(~good), pairs)
    weights = bradley_terry(z[better], z[worse])
    return QualityModel(mean, scale, weights, quantile_threshold(z @ weights, good))


def quantile_threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The middle of two neighbouring scores: the quantile that mislabels fewest documents.

    Of equal quantiles the one in the widest gap between scores is taken.
    """
    order = np.argsort(scores, kind="stable")
    ranked, good = scores[order], good[order]
    below = np.cumsum(good)[:-1]  # better documents at or below each place
    wrong = below + (~good).sum() - (np.arange(1, len(good)) - below)
    gap = np.where(wrong == wrong.min(), np.diff(ranked), -1.0)
    cut = int(gap.argmax())
    return float(ranked[cut] + ranked[cut + 1]) / 2


def with_quality(docs: DataFrame, model: QualityModel, *, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score between 0 and 1 of the whole text.

    0.5 is the model's threshold. Null and empty texts are scored as texts without
    words, repeated rows alike, and an empty table gives no rows. A text of any length is
    measured whole. An input column called like the score is replaced.
    """
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(packed(batches, "text", 1 << 20), "text"):
            score = model.score(features(data, offsets))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(score)], names=[*part.schema.names, name]
            )

    return docs.mapInArrow(run, schema)
