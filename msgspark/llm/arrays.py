"""Numpy helpers over Arrow text batches: byte arrays, words, 64-bit fingerprints.

All functions are vectorised over a whole slice of documents. A slice is a run of
rows with a bounded number of text bytes, so memory does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 4 << 20
BASE = U(0x9E3779B97F4A7C15)
_INVERSE = pow(int(BASE), -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(
    1, 1 << 63, 256, dtype=np.uint64
)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # only A-Z


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeded(seed: int) -> np.uint64:
    return mix(np.array([seed * 0x632BE59BD9B4E019 % 2**64], dtype=U))[0]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and the n + 1 offsets; null is empty."""
    kind = pa.large_binary()
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    column = pc.fill_null(column.cast(kind), b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows of at most ``most`` text bytes (or one row)."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield (
                batch.slice(at, end - at),
                data[offsets[at] : offsets[end]],
                offsets[at : end + 1] - offsets[at],
            )
            at = end


def packed(frames: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Join small batches until they hold about ``most`` text bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in frames:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_STEP = 1 << 16
#: Bytes that are fingerprinted at once; what spans there give does not depend on it.
HASHED = 1 << 20


@lru_cache(maxsize=2)
def _first_powers(base: int) -> np.ndarray:
    """Powers 0 .. _STEP - 1 modulo 2**64."""
    out = np.full(_STEP, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, at: np.ndarray) -> np.ndarray:
    """Powers of an odd number modulo 2**64, put together from those of two short tables."""
    far = np.full(int(at.max(initial=0)) // _STEP + 1, pow(base, _STEP, 1 << 64), dtype=U)
    far[0] = 1
    return _first_powers(base)[at % _STEP] * np.multiply.accumulate(far)[at // _STEP]


def word_spans(
    data: np.ndarray, offsets: np.ndarray, member: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes; a run never crosses documents."""
    inside = member[data]
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~first[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~first[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def spans_by_block(
    data: np.ndarray, offsets: np.ndarray, member: np.ndarray, block: int
) -> tuple[np.ndarray, np.ndarray]:
    """What ``word_spans`` finds, with the memory of one block besides the result."""
    starts, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a in range(0, len(data), block):
        b = min(a + block, len(data))
        inner = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")]
        first, last = word_spans(data[a:b], np.unique([a, b, *inner]) - a, member)
        first, last = first + a, last + a
        if len(first) and first[0] == a and len(ends[-1]) and ends[-1][-1] == a and not (len(inner) and inner[0] == a):
            ends[-1] = ends[-1][:-1]  # the run goes on
            first = first[1:]
        starts.append(first)
        ends.append(last)
    return np.concatenate(starts), np.concatenate(ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of every span of bytes, equal spans anywhere being equal.

    Spans in order (of starts and of ends) are read block by block, so little is held
    besides the result.
    """
    out = np.empty(len(starts), dtype=U)
    ordered = len(starts) < 2 or bool((np.diff(starts) >= 0).all() and (np.diff(ends) >= 0).all())
    a = 0
    while a < len(starts):
        b = len(starts)
        if ordered:
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + HASHED, "right")))
        first, last = int(starts[a:b].min()), int(ends[a:b].max())
        sums = np.zeros(last - first + 1, dtype=U)
        weighted = _TABLE[data[first:last]]
        weighted *= powers(int(BASE), np.arange(last - first))
        np.cumsum(weighted, out=sums[1:])
        begin, end = starts[a:b] - first, ends[a:b] - first
        out[a:b] = mix((sums[end] - sums[begin]) * powers(_INVERSE, begin) + (end - begin).astype(U))
        a = b
    return out


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Polynomial fingerprint of every run of ``size`` bytes, by doubling."""
    have = np.take(_TABLE, data)
    out, done, span = None, 0, 1
    while True:
        if size & span:
            if out is None:
                out = have
            else:
                n = len(data) - done - span + 1
                out = out[:n] * U(pow(int(BASE), span, 1 << 64))
                out += have[done : done + n]
            done += span
        if done == size:
            return out
        n = len(data) - 2 * span + 1
        wider = have[:n] * U(pow(int(BASE), span, 1 << 64))
        wider += have[span : span + n]
        have = wider
        span *= 2


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start .. start + length - 1 of every run, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
