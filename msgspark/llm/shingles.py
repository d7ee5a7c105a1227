"""Word shingles of whole documents, and the similarity sketch over them."""

from __future__ import annotations

import numpy as np

from .arrays import LOWER, U, mix, seeded, span_hashes, word_spans

#: Fixed values of the word rule: everything but white space.
WORD = np.ones(256, dtype=bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def shingle_hashes(
    data: np.ndarray, offsets: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all word shingles in document order, and n + 1 bounds per document.

    A document with 1 .. size - 1 words has its whole word sequence as its only shingle.
    """
    data = LOWER[data]
    starts, ends = word_spans(data, offsets, WORD)
    words = span_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    counts = np.diff(bounds)
    grams = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    limits = np.concatenate([[0], np.cumsum(grams)])
    padded = np.concatenate([words, np.zeros(size, dtype=U)])
    at = np.repeat(bounds[:-1] - limits[:-1], grams) + np.arange(limits[-1])
    room = np.repeat(bounds[1:], grams)
    out = np.zeros(len(at), dtype=U)
    for k in range(size):  # beyond the document's end (short documents) a mark takes the word's place
        out = mix(out * U(0x2545F4914F6CDD1D) + np.where(at + k < room, padded[at + k], seeded(77)))
    return out, limits


def distinct_sets(hashes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of each document end to end, and their bounds."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(limits[:-1], limits[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    joined = np.concatenate(parts) if parts else np.empty(0, U)
    return joined, np.concatenate([[0], np.cumsum(sizes)])


def sketches(sets: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Fast similarity sketch of every set: one row of ``width`` coordinates each.

    Round r < width throws every element into one hashed bin with a hashed value;
    round width + b throws all elements into bin b. A coordinate keeps the least
    (round, value) it ever gets, so each is filled after 2 * width rounds at most
    and nearly always after few, and no coordinate of a non-empty set stays empty.
    A document leaves the rounds once its bins are full.
    """
    n = len(bounds) - 1
    out = np.full(n * width, np.iinfo(np.uint64).max, dtype=U)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(n), sizes)
    open_docs = sizes > 0
    elements = sets
    empty = np.iinfo(np.uint64).max
    for r in range(2 * width):
        if r:
            full = (out.reshape(n, width) != empty).all(axis=1)
            still = open_docs & ~full
            if not still.any():
                break
            if (still != open_docs).any():
                keep = still[owner]
                owner, elements, open_docs = owner[keep], elements[keep], still
        h = mix(elements ^ seeded(1000 + r))
        if r < width:
            cell = owner * width + ((h >> U(32)) * U(width) >> U(32)).astype(np.int64)
        else:
            cell = owner * width + (r - width)
        value = mix(h) & U((1 << 54) - 1) | U(r << 54)
        np.minimum.at(out, cell, value)
    return out.reshape(n, width)
