"""Posting lists of a part of a corpus: rows turned into lists, and the best rows of questions.

Small helper for the search over posting lists. Spark splits, sorts and shuffles the
lists; a task holds the lists of a few parts, each of a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .topk import DIGITS, Best

#: The row of a part that holds its ids instead of a list.
IDS = -1
SCHEMA = pa.schema(
    [
        ("part", pa.int64()),
        ("bucket", pa.int32()),
        ("top", pa.float64()),
        ("at", pa.list_(pa.int32())),
        ("weights", pa.list_(pa.float64())),
        ("ids", pa.list_(pa.string())),
    ]
)
# A bound has to miss the k-th score by more than what rounding can add.
SLACK = 10.0**-DIGITS
# Entries that are added up in the time that one is looked up.
LOOKUP = 4


def unit_entries(buckets: pa.ListArray, weights: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors as entries (row, bucket, weight), every row divided by its length."""
    sizes = np.diff(buckets.offsets.to_numpy())
    rows = np.repeat(np.arange(len(sizes)), sizes)
    values = weights.flatten().to_numpy().astype(np.float64)
    norms = np.sqrt(np.bincount(rows, values * values, len(sizes)))[rows]
    values = np.divide(values, norms, out=np.zeros_like(values), where=norms > 0)
    return rows, buckets.flatten().to_numpy(), values


def invert(part: int, rows: pa.Table) -> pa.RecordBatch:
    """The lists of some rows (``id, buckets, weights``), bucket by bucket, after a row with their ids.

    Rows are numbered in the order of their ids, and a list names them in that order.
    ``top`` is the largest absolute weight of a list.
    """
    rows = rows.take(pa.array(np.argsort(np.array(rows["id"].to_pylist(), dtype=object), kind="stable")))
    rows = rows.combine_chunks()
    own, buckets, weights = unit_entries(rows["buckets"].chunk(0), rows["weights"].chunk(0))
    order = np.lexsort((own, buckets))
    own, buckets, weights = own[order].astype(np.int32), buckets[order], weights[order]
    first = np.flatnonzero(np.diff(buckets, prepend=IDS - 1))
    bounds = np.concatenate([[0], first, [len(own)]]).astype(np.int32)  # the row of the ids has an empty list
    tops = np.maximum.reduceat(np.abs(weights), first) if len(first) else np.empty(0)
    n = len(first)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, part, dtype=np.int64)),
            pa.array(np.concatenate([[IDS], buckets[first]]).astype(np.int32)),
            pa.array(np.concatenate([[0.0], tops])),
            pa.ListArray.from_arrays(bounds, pa.array(own)),
            pa.ListArray.from_arrays(bounds, pa.array(weights)),
            pa.array([rows["id"].to_pylist(), *[None] * n], pa.list_(pa.string())),
        ],
        schema=SCHEMA,
    )


class Part:
    """The lists of one part that were read: bucket -> (rows, weights, top)."""

    def __init__(self, pieces: list[pa.RecordBatch]):
        self.ids = np.empty(0, dtype=object)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
        for piece in pieces:
            at, weights = piece["at"].flatten().to_numpy(), piece["weights"].flatten().to_numpy()
            offsets = piece["at"].offsets.to_numpy()
            offsets = offsets - offsets[0]
            tops = piece["top"].to_numpy()
            for k, bucket in enumerate(piece["bucket"].to_pylist()):
                if bucket == IDS:
                    self.ids = np.array(piece["ids"][k].as_py(), dtype=object)
                else:
                    own = slice(offsets[k], offsets[k + 1])
                    self.lists[bucket] = (at[own], weights[own], float(tops[k]))


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Part, int]]:
    """Every part of rows that come part by part, and the bytes it holds."""
    held: list[pa.RecordBatch] = []
    number = None
    for batch in batches:
        numbers = batch["part"].to_numpy()
        cuts = np.flatnonzero(np.diff(numbers)) + 1 if len(numbers) else []
        for a, b in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
            if a == b:
                continue
            if held and numbers[a] != number:
                yield Part(held), sum(p.nbytes for p in held)
                held = []
            number = numbers[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield Part(held), sum(p.nbytes for p in held)


class BestOfLists(Best):
    """Best ``k`` rows per question, a question being (buckets, weights) of length one.

    Lists are added up from the one that can give most to the one that can give least.
    As soon as the lists that are left cannot lift a row without any entry so far to the
    k-th score known, they are looked up for the rows alone that can still reach it, once
    those are few beside the entries of a list: adding up an entry costs less; a
    part whose lists together cannot reach it is left out. ``met`` counts entries read,
    ``there`` those of all lists of the questions.
    """

    def __init__(self, questions: list[tuple[list[int], np.ndarray]], k: int):
        super().__init__(questions, k)
        self.met = self.there = 0

    def add_part(self, part: Part) -> None:
        for j, (buckets, weights) in enumerate(self.questions):
            lists = [(*part.lists[b], w) for b, w in zip(buckets, weights, strict=True) if b in part.lists]
            lists.sort(key=lambda x: -x[2] * abs(x[3]))
            self.there += sum(len(at) for at, *_ in lists)
            left = np.cumsum([0.0, *(top * abs(w) for _, _, top, w in reversed(lists))])[::-1]
            floor = self.floor[j] - SLACK
            if left[0] < floor:
                continue
            scores, rows = np.zeros(len(part.ids)), None
            for (at, own, _, w), more in zip(lists, left, strict=False):
                if rows is None and more < floor:
                    able = np.flatnonzero(scores >= floor - more)
                    if len(able) * LOOKUP < len(at):
                        rows, scores = able, scores[able]
                if rows is None:
                    scores[at] += w * own
                    self.met += len(at)
                else:
                    place = np.minimum(np.searchsorted(at, rows), len(at) - 1)
                    hit = at[place] == rows
                    scores[hit] += w * own[place[hit]]
                    self.met += int(hit.sum())
            scores = np.round(scores, DIGITS) + 0.0
            if len(scores) and scores.max() >= self.floor[j]:
                self._merge(j, part.ids if rows is None else part.ids[rows], scores)
