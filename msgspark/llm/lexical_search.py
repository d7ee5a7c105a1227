"""Ranked lexical search: all items at once, sums of shared term sets computed once.

The documents are read once and leave the terms that any item has, with their
frequencies. Term sets that several items share are mined from the items and form a
graph: a node is a term or the sum of two nodes, an item the sum of a few nodes. Every
block of documents gets the partial scores of each node once, and the items add them up.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.limits import top_n_per_key
from .arrays import packed, slices
from .scratch import Scratch

MOST = 50
#: Bytes of item texts that one pass over the documents serves.
PART_BYTES = 1 << 20
#: Items whose shared sets are mined together, and neighbours of a term that are tried with it.
GROUP = 256
WIDE = 64
#: Bytes of partial scores that a task holds at once.
BLOCK_BYTES = 32 << 20
PIECE = 1 << 20

#: Letters and digits of ASCII and everything beyond; only A-Z is lower-cased.
_TERM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a long text piece by piece."""
    raw = raw.translate(_TERM)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE) if len(raw) - at > PIECE else -1
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


class Sharing:
    """How the items of one group are summed: shared pairs of nodes first, each once.

    Node k below ``terms`` is a term, node ``terms`` + k the sum of the two nodes
    ``sums[k]``; ``items[i]`` are the nodes whose sum is item i. Every pair that two or
    more items still share is joined, the most shared first; terms that stand in the very
    same items are joined at once. ``WIDE`` bounds the pairs that are tried, so a poor
    choice costs additions but never changes a sum.
    """

    def __init__(self, items: list[frozenset[int]], terms: int):
        self.terms, self.sums = terms, []
        held: dict[int, int] = defaultdict(int)  # node: bits of the items it stands in
        for i, own in enumerate(items):
            for t in own:
                held[t] |= 1 << i
        alike: dict[int, list[int]] = defaultdict(list)
        for t in sorted(held):
            alike[held[t]].append(t)
        nodes: dict[int, int] = {}
        for bits, own in alike.items():
            if bits.bit_count() < 2:
                nodes.update((t, bits) for t in own)
                continue
            node = own[0]
            for t in own[1:]:
                node = self._join(node, t)
            nodes[node] = bits
        self._mine(nodes, len(items))
        self.items: list[list[int]] = [[] for _ in items]
        for node, bits in nodes.items():
            for i in _places(bits):
                self.items[i].append(node)

    def _join(self, a: int, b: int) -> int:
        self.sums.append((a, b))
        return self.terms + len(self.sums) - 1

    def _mine(self, nodes: dict[int, int], n: int) -> None:
        inside: list[set[int]] = [set() for _ in range(n)]
        for node, bits in nodes.items():
            if bits.bit_count() > 1:
                for i in _places(bits):
                    inside[i].add(node)
        agenda = set()
        for own in inside:
            order = sorted(own, key=lambda x: (-nodes[x].bit_count(), x))
            for k, a in enumerate(order):
                agenda.update((min(a, b), max(a, b)) for b in order[k + 1 : k + 1 + WIDE])
        heap = [(-c, a, b) for a, b in agenda if (c := (nodes[a] & nodes[b]).bit_count()) > 1]
        heapq.heapify(heap)
        while heap:
            count, a, b = heapq.heappop(heap)
            both = nodes[a] & nodes[b]
            now = both.bit_count()
            if now < 2:
                continue
            if now < -count:  # some of its items have been joined otherwise
                heapq.heappush(heap, (-now, a, b))
                continue
            node = self._join(a, b)
            nodes[node] = both
            nodes[a] ^= both
            nodes[b] ^= both
            places = _places(both)
            for i in places:
                inside[i] -= {a, b}
            tried = sorted(inside[places[0]] | inside[places[-1]], key=lambda x: (-nodes[x].bit_count(), x))[:WIDE]
            for x in tried:
                if (c := (nodes[x] & both).bit_count()) > 1:
                    heapq.heappush(heap, (-c, x, node))
            for i in places:
                inside[i].add(node)

    def additions(self) -> int:
        """Additions of one evaluation, all terms being there."""
        return len(self.sums) + sum(max(0, len(own) - 1) for own in self.items)

    def evaluate(self, values: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """(item, its sum) of the items of which any term has a value."""
        values = dict(values)
        for k, (a, b) in enumerate(self.sums, self.terms):
            x, y = values.get(a), values.get(b)
            if x is not None or y is not None:
                values[k] = y if x is None else x if y is None else x + y
        for i, own in enumerate(self.items):
            found = [values[node] for node in own if node in values]
            if found:
                yield i, sum(found[1:], found[0])


def _places(bits: int) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


def _postings(vocabulary: dict[bytes, int]):
    """Number of terms of every document, and the frequencies of those in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.__contains__
        for part, data, offsets in slices(packed(batches, "text", 2 << 20), "text"):
            sizes, bounds, terms, counts = [], [0], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                size, found = 0, Counter()
                for words in terms_of(data[a:b].tobytes()):
                    size += len(words)
                    found.update(filter(known, words))
                sizes.append(size)
                terms.extend(map(vocabulary.__getitem__, found))
                counts.extend(found.values())
                bounds.append(len(terms))
            bounds = pa.array(bounds, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(bounds, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(bounds, pa.array(counts, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    return run


class _Best:
    """The best rows of one item that a task has met: greater score, then smaller doc_id, null last."""

    def __init__(self, most: int):
        self.most = most
        self.floor = 1
        self.scores, self.ids, self.none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.floor)
        if not len(at):
            return
        scores = np.concatenate([self.scores, scores[at]])
        ids, none = np.concatenate([self.ids, ids[at]]), np.concatenate([self.none, none[at]])
        order = np.lexsort((ids, none, -scores))[: self.most]
        self.scores, self.ids, self.none = scores[order], ids[order], none[order]
        if len(order) == self.most:
            self.floor = int(self.scores[-1])


def _ranked(names: list[int], groups: list[Sharing], weights: np.ndarray, total: int, length: int, most: int):
    """The best documents of a task for every item of one part."""
    nodes = max((g.terms + len(g.sums) for g in groups), default=1)
    block = int(min(1024, max(16, BLOCK_BYTES // (8 * nodes))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(most) for _ in names]
        for batch in batches:
            for first in range(0, batch.num_rows, block):
                part = batch.slice(first, block)
                column = {c: part.column(part.schema.get_field_index(c)) for c in part.schema.names}
                none = np.asarray(column["doc_id"].is_null())
                ids = np.asarray(column["doc_id"].fill_null(0))
                measure = 50 + 50 * np.asarray(column["n"]) * total // length
                terms = np.asarray(column["terms"].flatten())
                tf = np.asarray(column["counts"].flatten())
                docs = np.repeat(np.arange(len(ids)), np.asarray(column["terms"].value_lengths()))
                gain = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * measure[docs]))
                order = np.argsort(terms, kind="stable")
                cuts = np.flatnonzero(np.diff(terms[order], prepend=-1, append=-1))
                values = {}
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    own = order[a:b]
                    values[int(terms[own[0]])] = vector = np.zeros(len(ids), np.int64)
                    vector[docs[own]] = gain[own]
                at = 0
                for group in groups:
                    for i, scores in group.evaluate(values):
                        best[at + i].add(scores, ids, none)
                    at += len(group.items)
        sizes = [len(b.scores) for b in best]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array(names, np.int64), sizes)),
                pa.array(np.concatenate([b.ids for b in best]), mask=np.concatenate([b.none for b in best])),
                pa.array(np.concatenate([b.scores for b in best])),
            ],
            names=["item_id", "doc_id", "score"],
        )

    return run


_HITS = T.StructType([T.StructField(c, T.LongType()) for c in ("item_id", "doc_id", "score")])


def ranked_search(
    docs: DataFrame, items: DataFrame, *, most: int = MOST, part_bytes: int = PART_BYTES
) -> DataFrame:
    """The ``most`` documents of highest score for every item: (item_id, rank, doc_id, score).

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
    lower-cased; scores are whole numbers, 0 is no hit, equal scores rank by doc_id, a
    null doc_id last. A null or empty text has no terms and counts in no statistic.
    Documents of any length are read whole, piece by piece. Repeated rows are documents of
    their own, also under one id. The rows of one item_id count as one item with the terms
    of all of them; rows of a null item_id and items without terms get no hits. An empty
    table gives no rows; other columns are ignored.

    The items are the stated queries: their size is checked and parts of ``part_bytes``
    are taken one after the other, a pass over the documents for each. Statistics are
    those of all documents. A pass writes, for every document, its length and the item
    terms in it; the scores are made from those, and only the best of a task are shuffled.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), "text"
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // part_bytes
    found = []
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).distinct().collect()
        asked: dict[int, set[bytes]] = defaultdict(set)
        for r in rows:
            for words in terms_of(r.text.encode("utf-8", "surrogatepass")):
                asked[r.item_id].update(words)
        found.append(_search(docs, scratch, {i: own for i, own in sorted(asked.items()) if own}, most))
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return top_n_per_key(hits, ["item_id"], order, most, "doc_id").select("item_id", "rank", "doc_id", "score")


def _search(docs: DataFrame, scratch: Scratch, asked: dict[int, set[bytes]], most: int) -> DataFrame:
    spark = docs.sparkSession
    if not asked:
        return spark.createDataFrame([], _HITS)
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*asked.values())))}
    table = scratch.write(
        docs.mapInArrow(_postings(vocabulary), "doc_id long, n long, terms array<int>, counts array<long>"),
        "postings",
    )
    total, length = table.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return spark.createDataFrame([], _HITS)
    frequency = np.zeros(len(vocabulary), np.int64)
    for r in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        frequency[r.term] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(df) + 1))) for df in frequency])
    names = list(asked)
    sets = [frozenset(map(vocabulary.__getitem__, asked[i])) for i in names]
    groups = [Sharing(sets[a : a + GROUP], len(vocabulary)) for a in range(0, len(sets), GROUP)]
    return table.where("size(terms) > 0").mapInArrow(
        _ranked(names, groups, weights.astype(np.int64), total, length, most), _HITS
    )
