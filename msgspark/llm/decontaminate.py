"""Benchmark decontamination: a generalised suffix automaton of the test items reads the corpus."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from .arrays import LOWER, U, mix, slices, span_hashes, utf8, word_spans

WINDOW = 13
#: A document is contaminated when its hit words are at least one in so many.
ONE_IN = 20
#: Item text of one automaton; more items are read in several passes of such parts.
PART_BYTES = 1 << 20
#: Fixed values of the word rule: digits, a-z and every byte outside ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_HIT = pa.struct([("at", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])  # a word and its bytes
_FOUND = pa.schema([
    ("__tag", pa.int64()), ("n_words", pa.int64()), ("__hits", pa.list_(_HIT)),
    ("items", pa.list_(pa.int64())), ("spans", pa.list_(_SPAN)),
])
_OUT = ("n_words", "n_hit", "items", "spans", "contaminated")


class Automaton:
    """Suffix automaton of several word sequences, with the items each window stands in.

    The 13-word windows of long items and the whole of short ones are looked up by the
    state that holds them: a state has at most one string of a given length.
    """

    def __init__(self, items: list[tuple[int, list[int]]], window: int):
        self.window = window
        self.length, self.link, self.moves = [0], [-1], [{}]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.windows: dict[tuple[int, int], set[int]] = {}
        for item, words in items:
            size = min(window, len(words))
            for state, _, length in self.read(words):
                if length >= size > 0:
                    self.windows.setdefault((self.shorten(state, size), size), set()).add(item)
        self.sizes = sorted({size for _, size in self.windows})

    def _extend(self, last: int, w: int) -> int:
        there = self.moves[last].get(w)
        if there is not None:
            if self.length[there] == self.length[last] + 1:
                return there
            return self._split(last, w, there)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and w not in self.moves[last]:
            self.moves[last][w] = new
            last = self.link[last]
        if last >= 0:
            there = self.moves[last][w]
            fits = self.length[there] == self.length[last] + 1
            self.link[new] = there if fits else self._split(last, w, there)
        return new

    def _split(self, at: int, w: int, there: int) -> int:
        """The shorter strings of a state move to a state of their own."""
        twin = self._state(self.length[at] + 1, self.link[there], dict(self.moves[there]))
        self.link[there] = twin
        while at >= 0 and self.moves[at].get(w) == there:
            self.moves[at][w] = twin
            at = self.link[at]
        return twin

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.moves.append(moves)
        return len(self.length) - 1

    def read(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(state, position, length) of the longest match that ends at each position."""
        state = length = 0
        for i, w in enumerate(words):
            while state and w not in self.moves[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.moves[state].get(w, 0)
            length = length + 1 if state else 0
            yield state, i, length

    def shorten(self, state: int, size: int) -> int:
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def find(self, words: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """(first word, end, items) of every window that occurs."""
        for state, i, length in self.read(words):
            for size in self.sizes:
                if size > length:
                    break
                items = self.windows.get((self.shorten(state, size), size))
                if items:
                    yield i + 1 - size, i + 1, items


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = word_spans(LOWER[data], offsets, WORD)
    return starts, ends, span_hashes(LOWER[data], starts, ends)


def _grams(ids: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(len(ids) - size + 1, 0), dtype=U)
    for k in range(size):
        out = mix(out * U(0x2545F4914F6CDD1D) + ids[k : len(out) + k].astype(U))
    return out


class Part:
    """One automaton with its vocabulary and the word grams that any window is made of."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        data, offsets = utf8(pa.array([text for _, text in items], pa.large_string()))
        starts, _, hashes = _tokens(data, offsets)
        bounds = np.searchsorted(starts, offsets)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        words = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.automaton = Automaton(
            [(i, w.tolist()) for (i, _), w in zip(items, words, strict=True) if len(w)], window
        )
        self.gram = min([4, *self.automaton.sizes])
        grams = [_grams(w, self.gram) for w in words if len(w) >= self.gram]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.empty(0, U)

    def stretches(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids, and the runs of words all of whose grams stand in some item.

        No window can occur outside such a run, so the automaton need not read there.
        """
        if not len(self.grams) or len(hashes) < self.gram:
            return hashes, np.empty(0, np.int64), np.empty(0, np.int64)
        ids = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[ids] == hashes
        n = len(hashes) - self.gram + 1
        fit = owner[:n] == owner[self.gram - 1 :]
        for k in range(self.gram):
            fit &= known[k : n + k]
        at = np.flatnonzero(fit)
        found = np.zeros(n + 2, dtype=np.int8)
        if len(at):
            key = np.zeros(len(at), dtype=U)
            for k in range(self.gram):
                key = mix(key * U(0x2545F4914F6CDD1D) + ids[at + k].astype(U))
            place = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
            found[at[self.grams[place] == key] + 1] = 1
        edge = np.diff(found)
        return ids, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + self.gram - 1


@lru_cache(maxsize=1)
def _part(items: tuple[tuple[int, str], ...], window: int) -> Part:
    return Part(list(items), window)


def _runs(hits: list[dict]) -> list[dict]:
    """Byte ranges of the runs of neighbouring words."""
    out: list[dict] = []
    last = None
    for hit in hits:
        if last is not None and hit["at"] == last + 1:
            out[-1]["stop"] = hit["stop"]
        else:
            out.append({"start": hit["start"], "stop": hit["stop"]})
        last = hit["at"]
    return out


def _scan(items: tuple[tuple[int, str], ...], window: int, everything: bool):
    """Adds hit words and items to every document, or only to those that have some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _part(items, window)
        for batch, data, offsets in slices(batches, "text"):
            starts, ends, hashes = _tokens(data, offsets)
            bounds = np.searchsorted(starts, offsets)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            ids, firsts, stops = part.stretches(hashes, owner)
            hit = np.zeros(len(hashes) + 1, dtype=np.int32)
            found: dict[int, set[int]] = {}
            for a, b in zip(firsts.tolist(), stops.tolist(), strict=True):
                cut = a  # a run may go over the edge between two documents
                while cut < b:
                    stop = min(b, int(bounds[owner[cut] + 1]))
                    for first, end, which in part.automaton.find(ids[cut:stop].tolist()):
                        hit[cut + first] += 1
                        hit[cut + end] -= 1
                        found.setdefault(int(owner[cut]), set()).update(which)
                    cut = stop
            marked = np.cumsum(hit[:-1]) > 0
            raw, rows = data.tobytes(), []
            chosen = list(range(batch.num_rows)) if everything else sorted(found)
            for i in chosen:
                a, b = bounds[i], bounds[i + 1]
                own = np.flatnonzero(marked[a:b]) if i in found else np.empty(0, np.int64)
                hits = [
                    {"at": w, "start": x, "stop": y}
                    for w, x, y in zip(
                        own.tolist(),
                        (starts[a + own] - offsets[i]).tolist(),
                        (ends[a + own] - offsets[i]).tolist(),
                        strict=True,
                    )
                ]
                rows.append({
                    "__tag": zlib.crc32(raw[offsets[i] : offsets[i + 1]]),
                    "n_words": int(b - a),
                    "__hits": hits,
                    "items": sorted(found.get(i, ())),
                    "spans": _runs(hits),
                })
            if rows:
                kept = batch if everything else batch.take(pa.array(chosen))
                new = pa.RecordBatch.from_pylist(rows, schema=_FOUND)
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, *new.columns], names=[*kept.schema.names, *new.schema.names]
                )

    return run


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = WINDOW,
    one_in: int = ONE_IN,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """All columns of ``docs`` and the benchmark words in every document.

    n_words and n_hit are the numbers of words and of words inside an occurrence of an
    item's window, items the item_ids with occurring windows, spans the byte ranges of
    the hit words (runs joined) and contaminated means n_hit > 0 and ``one_in`` * n_hit >= n_words. Input columns of
    these names are replaced.

    A window is ``window`` consecutive words of an item, or the whole of an item that
    has fewer; an item or text that is null or has no words has no windows and no hits.
    Repeated items add nothing, repeated documents get a row each; rows of a null
    item_id are ignored. A text of any length is read whole, an empty table of documents
    gives no rows, one of items no hits.

    The items travel to the tasks; their size is checked and parts of ``part_bytes``
    are read one after the other, so a task never holds more than one part. Documents
    are read where they lie and nothing is shuffled; only with several parts, the
    further findings are joined to the documents.
    """
    docs = docs.drop(*_OUT, "__tag", "__hits")
    items = items.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), "text"
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // part_bytes
    found = []
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).distinct().collect()
        own = tuple(sorted((r.item_id, r.text) for r in rows))
        frame = docs if k == 0 else docs.select("doc_id", "text")
        kind = T.StructType([*frame.schema.fields, *from_arrow_schema(_FOUND).fields])
        found.append(frame.mapInArrow(_scan(own, window, k == 0), kind))
    out = found[0] if parts == 1 else _joined(found)
    out = out.withColumn("n_hit", F.size("__hits").cast("long")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))
    )
    return out.select(*docs.columns, *_OUT)


def _joined(found: list[DataFrame]) -> DataFrame:
    """The findings of the further parts put to those of the first, which has every row."""
    more = found[1]
    for other in found[2:]:
        more = more.unionByName(other)
    more = more.groupBy(F.col("doc_id").alias("__of"), F.col("__tag").alias("__as")).agg(
        F.flatten(F.collect_list("__hits")).alias("__more"),
        F.flatten(F.collect_list("items")).alias("__others"),
    )
    both = found[0].join(
        more,
        F.col("doc_id").eqNullSafe(F.col("__of")) & (F.col("__tag") == F.col("__as")),
        "left",
    )
    kind = T.StructType(both.schema.fields)
    return both.mapInArrow(_united, kind)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits, items and spans of all parts in the columns of the first."""
    for batch in batches:
        names = batch.schema.names
        columns = list(batch.columns)
        hits, more, items, others, spans = (
            columns[names.index(n)].to_pylist() for n in ("__hits", "__more", "items", "__others", "spans")
        )
        for i, further in enumerate(more):
            if further:
                all_hits = {h["at"]: h for h in [*hits[i], *further]}
                hits[i] = [all_hits[w] for w in sorted(all_hits)]
                items[i] = sorted({*items[i], *others[i]})
                spans[i] = _runs(hits[i])
        for name, values in (("__hits", hits), ("items", items), ("spans", spans)):
            at = names.index(name)
            columns[at] = pa.array(values, _FOUND.field(name).type)
        yield pa.RecordBatch.from_arrays(columns, names=names)


def without_spans(
    found: DataFrame, *, longest: int | None = WINDOW, one_in: int | None = ONE_IN
) -> DataFrame:
    """What ``contamination`` returned, with the spans over a limit cut out of text.

    A span of ``longest`` words or more goes (a word is what ``contamination`` counts); all
    spans of a document go when its hit words are at least one in ``one_in``. None is no
    limit. The text on both sides is joined as it stands; removed holds the byte ranges,
    the other columns are those of the input text. A null text stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            columns = list(batch.columns)
            texts, spans, n_words, n_hit = (
                columns[names.index(n)].to_pylist() for n in ("text", "spans", "n_words", "n_hit")
            )
            out, removed = [], []
            for text, own, words, hits in zip(texts, spans, n_words, n_hit, strict=True):
                raw = (text or "").encode()
                if one_in is None or not hits or one_in * hits < words:
                    own = [s for s in own or () if longest is not None and _count(raw, s) >= longest]
                kept, at = [], 0
                for s in own:
                    kept.append(raw[at : s["start"]])
                    at = s["stop"]
                out.append(text if text is None else b"".join([*kept, raw[at:]]).decode())
                removed.append(own)
            columns[names.index("text")] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(removed, pa.list_(_SPAN))], names=[*names, "removed"]
            )

    found = found.drop("removed")
    kind = T.StructType([*found.schema.fields, *from_arrow_schema(pa.schema([("removed", pa.list_(_SPAN))])).fields])
    return found.mapInArrow(run, kind)


def _count(raw: bytes, span: dict) -> int:
    data = np.frombuffer(raw[span["start"] : span["stop"]], dtype=np.uint8)
    return len(_tokens(data, np.array([0, len(data)]))[0])
