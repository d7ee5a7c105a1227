"""Suffix-array dedup: repeated byte windows by a radix sort that stops at the threshold.

Every position of a text starts a suffix; only its first ``WINDOW`` bytes matter.
Suffixes whose windows are equal must meet, so a window is sent to the bucket of the
least hashed gram inside it: equal windows choose equal grams. Neighbouring windows
mostly share that gram and travel as one stretch of text, so the shuffle moves a few
bytes per suffix. A gram that very many places have (a licence line, a byline) would
fill one bucket with texts that all differ around it; grams are counted first and the
frequent ones chosen by no window that has another. Inside a bucket the suffixes are
ordered by most-significant-digit passes, a digit being the next ``DIGIT`` bytes; a
suffix alone in its group leaves after the pass, and the sort ends at the window's
depth. The groups that remain are exactly the repeated windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, gram_hashes, mix, packed, ragged, slices, span_hashes
from .scratch import Scratch

WINDOW, GRAM, DIGIT = 100, 24, 8
#: Where the digits of a window begin; the last one ends with it.
_DIGITS = (*range(0, WINDOW - DIGIT, DIGIT), WINDOW - DIGIT)
#: Any odd numbers; they join the first three digits of a window to a fingerprint.
_FACTORS = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
PIECE = 2 << 20
FLUSH = 24 << 20
SETTLE = 32 << 20
BUCKETS_PER_PARTITION = 16
#: Windows whose grams are all frequent go by their least gram of this size.
LONG_GRAM = 64
#: Grams are counted by slots; those of a slot with more places than this, and than eight times the median, are frequent.
SLOTS, MOST_PLACES = 1 << 20, 200_000
_SLOT_RANGE = 1 << 14
#: Windows that one pass over a bucket holds; a larger bucket is sorted class by class.
MOST_WINDOWS = 3_000_000
_LOW = U((1 << 24) - 1)
_NO_GRAM = U((1 << 64) - 1)
_ROW = pa.schema([("part", pa.int32()), ("meta", pa.binary()), ("body", pa.binary())])
_META = [("none", np.uint8), ("id", np.int64), ("tag", np.uint32), ("start", np.int64), ("size", np.int64)]


def _press(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=4).compress(data)


def _open(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of the fixed kinds above, differences first so that they compress well."""
    parts = [len(columns[0]).to_bytes(8, "little")]
    for (_, kind), column in zip(_META, columns, strict=True):
        step = np.array(column, dtype=kind)
        step[1:] -= step[:-1].copy()
        parts.append(step.tobytes())
    return _press(b"".join(parts))


def _unpack(blobs: list[bytes]) -> list[np.ndarray]:
    columns: list[list[np.ndarray]] = [[] for _ in _META]
    for blob in blobs:
        raw = _open(blob)
        n, at = int.from_bytes(raw[:8], "little"), 8
        for out, (_, kind) in zip(columns, _META, strict=True):
            size = n * np.dtype(kind).itemsize
            out.append(np.cumsum(np.frombuffer(raw[at : at + size], dtype=kind), dtype=kind))
            at += size
    return [np.concatenate(c) for c in columns]


def _keys(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Order of documents: null ids last, then the id, then a hash of the text."""
    ids = batch.column(batch.schema.get_field_index("doc_id"))
    none = np.asarray(ids.is_null()).astype(np.uint8)
    raw = data.tobytes()
    tags = [zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return [none, np.asarray(ids.fill_null(0)).astype(np.int64), np.array(tags, dtype=np.uint32)]


def _sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    out, done = values, 1
    while done < span:
        step = min(done, span - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def _slots(grams: np.ndarray) -> np.ndarray:
    return ((grams >> U(24)) & U(SLOTS - 1)).astype(np.int64)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many places of the texts of a partition have a gram of each slot."""
    counts = np.zeros(SLOTS, dtype=np.int64)
    for _, data, _ in slices(packed(batches, "text", PIECE), "text", PIECE):
        for at in range(0, max(1, len(data) - GRAM + 1), 2 * PIECE):  # one long text
            grams = mix(gram_hashes(data[at : at + 2 * PIECE + GRAM - 1], GRAM))
            counts += np.bincount(_slots(grams), minlength=SLOTS)
    rows = [
        {"part": a // _SLOT_RANGE, "body": _press(counts[a : a + _SLOT_RANGE].tobytes())}
        for a in range(0, SLOTS, _SLOT_RANGE)
        if counts[a : a + _SLOT_RANGE].any()
    ]
    yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("body", pa.binary())]))


def _most(places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slots of a partition with more than ``places`` and eight times the median of their range."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = np.frombuffer(_open(body), dtype=np.int64)
                sums[part] = sums[part] + counts if part in sums else counts
        found = [
            part * _SLOT_RANGE + np.flatnonzero(counts > max(places, 8 * np.median(counts)))
            for part, counts in sums.items()
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.empty(0, np.int64), *found]), pa.int64())], names=["slot"]
        )

    return run


def frequent_slots(source: DataFrame, partitions: int) -> np.ndarray:
    """Slots of the grams that very many places have: at most one in ``MOST_PLACES`` bytes."""
    counted = source.mapInArrow(_places, "part int, body binary").repartition(partitions, "part")
    rows = counted.mapInArrow(_most(MOST_PLACES), "slot long").toArrow()
    return np.sort(rows.column("slot").to_numpy())


def _least(data: np.ndarray, size: int, frequent: np.ndarray | None = None) -> np.ndarray:
    """The least gram of every window that is not frequent, with its place; all ones if there is none."""
    grams = mix(gram_hashes(data, size))
    place = np.arange(len(grams), dtype=U)
    value = (grams & ~_LOW) | (_LOW - place)
    if frequent is not None:
        value[frequent[_slots(grams)]] = _NO_GRAM
    return _sliding_least(value, WINDOW - size + 1)


def _stretches(
    data: np.ndarray, ends: np.ndarray, frequent: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of windows that choose the same gram, and its hash.

    ``ends`` holds for every byte where its document ends, ``frequent`` for every slot
    whether its grams are avoided. Of equal grams the last one in the window is chosen,
    which depends on the window's bytes alone.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U)
    least = _least(data, GRAM, frequent)
    none = least == _NO_GRAM
    if none.any():
        least = np.where(none, _least(data, LONG_GRAM), least)
    valid = np.arange(n) + WINDOW <= ends[:n]
    same = np.zeros(n + 1, dtype=bool)  # same[i]: window i continues the run of window i - 1
    same[1:n] = (least[1:] == least[:-1]) & valid[:-1] & valid[1:]
    starts = np.flatnonzero(valid & ~same[:n])
    last = np.flatnonzero(valid & ~same[1:])
    return starts, last - starts + WINDOW, mix(least[starts] >> U(24))


def _scatter(buckets: int, finals: int, slots: np.ndarray):
    """Stretches of every document by bucket; copies inside a slice are settled at once."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        bucket = np.concatenate([h[0] for h in held])
        meta = [np.concatenate([h[1][k] for h in held]) for k in range(len(_META))]
        text = np.concatenate([h[2] for h in held])
        at = np.concatenate([[0], np.cumsum(meta[4])[:-1]])
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[a:b]
            body = text[ragged(at[own], meta[4][own])].tobytes()
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "part": int(bucket[own[0]]),
                        "meta": _pack([m[own] for m in meta]),
                        "body": _press(body),
                    }
                ],
                schema=_ROW,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        frequent = None
        if len(slots):
            frequent = np.zeros(SLOTS, dtype=bool)
            frequent[slots] = True
        for part, data, offsets in slices(packed(batches, "text", PIECE), "text", PIECE):
            keys = _keys(part, data, offsets)
            rank = np.empty(part.num_rows, dtype=np.int64)
            rank[np.lexsort(keys[::-1])] = np.arange(part.num_rows)
            for at in range(0, max(1, len(data) - WINDOW + 1), 2 * PIECE):  # one long text
                piece = data[at : at + 2 * PIECE + WINDOW - 1]
                ends = np.repeat(offsets[1:], np.diff(np.clip(offsets, at, at + len(piece)))) - at
                starts, sizes, grams = _stretches(piece, ends, frequent)
                if not len(starts):
                    continue
                doc = np.searchsorted(offsets, starts + at, "right") - 1
                order = np.lexsort((starts, rank[doc]))
                starts, sizes, grams, doc = (x[order] for x in (starts, sizes, grams, doc))
                meta = [k[doc] for k in keys] + [starts + at - offsets[doc], sizes]
                whole = mix(span_hashes(piece, starts, starts + sizes) ^ grams)
                _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
                lead = first[inverse]
                copy = lead != np.arange(len(lead))
                copy[copy] = _same_bytes(piece, starts, sizes, np.flatnonzero(copy), lead[copy])
                itself = np.all([m[copy] == m[lead[copy]] for m in meta[:4]], axis=0)
                gone = np.flatnonzero(copy)[~itself]
                yield from _ranges([m[gone] for m in meta], finals)
                keep = ~copy
                meta = [m[keep] for m in meta]
                text = piece[ragged(starts[keep], sizes[keep])]
                held.append(((grams[keep] % U(buckets)).astype(np.int64), meta, text))
                size += len(text)
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)

    return run


def _same_bytes(
    text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray
) -> np.ndarray:
    """Whether the stretches of each pair are equal, byte by byte."""
    same = sizes[left] == sizes[right]
    left, right = left[same], right[same]
    if len(left):
        equal = text[ragged(starts[left], sizes[left])] == text[ragged(starts[right], sizes[left])]
        same[same] = np.logical_and.reduceat(equal, np.cumsum(sizes[left]) - sizes[left])
    return same


def _final(ids: np.ndarray, finals: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U)) % U(finals)).astype(np.int64)


def _ranges(meta: list[np.ndarray], finals: int) -> Iterator[pa.RecordBatch]:
    """Removed byte ranges of documents, by the part that puts the documents together."""
    if not len(meta[0]):
        return
    part = _final(meta[1], finals)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
    yield pa.RecordBatch.from_pylist(
        [
            {
                "part": -1 - int(part[order[a]]),
                "meta": _pack([m[order[a:b]] for m in meta]),
                "body": None,
            }
            for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        ],
        schema=_ROW,
    )


def repeated_windows(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Marks the windows of ``text`` at ``starts`` (ascending) whose bytes also start earlier."""
    valid = np.zeros(len(text), dtype=bool)
    valid[starts] = True
    return _repeated(text, valid)[starts]


def _repeated(text: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Marks the places of ``valid`` windows whose bytes also start at an earlier one.

    Radix passes from the most significant digit: a pass orders the suffixes of every
    group by their next bytes, cuts the groups where these differ and drops suffixes
    that are alone. Only the places are kept for all windows, the rest is made for one
    class of them at a time.
    """
    gone = np.zeros(len(text), dtype=bool)
    classes = int(np.count_nonzero(valid)) // MOST_WINDOWS + 1
    if len(text) < WINDOW:
        return gone
    text = np.ascontiguousarray(text)
    words = np.ndarray(len(text) - DIGIT + 1, dtype=">u8", buffer=text, strides=(1,))
    for turn in range(classes):
        index = _not_alone(words, valid, classes, turn)
        rank = np.zeros(len(index), dtype=np.int64)  # of the group; index is in its order
        for at in _DIGITS:
            digit = words[index + at].astype(U)
            differ = (digit[1:] != digit[:-1]) & (rank[1:] == rank[:-1])
            cut = np.zeros(int(rank.max(initial=-1)) + 1, dtype=bool)
            cut[rank[1:][differ]] = True
            own = np.flatnonzero(cut[rank])  # groups of equal digits are in order as they are
            order = own[np.lexsort((digit[own], rank[own]))]
            index[own], digit[own] = index[order], digit[order]
            head = _heads(rank) | _heads(digit)
            shared = ~(head & np.append(head[1:], True))
            index, rank = index[shared], np.cumsum(head[shared]) - 1
        gone[index[~_heads(rank)]] = True
    return gone


def _heads(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    return np.concatenate([np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1]])


def _not_alone(words: np.ndarray, valid: np.ndarray, classes: int, turn: int) -> np.ndarray:
    """Places of the windows of a class, but for most of those whose first three digits no other has.

    Counting by slots of a fingerprint leaves these out of the sort.
    """
    which, prints, step = [], [], 8 << 20
    for a in range(0, len(valid), step):  # a part of the text at a time
        at = np.flatnonzero(valid[a : a + step])
        if not len(at):
            continue
        digits = words[a : a + step + 2 * DIGIT].astype(U)
        own = digits[at] * _FACTORS[0] + digits[at + DIGIT] * _FACTORS[1] + digits[at + 2 * DIGIT]
        own = mix(own)
        if classes > 1:
            mine = own % U(classes) == turn
            at, own = at[mine], own[mine]
        which.append(at + a)
        prints.append(own)
    if not which:
        return np.empty(0, dtype=np.int64)
    index, key = np.concatenate(which), np.concatenate(prints)
    for shift in (0, 24):
        bits = max(10, int(4 * len(key)).bit_length())
        slot = ((key << U(shift)) >> U(64 - bits)).astype(np.int64)
        busy = np.flatnonzero(np.bincount(slot)[slot] > 1)
        index, key = index[busy], key[busy]
    return index


def _settle(
    meta: list[np.ndarray], text: np.ndarray, finals: int
) -> tuple[list[np.ndarray], np.ndarray, list[pa.RecordBatch]]:
    """Stretches in the order of their places, each text once, and the ranges of the rest.

    All windows of a later copy of a stretch stand earlier too, so it goes as a whole.
    """
    at = np.concatenate([[0], np.cumsum(meta[4])[:-1]]).astype(np.int64)
    order = np.lexsort(meta[3::-1])
    same = np.zeros(len(order), dtype=bool)  # repeated rows bring the same stretch again
    same[1:] = np.all([m[order[1:]] == m[order[:-1]] for m in meta[:4]], axis=0)
    order = order[~same]
    prints = span_hashes(text, at, at + meta[4])[order]
    _, first, inverse = np.unique(prints, return_index=True, return_inverse=True)
    lead = first[inverse]
    copy = np.flatnonzero(lead != np.arange(len(lead)))
    if len(copy):
        mine, other = order[copy], order[lead[copy]]
        equal = meta[4][mine] == meta[4][other]
        for k in range(0, len(copy), 1 << 16):  # the bytes decide, not the fingerprint
            i = slice(k, k + (1 << 16))
            size = np.where(equal[i], meta[4][mine[i]], 0)
            differ = text[ragged(at[mine[i]], size)] != text[ragged(at[other[i]], size)]
            owner = np.repeat(np.arange(len(size)), size)
            equal[i] &= np.bincount(owner[differ], minlength=len(size)) == 0
        copy = copy[equal]
    gone = list(_ranges([m[order[copy]] for m in meta], finals))
    keep = np.ones(len(order), dtype=bool)
    keep[copy] = False
    order = order[keep]
    return [m[order] for m in meta], text[ragged(at[order], meta[4][order])], gone


class _Bucket:
    """The stretches of one bucket; copies leave whenever ``SETTLE`` bytes have come in."""

    def __init__(self, finals: int):
        self.finals, self.meta, self.text, self.new = finals, [], [], 0

    def add(self, meta: bytes, body: bytes) -> list[pa.RecordBatch]:
        self.meta.append(_unpack([meta]))
        self.text.append(np.frombuffer(_open(body), dtype=np.uint8))
        self.new += len(self.text[-1])
        return self.settle() if self.new > SETTLE else []

    def settle(self) -> list[pa.RecordBatch]:
        meta = [np.concatenate(m) for m in zip(*self.meta, strict=True)]
        meta, text, gone = _settle(meta, np.concatenate(self.text), self.finals)
        self.meta, self.text, self.new = [meta], [text], 0
        return gone

    def sorted(self) -> Iterator[pa.RecordBatch]:
        yield from self.settle()
        yield from _sort_bucket(self.meta[0], self.text[0], self.finals)


def _sort_bucket(meta: list[np.ndarray], text: np.ndarray, finals: int) -> Iterator[pa.RecordBatch]:
    at = np.concatenate([[0], np.cumsum(meta[4])[:-1]])
    if not len(meta[4]):
        return
    valid = np.ones(len(text), dtype=bool)  # a stretch ends with WINDOW - 1 places that start no window
    for k in range(1, WINDOW):
        valid[at + meta[4] - k] = False
    gone = _repeated(text, valid)
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    closes = gone.copy()
    closes[:-1] &= ~gone[1:]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    own = np.searchsorted(at, first, "right") - 1
    size = last - first + WINDOW
    yield from _ranges(
        [meta[0][own], meta[1][own], meta[2][own], meta[3][own] + first - at[own], size],
        finals,
    )


def _sort(finals: int):
    """Sorts bucket after bucket of a partition; only one is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                part, meta, body = (batch.column(k)[row].as_py() for k in range(3))
                if part < 0:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), pa.array([meta]), pa.array([None], pa.binary())],
                        schema=_ROW,
                    )
                    continue
                if part != now:
                    if bucket:
                        yield from bucket.sorted()
                    now, bucket = part, _Bucket(finals)
                yield from bucket.add(meta, body)
        if bucket:
            yield from bucket.sorted()

    return run


def _texts(finals: int):
    """The documents of a slice by their part, compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(packed(batches, "text", 4 << 20), "text"):
            keys = _keys(batch, data, offsets)
            sizes = np.diff(offsets)
            part = _final(keys[1], finals)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = order[a:b]
                meta = [*(k[own] for k in keys), np.zeros(len(own), np.int64), sizes[own]]
                body = data[ragged(offsets[:-1][own], sizes[own])].tobytes()
                rows.append({"part": int(part[own[0]]), "meta": _pack(meta), "body": _press(body)})
            yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

    return run


def _joined(ranges: tuple[np.ndarray, np.ndarray] | None) -> list[tuple[int, int]]:
    """Maximal runs of the given starts (ascending) and sizes."""
    if ranges is None:
        return []
    starts, sizes = ranges
    reach = np.maximum.accumulate(starts + sizes)
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    last = np.append(first[1:], len(starts)) - 1
    return list(zip(starts[first].tolist(), reach[last].tolist(), strict=True))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a part come ranges first, then documents, one after the other."""
    now, ranges, index = None, [], {}
    out, size_out = [], 0
    for batch in batches:
        for row in range(batch.num_rows):
            part, meta, body = (batch.column(k)[row].as_py() for k in range(3))
            if part != now:
                now, ranges, index = part, [], {}
            if body is None:
                ranges.append(meta)
                continue
            if ranges:
                columns = _unpack(ranges)
                order = np.lexsort(columns[3::-1])
                columns = [c[order] for c in columns]
                change = np.any([np.diff(c) != 0 for c in columns[:3]], axis=0)
                cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(order)]])
                index = {
                    tuple(int(c[a]) for c in columns[:3]): (columns[3][a:b], columns[4][a:b])
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True)
                }
                ranges = []
            found, texts, begin = _unpack([meta]), _open(body), 0
            for none, doc_id, tag, _, size in zip(*(c.tolist() for c in found), strict=True):
                text, begin = texts[begin : begin + size], begin + size
                spans = _joined(index.get((none, doc_id, tag)))
                kept, at = [], 0
                for x, y in spans:
                    kept.append(text[at:x])
                    at = y
                kept.append(text[at:])
                out.append({
                    "doc_id": None if none else doc_id,
                    "n_bytes": len(text),
                    "spans": [{"start": x, "stop": y} for x, y in spans],
                    "kept": b"".join(kept),
                })
                size_out += size
            if size_out > PIECE:
                yield pa.RecordBatch.from_pylist(out, schema=_OUT)
                out, size_out = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_OUT)


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(_SPAN)), ("kept", pa.binary())
])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Bytes that also stand earlier go: (doc_id, n_bytes, spans, kept).

    Every byte inside a string of ``WINDOW`` bytes that also starts earlier (a smaller
    doc_id, or the same text further to the left) is removed; strings never cross
    documents and are judged on the input. spans are the maximal removed byte ranges,
    kept is what remains. A null text is empty; a null id comes last. Texts that share
    an id are ordered by a hash; rows that repeat both count as one document and each
    gets its result. A very long text is read in pieces; an empty table gives no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, finals = BUCKETS_PER_PARTITION * partitions, partitions
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "part int, meta binary, body binary"
    slots = frequent_slots(source, partitions)
    stretches = source.mapInArrow(_scatter(buckets, finals, slots), kind)
    ranges = (
        stretches.repartition(partitions, "part").sortWithinPartitions("part")
        .mapInArrow(_sort(finals), kind)
        .withColumn("part", -1 - F.col("part"))
    )
    ranges = Scratch(spark).write(ranges, "ranges")
    return (
        ranges.unionByName(source.mapInArrow(_texts(finals), kind))
        .repartition(partitions, "part")
        .sortWithinPartitions("part", F.isnotnull("body"))
        .mapInArrow(_merge, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    )
