"""SentencePiece encoding and decoding, with the N best segmentations by A-star search."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from .arrays import packed, ragged, slices
from .lattices import Lexicon
from .vocabulary import SPACE, Vocabulary, marked

N_BEST = 3
SLICE = 2 << 20
_EDIT = pa.struct([("at", pa.int32()), ("size", pa.int32()), ("ids", pa.list_(pa.int32()))])
_ALTERNATIVE = pa.struct([("score", pa.float64()), ("edits", pa.list_(_EDIT))])
_COLUMNS = {
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "score": (T.DoubleType(), pa.float64()),
    "alternatives": (
        from_arrow_type(pa.list_(_ALTERNATIVE)),
        pa.list_(_ALTERNATIVE),
    ),
}


def lattice(vocabulary: Vocabulary, part: str) -> list[list[tuple[int, float, int]]]:
    """For each position the pieces that end there, longest first: (start, score, id).

    A character without a piece of its own ends with an unknown piece, id -1.
    """
    ends: list[list[tuple[int, float, int]]] = [[] for _ in range(len(part) + 1)]
    for last, (length, score, i) in vocabulary.matches.iter(part):
        ends[last + 1].append((last + 1 - length, score, i))
    for e, c in enumerate(part, 1):
        if c not in vocabulary.single:
            ends[e].append((e - 1, vocabulary.unknown, -1))
    return ends


def n_best(vocabulary: Vocabulary, part: str, most: int) -> list[tuple[float, list[int]]]:
    """The ``most`` best segmentations of one part: (score, ids), the best first.

    The forward pass gives the best score up to each position. The search then runs
    from the end and extends the hypothesis whose own score plus that of the best way
    to it is greatest; as this estimate is exact, hypotheses are finished in the
    order of their scores. Of equal ones the one with less text left goes first,
    then the one found earlier, longer pieces before shorter.
    """
    ends = lattice(vocabulary, part)
    n = len(part)
    best = [0.0] * (n + 1)
    for e in range(1, n + 1):
        best[e] = max(best[s] + score for s, score, _ in ends[e])
    # (minus estimate, text left, order found, score so far, (position, piece, rest of the chain))
    agenda = [(-best[n], n, 0, 0.0, None)]
    out, found = [], 1
    while agenda and len(out) < most:
        _, position, _, so_far, chain_ = heappop(agenda)
        if not position:
            out.append((so_far, _ids(vocabulary, part, chain_)))
            continue
        for start, score, i in ends[position]:
            own = so_far + score
            heappush(agenda, (-(own + best[start]), start, found, own, (start, i, chain_)))
            found += 1
    return out


def _ids(vocabulary: Vocabulary, part: str, link) -> list[int]:
    ids = []
    while link:
        start, i, link = link
        ids += vocabulary.byte_pieces(part[start]) if i < 0 else [i]
    return ids


def _combined(loss: float, found: list[list[tuple[float, list[int]]]], most: int) -> list[tuple[float, tuple[int, ...]]]:
    """The next ``most`` choices among the segmentations of several parts, the best left out."""
    out, agenda, seen = [], [(loss, (0,) * len(found))], set()
    while agenda and len(out) <= most:
        loss, choice = heappop(agenda)
        out.append((loss, choice))
        for p, c in enumerate(choice):
            if c + 1 < len(found[p]):
                other = (*choice[:p], c + 1, *choice[p + 1 :])
                if other not in seen:
                    seen.add(other)
                    heappush(agenda, (loss + found[p][c][0] - found[p][c + 1][0], other))
    return out[1:]


def encode_texts(
    lexicon: Lexicon, texts: list[str | None], most: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[dict]]]:
    """ids end to end, bounds, scores and alternatives of the texts.

    Every part is scored once. Only the ``most`` - 1 parts of a text that lose least by
    their second choice can differ in its next best segmentations, so the search runs
    for those alone.
    """
    codes = lexicon.read([lexicon.vocabulary.parts(marked(text)) for text in texts])
    names: list[str] | None = None
    flat = np.concatenate(codes) if codes else np.empty(0, np.int64)
    counts = np.diff(lexicon.bounds)[flat] if len(flat) else flat
    ids = lexicon.flat[ragged(lexicon.bounds[:-1][flat], counts)] if len(flat) else np.empty(0, np.int32)
    cuts = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(counts)])
    scores, alternatives = np.zeros(len(texts)), []
    for i, own in enumerate(codes):
        scores[i] = lexicon.score[own].sum()
        alternatives.append([])
        if most < 2 or not len(own):
            continue
        loss = lexicon.loss[own]
        near = np.argpartition(loss, most - 2)[: most - 1] if len(loss) >= most else np.arange(len(loss))
        near = np.sort(near[np.isfinite(loss[near])])
        found = []
        for k in own[near].tolist():
            if k not in lexicon.known:
                names = names or list(lexicon.index)
                lexicon.known[k] = n_best(lexicon.vocabulary, names[k], most)
            found.append(lexicon.known[k])
        begin = at[cuts[i] + near] - at[cuts[i]]
        for lost, choice in _combined(0.0, found, most - 1):
            alternatives[i].append({
                "score": float(scores[i] - lost),
                "edits": [
                    {"at": int(b), "size": len(f[0][1]), "ids": f[c][1]}
                    for b, f, c in zip(begin, found, choice, strict=True)
                    if c
                ],
            })
    return ids, at[cuts], scores, alternatives


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    *,
    most: int = N_BEST,
    keep: list[str] | None = None,
    verify: bool = False,
) -> DataFrame:
    """All columns of ``docs`` (or those to ``keep``) and the pieces of each whole text.

    ids is the best segmentation and score its score; alternatives are the next best
    of the whole text in order, each given by what it has in place of ``size`` ids
    from ``at`` on. With ``verify``, round_trip tells whether decoding the ids gives the
    text back. A null or empty text has no ids and score 0, repeated rows are encoded
    alike and an empty table gives no rows. A text of any length is encoded whole. Input
    columns of these names are replaced. Nothing is shuffled.
    """
    docs = docs.drop(*_COLUMNS, "round_trip")
    names = docs.columns if keep is None else keep
    schema = T.StructType(
        [
            *(docs.schema[c] for c in names),
            *(T.StructField(k, kind) for k, (kind, _) in _COLUMNS.items()),
            *([T.StructField("round_trip", T.BooleanType())] if verify else []),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(vocabulary, most > 1)
        table = spelling(vocabulary) if verify else []
        for part, _, _ in slices(packed(batches, "text", SLICE), "text", SLICE):
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            ids, bounds, scores, alternatives = encode_texts(lexicon, texts, most)
            columns = [
                *(part.column(part.schema.get_field_index(c)) for c in names),
                pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids)),
                pa.array(scores),
                pa.array(alternatives, pa.list_(_ALTERNATIVE)),
            ]
            if verify:
                cuts = zip(bounds[:-1].tolist(), bounds[1:].tolist(), texts, strict=True)
                columns.append(pa.array([decode_ids(table, ids[a:b]) == (t or "") for a, b, t in cuts]))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def spelling(vocabulary: Vocabulary) -> list[bytes]:
    """The bytes of every id; special ids have none."""
    table = [p.encode() if i in vocabulary.normal else b"" for i, p in enumerate(vocabulary.pieces)]
    for b, i in enumerate(vocabulary.byte_ids):
        table[i] = bytes([b])
    return table


def decode_ids(table: list[bytes], ids: np.ndarray) -> str:
    """The text of a piece sequence; the mark in front of the text goes, others are spaces.

    Byte pieces that form no valid UTF-8 become replacement characters.
    """
    text = b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text.replace(SPACE, " ")[1:] if text.startswith(SPACE) else text.replace(SPACE, " ")


def decode(frame: DataFrame, vocabulary: Vocabulary, *, name: str = "decoded") -> DataFrame:
    """All columns of ``frame`` and the text of its ids; null or no ids give an empty text."""
    frame = frame.drop(name)
    schema = T.StructType([*frame.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = spelling(vocabulary)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            flat = np.asarray(ids.values)
            bounds = np.asarray(ids.offsets)
            texts = [decode_ids(table, flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name]
            )

    return frame.mapInArrow(run, schema)
