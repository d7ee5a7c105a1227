"""Token counts without tokens: Viterbi that carries the best score and the piece count."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import Remembered, Vocabulary, marked


def count_pieces(vocabulary: Vocabulary, part: str) -> tuple[int, int, float]:
    """(pieces, byte pieces among them, score) of the best segmentation of one part."""
    n = len(part)
    best: list[float | None] = [0.0] + [None] * n
    pieces, spelt = [0] * (n + 1), [0] * (n + 1)
    done = 0  # positions whose best is final

    def unknown(e: int) -> None:
        """The last choice for position e, so it wins only when strictly better."""
        if part[e - 1] not in vocabulary.single:
            score = best[e - 1] + vocabulary.unknown
            if best[e] is None or score > best[e]:
                size = len(part[e - 1].encode("utf-8", "surrogatepass"))
                best[e], pieces[e], spelt[e] = score, pieces[e - 1] + size, spelt[e - 1] + size

    for last, (length, score, _) in vocabulary.matches.iter(part):
        e = last + 1
        while done < e - 1:
            done += 1
            unknown(done)
        score += best[e - length]
        if best[e] is None or score > best[e]:
            best[e], pieces[e], spelt[e] = score, pieces[e - length] + 1, spelt[e - length]
    while done < n:
        done += 1
        unknown(done)
    return pieces[n], spelt[n], best[n]


def token_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Size of every whole text in tokens: (doc_id, n_tokens, n_byte_tokens, score).

    The counts are those of the best unigram segmentation under the tie rules of
    ``Vocabulary``. A null or empty text has no tokens and score 0. Rows are
    independent: nothing is shuffled, repeated rows repeat and an empty table gives no
    rows. Texts of any length are read whole, with the memory of a small multiple of the
    longest. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(lambda part: count_pieces(vocabulary, part))
        for batch in batches:
            totals = []
            for text in batch.column(1).to_pylist():
                found = list(map(known.__getitem__, vocabulary.parts(marked(text))))
                totals.append([sum(x) for x in zip(*found, strict=True)] or [0, 0, 0.0])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([t[0] for t in totals], pa.int64()),
                    pa.array([t[1] for t in totals], pa.int64()),
                    pa.array([t[2] for t in totals], pa.float64()),
                ],
                names=["doc_id", "n_tokens", "n_byte_tokens", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, n_byte_tokens long, score double"
    )
