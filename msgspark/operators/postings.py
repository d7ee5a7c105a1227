"""Top-k over posting lists: what questions share no bucket with is neither read nor compared.

An inverted index of sparse vectors. The corpus is cut into parts of a bounded number of
rows, each task turning the rows it holds; a list is what one part has for one bucket, so
the list of a very common word is as many lists as there are parts. Files are ordered by
bucket: a search reads the row ranges of the buckets that its questions have, brings the
lists of a part together and adds them up there, the lists that can give most first. Only
the best k rows of a question are shuffled after that. For few questions this reads a
small share of the index; for as many as fill every bucket all lists are read and moved
once, and ``top_k``, which moves nothing of the corpus, suits better.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import postings as lists
from ..functions.vectors import DIM
from ..sources.storage import files_of, fresh_path, read_file, stored, temporary
from .embedding import hashed_embeddings
from .retrieval import BLOCK_BYTES, HELD_BYTES, TOP_K, _arrow, _hit_schema, _rank

#: Rows, and entries of their vectors, that a part holds at most (one row may hold more).
PART_ROWS = 4096
PART_ENTRIES = 1 << 20
#: Ranges of buckets that a scan is narrowed to at most; nearby buckets share one.
RANGES = 64
# Lists to a page, so that the page index can leave out what lies between two ranges.
PAGE_ROWS = 64
POSTING = "part long, bucket int, top double, at array<int>, weights array<double>, ids array<string>"


def write_postings(corpus: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    """Posting lists of ``corpus`` (``id, buckets, weights``), files ordered by bucket.

    Vectors are stored at length one; a row without entries is kept and scores 0. An empty
    corpus gives an index without lists.
    """

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rows in _runs(batches, part_rows):
            yield lists.invert(number, rows)
            number += 1

    rows = corpus.select(F.col("id").cast("string").alias("id"), "buckets", "weights")
    # written as they are made: a task that ran again could number the rows otherwise
    turned = stored(rows.mapInArrow(turn, POSTING), "turned")
    ordered = turned.repartitionByRange("bucket", "part").sortWithinPartitions("bucket", "part")
    ordered.write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows in runs of at most ``most``, shorter where their vectors are long."""
    held, rows, entries = [], 0, 0
    for batch in batches:
        sizes = np.diff(batch["buckets"].offsets.to_numpy()) if batch.num_rows else np.empty(0, np.int64)
        first = 0
        for k, size in enumerate(sizes.tolist()):
            if rows and (rows >= most or entries + size > PART_ENTRIES):
                yield pa.Table.from_batches([*held, batch.slice(first, k - first)])
                held, rows, entries, first = [], 0, 0, k
            rows, entries = rows + 1, entries + size
        if first < batch.num_rows:
            held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _near(buckets: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges that hold all of the buckets, parted at the widest gaps."""
    if not buckets:
        return []
    found = sorted(set(buckets))
    gaps = sorted((a - b, k) for k, (a, b) in enumerate(zip(found[:-1], found[1:], strict=True)) if b - a > 1)
    cuts = sorted(k for _, k in gaps[: most - 1])
    firsts = [found[0], *(found[k + 1] for k in cuts)]
    return list(zip(firsts, [*(found[k] for k in cuts), found[-1]], strict=True))


def _worth(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges, or one over all of them: leaving out little costs a scan more than it saves."""
    held = sum(last - first + 1 for first, last in ranges)
    if not ranges or 2 * held <= ranges[-1][1] - ranges[0][0] + 1:
        return ranges
    return [(ranges[0][0], ranges[-1][1])]


def read_postings(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame:
    """The lists of some buckets, and the ids of all parts.

    The ranges they lie in reach the Parquet scan, which leaves out the files, row groups
    and pages between them; single buckets are told apart after it.
    """
    wanted: Column = F.col("bucket") == lists.IDS
    for first, last in _worth(_near(buckets)):
        wanted |= F.col("bucket").between(first, last)
    rows = spark.read.schema(POSTING).parquet(path).where(wanted)
    return rows.where(F.col("bucket").isin(lists.IDS, *buckets))


def top_k_postings(
    path: str, queries: DataFrame, k: int = TOP_K, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Exactly what ``top_k`` finds for sparse questions (``query_id, buckets, weights``), from posting lists.

    Questions are written once, in files of at most ``block_bytes`` of entries each on
    average; what reaches the driver are the distinct buckets, no more than there are.
    """
    spark = queries.sparkSession
    written = queries.select("query_id", "buckets", "weights")
    asked = stored(written, "asked")
    facts = asked.agg(F.avg(F.size("buckets"))).first()[0] or 1.0
    buckets = [r.bucket for r in asked.select(F.explode("buckets").alias("bucket")).distinct().collect()]
    place = fresh_path(spark, "questions")
    most = max(1, int(block_bytes // (12 * max(1.0, facts))))
    asked.hint("rebalance").write.option("maxRecordsPerFile", most).parquet(place)
    temporary(spark, place)
    rows = read_postings(spark, path, buckets)
    together = rows.repartition("part").sortWithinPartitions("part", "bucket")
    return _rank(_meet(together, queries, files_of(spark, place), k), k)


def _meet(rows: DataFrame, queries: DataFrame, files: list[str], k: int) -> DataFrame:
    """Winners among the parts of a task for every question file."""
    schema = _arrow(queries)
    kind: T.StructType = _hit_schema(queries)

    def questions() -> Iterator[tuple[list, list]]:
        for file in files:
            block = read_file(file).combine_chunks()
            if block.num_rows:
                own, buckets, weights = lists.unit_entries(block["buckets"].chunk(0), block["weights"].chunk(0))
                cuts = np.searchsorted(own, np.arange(block.num_rows + 1))
                spans = zip(cuts[:-1], cuts[1:], strict=True)
                yield block["query_id"].to_pylist(), [(buckets[a:b].tolist(), weights[a:b]) for a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = list(questions()) if len(files) == 1 else None
        held, size = [], 0
        for part, nbytes in lists.parts(batches):
            held.append(part)
            size += nbytes
            if size >= HELD_BYTES:
                yield from meet(held, known)
                held, size = [], 0
        yield from meet(held, known)

    def meet(held: list[lists.Part], known: list | None) -> Iterator[pa.RecordBatch]:
        if held:
            for query_ids, asked in questions() if known is None else known:
                best = lists.BestOfLists(asked, k)
                for part in held:
                    best.add_part(part)
                yield best.table(query_ids, schema)

    return rows.mapInArrow(run, kind)


def top_k_text_postings(path: str, questions: DataFrame, k: int = TOP_K, dim: int = DIM, **limits) -> DataFrame:
    """Text questions (``query_id, text``) against posting lists of hashed term vectors."""
    asked = hashed_embeddings(questions.select("query_id", "text"), dim).drop("text")
    return top_k_postings(path, asked, k, **limits)
