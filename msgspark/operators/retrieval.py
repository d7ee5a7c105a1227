"""Top-k retrieval by cosine for a table of questions.

One plan for every size: the questions are written once to the shared folder, in files of
bounded size, and the corpus is scanned once where it lies. A task holds a bounded run of
its rows and walks the question files; per file it keeps the best k rows of every question.
Only those winners are shuffled and ranked. Nothing of the corpus is replicated or
shuffled, and no question passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import topk as kernel
from ..functions.vectors import DIM
from ..sources.storage import files_of, fresh_path, read_file, stored, temporary
from .embedding import hashed_embeddings
from .limits import top_n_per_key

TOP_K = 5
# Bytes of question vectors (as float64) that one file holds, and of corpus rows that a task holds.
BLOCK_BYTES = 32 << 20
HELD_BYTES = 64 << 20


class _Form:
    """Which columns hold the vectors, and how a task reads them."""

    def __init__(self, dim: int | None):
        self.dim = dim
        self.columns = ["embedding"] if dim is None else ["buckets", "weights"]

    def matrix(self, batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        columns = [batch.column(c) for c in self.columns]
        columns = [
            c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns
        ]
        rows = (
            kernel.dense_rows(*columns)
            if self.dim is None
            else kernel.sparse_rows(*columns, self.dim)
        )
        return kernel.unit(rows)


def _hit_schema(queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _arrow(queries: DataFrame) -> pa.Schema:
    kind = to_arrow_type(queries.schema["query_id"].dataType)
    return pa.schema([("query_id", kind), ("id", pa.string()), ("score", pa.float64())])


def _feed(best: kernel.Best, form: _Form, batch: pa.RecordBatch | pa.Table) -> None:
    for first in range(0, batch.num_rows, kernel.ROWS):
        part = batch.slice(first, kernel.ROWS)
        column = {c: part.column(c).to_pylist() for c in ("id", "cell", "set") if c in part.schema.names}
        cells = np.array(column["cell"], dtype=object) if "cell" in column else None
        sets = np.array(column["set"]) if "set" in column else None
        best.add(np.array(column["id"], dtype=object), form.matrix(part), cells, sets)


def _scan(corpus: DataFrame, queries: DataFrame, files: list[str], form: _Form, k: int) -> DataFrame:
    """Winners of every run of rows against all question files.

    With a column ``cells`` a question meets only the rows of its cells (``cell``).
    """
    schema = _arrow(queries)

    def questions() -> Iterator[tuple[list, np.ndarray, dict[str, np.ndarray] | None]]:
        for file in files:
            block = read_file(file)
            if block.num_rows:
                wanted = kernel.by_cell(block.column("cells").combine_chunks()) if "cells" in block.schema.names else None
                yield block.column("query_id").to_pylist(), form.matrix(block), wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = list(questions()) if len(files) == 1 else None
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= HELD_BYTES:
                yield from meet(held, known)
                held, size = [], 0
        yield from meet(held, known)

    def meet(held: list[pa.RecordBatch], known: list | None) -> Iterator[pa.RecordBatch]:
        if any(b.num_rows for b in held):
            for query_ids, matrix, wanted in questions() if known is None else known:
                best = kernel.Best(matrix, k, wanted)
                for batch in held:
                    _feed(best, form, batch)
                yield best.table(query_ids, schema)

    columns = [c for c in ("id", *form.columns, "cell", "set") if c in corpus.columns]
    return corpus.select(*columns).mapInArrow(run, _hit_schema(queries))


def _search(corpus: DataFrame, questions: DataFrame, form: _Form, k: int, width: int, block_bytes: int) -> DataFrame:
    """The questions written in files of at most ``block_bytes`` of vectors, the corpus scanned once."""
    spark = questions.sparkSession
    most = max(1, block_bytes // (8 * max(1, width)))
    path = fresh_path(spark, "questions")
    questions.hint("rebalance").write.option("maxRecordsPerFile", most).parquet(path)
    temporary(spark, path)
    return _rank(_scan(corpus, questions, files_of(spark, path), form, k), k)


def _rank(hits: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("id").asc()]
    best = top_n_per_key(hits, ["query_id"], order, k, "id")
    return best.select("query_id", "rank", "id", "score")


def _width(vectors: DataFrame) -> int:
    first = vectors.select(F.size("embedding")).first()
    return first[0] if first else 1


def top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    dim: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Exact ``k`` nearest corpus rows per question: ``query_id, rank, id, score``.

    Dense vectors sit in ``embedding`` (``dim=None``), sparse ones in ``buckets``
    and ``weights``. Scores are rounded to six decimals and equal scores ordered
    by id. Every question gets k rows where the corpus has as many, whatever the
    scores: a vector without length scores 0.
    """
    form = _Form(dim)
    questions = queries.select("query_id", *form.columns)
    return _search(corpus, questions, form, k, dim or _width(questions), block_bytes)


def top_k_text(
    chunks: DataFrame, questions: DataFrame, k: int = TOP_K, dim: int = DIM, **limits
) -> DataFrame:
    """Text questions against text chunks over hashed term vectors.

    ``chunks`` needs ``id`` and ``text``, or the ``buckets`` and ``weights`` an index
    already holds; ``questions`` needs ``query_id, text``.
    """
    if "buckets" in chunks.columns:
        corpus = chunks.select("id", "buckets", "weights")
    else:
        corpus = hashed_embeddings(chunks.select("id", "text"), dim).drop("text")
    asked = hashed_embeddings(questions.select("query_id", "text"), dim).drop("text")
    return top_k(corpus, asked, k, dim, **limits)


def with_chunk_fields(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add text, channel name and permalink of the hit chunks.

    The hits are written first: read back, their true size is known, so Spark
    broadcasts them while they are small and the chunk side is only scanned.
    """
    few = stored(hits, "hits")
    fields = chunks.select("id", "text", "channel_name", "permalink")
    return fields.join(few, "id").select(
        "query_id", "rank", "id", "text", "channel_name", "permalink", "score"
    )


def place_in_cells(rows: DataFrame, centres: DataFrame, n: int = 1) -> DataFrame:
    """Add ``cells``: the ``n`` nearest centres of each row, nearest first (ties by id).

    ``centres`` (``id, embedding``) are few by design, one per topic or label say, and
    bound the size of what travels to the tasks. Done once when rows are indexed.
    """
    return _placed(rows, [centres], n)


def _placed(rows: DataFrame, sets: list[DataFrame], n: int) -> DataFrame:
    """The cells of every set, one set after the other, in one pass: a task has one Python worker."""
    known = []
    for centres in sets:
        found = centres.orderBy("id").collect()
        matrix = kernel.unit(np.array([r["embedding"] for r in found], dtype=np.float64))
        known.append((np.array([r["id"] for r in found]), matrix))
    form = _Form(None)

    def near(vectors: np.ndarray) -> list[list[str]]:
        cells = []
        for names, matrix in known:
            scores = np.round(vectors @ matrix.T, kernel.DIGITS)
            cells.append(names[np.argsort(-scores, axis=1, kind="stable")[:, :n]])
        return np.concatenate(cells, axis=1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = near(form.matrix(batch)) if batch.num_rows else []
            cells = pa.array(found, type=pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, cells], names=[*batch.schema.names, "cells"]
            )

    schema = T.StructType(rows.schema.fields + [T.StructField("cells", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(run, schema)


def _in_sets(rows: DataFrame, centres: DataFrame | list[DataFrame], n: int) -> DataFrame:
    """Add ``cells`` as above; of several sets of centres the cells of each, one set after the other."""
    if isinstance(centres, DataFrame):
        return place_in_cells(rows, centres, n)
    named = [
        own.select(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")).alias("id"), "embedding")
        for k, own in enumerate(centres)
    ]
    return _placed(rows, named, n)


def cell_index(corpus: DataFrame, centres: DataFrame | list[DataFrame]) -> DataFrame:
    """Corpus rows ``id, embedding`` with the ``cell`` they belong to.

    With a list of sets of centres ``cell`` is an array: each row has a cell in every set.
    """
    placed = _in_sets(corpus.select("id", "embedding"), centres, 1)
    cell = F.col("cells")[0] if isinstance(centres, DataFrame) else F.col("cells")
    return placed.select("id", "embedding", cell.alias("cell"))


def top_k_cells(
    index: DataFrame,
    centres: DataFrame | list[DataFrame],
    queries: DataFrame,
    k: int = TOP_K,
    probes: int = 2,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Approximate nearest rows: a question meets only the ``probes`` cells nearest to it.

    ``index`` is what ``cell_index`` made of the same centres. Within those cells the
    search is exact; a question whose cells hold fewer than k rows gets fewer. The
    centres are given, so no training and no sample of the corpus is needed. Of several
    independent sets of centres a question meets ``probes`` cells each: a near row that
    one set parts from it stands beside it in another.
    """
    asked = _in_sets(queries.select("query_id", "embedding"), centres, probes)
    return _search(index, asked, _Form(None), k, _width(queries), block_bytes)


def write_cells(corpus: DataFrame, centres: list[DataFrame], path: str) -> None:
    """Corpus rows ``id, embedding`` as files by set of centres and cell, for ``top_k_cell_files``.

    Every row is stored once for each set, beside the rows of its cell, with all its cells.
    """
    placed = cell_index(corpus, centres).withColumnRenamed("cell", "_cells")
    rows = placed.select("id", "embedding", F.col("_cells").alias("cell"), F.posexplode("_cells").alias("set", "at"))
    named = rows.withColumn("at", F.substring_index("at", ":", -1))
    named.hint("rebalance", "set", "at").write.partitionBy("set", "at").parquet(path)


def top_k_cell_files(
    path: str,
    centres: list[DataFrame],
    queries: DataFrame,
    k: int = TOP_K,
    probes: int = 2,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """What ``top_k_cells`` finds, from the files of ``write_cells``: only those of cells that
    some question probes are read. A row that a question meets in several sets counts once.
    """
    spark = queries.sparkSession
    asked = stored(_in_sets(queries.select("query_id", "embedding"), centres, probes), "asked")
    probed = asked.select(F.explode("cells").alias("cell")).distinct().collect()  # no more than centres
    kind = asked.schema["embedding"].dataType.simpleString()
    rows = spark.read.schema(f"id string, embedding {kind}, cell array<string>, set int, at string").parquet(path)
    near = rows.where(F.concat_ws(":", "set", "at").isin(*(r.cell for r in probed))).drop("at")
    return _search(near, asked, _Form(None), k, _width(queries), block_bytes)
