"""Composed jobs: messages to index, catch-up and backfill."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.chunks import CHUNK_SIZE, default_tokens
from ..operators import index
from ..operators.chunking import chunk_documents
from ..operators.lookups import messages_of, unindexed_channels
from ..operators.normalize import normalize_messages
from ..sources.messages import history_scan, recent_scan, roster_scan
from ..sources.commits import remove
from ..sources.storage import fresh_path

# Fixed value: overlap of the index jobs; the chunker itself defaults to none.
INDEX_OVERLAP = 100


def index_documents(
    messages: DataFrame,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = INDEX_OVERLAP,
    tokens: Callable[[Column], Column] = default_tokens,
) -> DataFrame:
    """Index rows of normalised messages."""
    return chunk_documents(messages, chunk_size, overlap, tokens=tokens)


def index_messages(
    raw: DataFrame,
    roster: DataFrame | None = None,
    links: DataFrame | None = None,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = INDEX_OVERLAP,
) -> DataFrame:
    """Index rows of raw message events."""
    return index_documents(normalize_messages(raw, roster, links), chunk_size, overlap)


def catchup_messages(
    raw: DataFrame,
    roster: DataFrame,
    cutoff: dt.datetime,
    limit: int | None = None,
    time_column: str | None = None,
) -> DataFrame:
    """Recent messages of the joined channels, all channels in one scan; no cap unless asked."""
    joined = roster_scan(roster, only_joined=True)
    return recent_scan(messages_of(raw, joined), cutoff, roster, limit, time_column)


def backfill_messages(
    raw: DataFrame,
    roster: DataFrame,
    indexed: DataFrame,
    links: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """History of the joined channels the index does not know yet; no cap unless asked."""
    new = unindexed_channels(roster_scan(roster, only_joined=True), indexed)
    return history_scan(messages_of(raw, new), roster, links, limit)


def write_chunks(
    rows: DataFrame, path: str, seq: int, writer: str = "batch", batch: int | None = None
) -> dict[str, int] | None:
    """Embed those chunks that the index lacks and commit all of them as one batch.

    The chunks are cut once and written aside; the buckets they fall into, noted on the
    way, are all that is read of the index. Returns what ``index.append`` counts.
    """
    spark = rows.sparkSession
    now = index.state(spark, path)
    if not now:
        return index.append(rows, path, seq, writer, batch)
    seen = Observation()
    touched = F.collect_set(index.bucket_of(now["buckets"]))
    aside = fresh_path(spark, "cut")
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), touched.alias("touched")).write.parquet(aside)
    try:
        cut = spark.read.schema(rows.schema).parquet(aside)
        known = index.current(spark, path, buckets=seen.get["touched"], count=now["buckets"])
        made = index.with_vectors(cut, known, few=seen.get["rows"] <= index.MOST_SENT)
        return index.append(made, path, seq, writer, batch)
    finally:
        remove(spark, aside)


def run_index(
    messages: DataFrame,
    path: str,
    seq: int,
    writer: str = "batch",
    chunk_size: int = CHUNK_SIZE,
    overlap: int = INDEX_OVERLAP,
) -> DataFrame:
    """Cut, embed and commit normalised messages to the index at ``path``.

    Only chunks whose id and text the index does not hold yet are embedded. Returns
    the metrics of the job: messages, chunks written, how many of them were embedded,
    and the chunks of the whole index afterwards. All but the last are counted while the
    job runs, the last reads ids of the buckets that are not merged yet.
    """
    spark = messages.sparkSession
    seen = Observation()
    counted = messages.observe(seen, F.count(F.lit(1)).alias("messages"))
    made = write_chunks(index_documents(counted, chunk_size, overlap), path, seq, writer)
    facts = {"messages": 0, "chunks": 0, "embedded": 0} if made is None else {**made, **seen.get}
    facts["index_chunks"] = index.count(spark, path)
    return spark.createDataFrame(list(facts.items()), "metric string, value bigint")
