"""Structured Streaming jobs: live indexing, backfill on join, questions and their answers.

A stream of index rows commits each micro-batch under its writer and batch number, so
several streams, batch jobs and edits share one index, the last commit wins whoever made
it, and a replayed batch takes its own place again. Chunks that the index holds already
are not embedded anew. The index is merged when read, so a stream needs no state and no
watermark; recovery is the checkpoint of the query. Questions are
answered batch by batch, or land in the native sink to be answered in bulk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..functions.chunks import CHUNK_SIZE
from ..operators.answers import MIN_SIMILARITY, answer_route
from ..operators.filters import (
    drop_blank,
    drop_bots,
    filter_allowed,
    is_direct,
    self_joined,
)
from ..operators.index import current
from ..operators.normalize import clean_questions
from ..operators.retrieval import TOP_K, top_k_text, with_chunk_fields
from ..plans.ingest import INDEX_OVERLAP, index_documents, index_messages, write_chunks
from ..sources.commits import remove
from ..sources.storage import fresh_path


def _started(writer: DataStreamWriter, checkpoint: str, available_now: bool, interval: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif interval:
        writer = writer.trigger(processingTime=interval)
    return writer.start()


def _index_batches(
    rows: DataFrame, path: str, checkpoint: str, seq: int, writer: str, available_now: bool,
    interval: str | None,
) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        write_chunks(batch, path, seq, writer, number)

    return _started(rows.writeStream.foreachBatch(write), checkpoint, available_now, interval)


def live_chunks(
    feed: DataFrame,
    roster: DataFrame | None = None,
    links: DataFrame | None = None,
    allowed: str | DataFrame = "",
    chunk_size: int = CHUNK_SIZE,
    overlap: int = INDEX_OVERLAP,
) -> DataFrame:
    """Index rows of the messages in a feed: not direct, not from bots, in an allowed channel."""
    wanted = filter_allowed(feed.filter(~is_direct()), allowed)
    return index_messages(wanted, roster, links, chunk_size, overlap)


def stream_index(
    feed: DataFrame,
    path: str,
    checkpoint: str,
    seq: int,
    roster: DataFrame | None = None,
    links: DataFrame | None = None,
    allowed: str | DataFrame = "",
    available_now: bool = False,
    interval: str | None = None,
    writer: str = "live",
) -> StreamingQuery:
    """Append every live message to the index log as it arrives; each stream is a writer of its own."""
    rows = live_chunks(feed, roster, links, allowed)
    return _index_batches(rows, path, checkpoint, seq, writer, available_now, interval)


def joined_history(events: DataFrame, history: DataFrame, bot_user: str) -> DataFrame:
    """Index rows of the history of every channel the bot joins (stream-static join).

    ``history`` holds normalised messages. A channel joined several times in one
    frame is read once; joined again later, it is written again with the same ids.
    """
    joined = self_joined(events, bot_user).select(F.col("channel").alias("_joined"))
    if not events.isStreaming:
        joined = joined.distinct()
    wanted = joined.join(history, joined["_joined"] == history["channel"]).drop("_joined")
    return index_documents(wanted)


def stream_backfill(
    events: DataFrame,
    history: DataFrame,
    bot_user: str,
    path: str,
    checkpoint: str,
    seq: int,
    available_now: bool = False,
    interval: str | None = None,
    writer: str = "backfill",
) -> StreamingQuery:
    """Append the history of a channel to the index log when the bot joins it."""

    def write(batch: DataFrame, number: int) -> None:
        write_chunks(joined_history(batch, history, bot_user), path, seq, writer, number)

    return _started(events.writeStream.foreachBatch(write), checkpoint, available_now, interval)


def live_questions(feed: DataFrame, mentions: bool = False) -> DataFrame:
    """Questions in a feed: ``query_id, text, reply_to, kind``.

    Direct messages by default; ``mentions=True`` reads a feed of mentions. A
    direct message without text is dropped, an empty mention is kept as
    ``'empty'`` so that the caller can ask for a question.
    """
    rows = feed if mentions else drop_blank(drop_bots(feed.filter(is_direct())))
    asked = clean_questions(rows)
    return asked.select(
        F.concat_ws("-", "channel", "ts").alias("query_id"),
        F.col("question").alias("text"),
        "reply_to",
        "kind",
    )


def stream_questions(
    feed: DataFrame,
    path: str,
    checkpoint: str,
    mentions: bool = False,
    available_now: bool = False,
    interval: str | None = None,
) -> StreamingQuery:
    """Land the questions of a feed; ``answer_landed`` answers them in bulk.

    Ranking hits needs the whole index per question, which an append stream
    cannot do; landing first keeps the stream native and the answers batched.
    """
    sink = live_questions(feed, mentions).writeStream.format("parquet").outputMode("append")
    return _started(sink.option("path", path), checkpoint, available_now, interval)


def _answers(asked: DataFrame, chunks: DataFrame, k: int, min_similarity: float) -> DataFrame:
    hits = with_chunk_fields(top_k_text(chunks, asked, k), chunks)
    routed = answer_route(asked, hits, min_similarity)
    return routed.join(asked.select("query_id", "reply_to"), "query_id")


def answer_landed(
    spark: SparkSession,
    path: str,
    chunks: DataFrame,
    answered: DataFrame | None = None,
    k: int = TOP_K,
    min_similarity: float = MIN_SIMILARITY,
) -> DataFrame:
    """Answers of the landed questions that are not in ``answered`` yet."""
    landed = spark.read.schema("query_id string, text string, reply_to string, kind string").parquet(path)
    todo = landed.filter(F.col("kind") == "question").dropDuplicates(["query_id"])
    if answered is not None:
        todo = todo.join(answered.select("query_id"), "query_id", "left_anti")
    return _answers(todo, chunks, k, min_similarity)


_ANSWER = "query_id string, status string, top_score double, message string, reply_to string, batch bigint"


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """What ``stream_answers`` has answered so far, with the batch of each answer."""
    spark.createDataFrame([], _ANSWER).drop("batch").write.mode("ignore").parquet(f"{path}/batch=-1")
    return spark.read.schema(_ANSWER).parquet(path)


def stream_answers(
    feed: DataFrame,
    index_path: str,
    path: str,
    checkpoint: str,
    mentions: bool = False,
    k: int = TOP_K,
    min_similarity: float = MIN_SIMILARITY,
    available_now: bool = False,
    interval: str | None = None,
) -> StreamingQuery:
    """Answer the questions of a feed as they come, against the index of that moment.

    Every micro-batch opens the last commit of the index, so what is indexed meanwhile
    reaches later batches. Its answers are the folder of its number: a batch that is run
    again replaces its own, and a question that an earlier batch answered is left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        aside = fresh_path(spark, "asked")
        asked = batch.filter(F.col("kind") == "question").dropDuplicates(["query_id"])
        earlier = read_answers(spark, path).filter(F.col("batch") < number).select("query_id")
        asked.join(earlier, "query_id", "left_anti").write.parquet(aside)
        todo = spark.read.schema(asked.schema).parquet(aside)
        made = _answers(todo, current(spark, index_path), k, min_similarity)
        made.write.mode("overwrite").parquet(f"{path}/batch={number}")
        remove(spark, aside)

    asked = live_questions(feed, mentions).writeStream.foreachBatch(write)
    return _started(asked, checkpoint, available_now, interval)


def write_answers(
    spark: SparkSession,
    path: str,
    answers_path: str,
    chunks: DataFrame,
    run: int,
    k: int = TOP_K,
    min_similarity: float = MIN_SIMILARITY,
) -> DataFrame:
    """Answer the landed questions that no earlier run answered and keep the answers.

    Run ``n`` writes the folder ``run=n`` and reads the runs before it, so a repeated
    run replaces its own answers. Returns all answers so far.
    """
    schema = "query_id string, status string, top_score double, message string, reply_to string, run int"
    spark.createDataFrame([], schema).drop("run").write.mode("ignore").parquet(f"{answers_path}/run=0")
    answers = spark.read.schema(schema).parquet(answers_path)
    new = answer_landed(spark, path, chunks, answers.filter(F.col("run") < run), k, min_similarity)
    new.write.mode("overwrite").parquet(f"{answers_path}/run={run}")
    return spark.read.schema(schema).parquet(answers_path)
