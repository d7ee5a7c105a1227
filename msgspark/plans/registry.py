"""Named queries over the driver tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_mentions
from ..operators import answers, chunking, embedding, filters, index, limits, lookups
from ..operators import normalize, postings, reports, retrieval
from ..schemas import RAW_MESSAGE
from ..sources.messages import history_scan, land_messages, recent_scan, roster_scan, stream_messages
from ..sources.storage import fingerprint, fresh_path, stored, tidy
from ..streaming import jobs
from . import ingest
from .bindings import (
    BOT_USER,
    Tables,
    conversation_messages,
    membership_events,
    mention_messages,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CAP = 20  # per-channel cap of the two limit queries
DIM = 256  # buckets of the embedding queries


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(Tables(spark, folder))

    QUERIES[fn.__name__] = run
    return fn


# sources


@query
def history_scan_query(t: Tables) -> DataFrame:
    return history_scan(t.posts(), roster_scan(t.roster()))


@query
def recent_scan_query(t: Tables) -> DataFrame:
    return recent_scan(t.events(), t.events_cutoff(), time_column="event_time").drop("thread_ts")


@query
def recent_landed(t: Tables) -> DataFrame:
    """The recent window over events landed by day: days before it are not read."""
    path = fresh_path(t.spark, "landed")
    land_messages(t.events(), path, "event_time")
    landed = t.spark.read.parquet(path)
    return recent_scan(landed, t.events_cutoff(), time_column="event_time").drop("thread_ts")


@query
def roster_scan_query(t: Tables) -> DataFrame:
    return roster_scan(t.roster(), only_joined=True)


# filters


@query
def filter_nonblank(t: Tables) -> DataFrame:
    return filters.drop_blank(t.conversations()).select("channel", "ts", "text")


@query
def filter_bots(t: Tables) -> DataFrame:
    return filters.drop_bots(t.conversations()).select("channel", "ts", "user")


@query
def filter_keys(t: Tables) -> DataFrame:
    return filters.drop_keyless(t.conversations()).select("channel", "ts")


@query
def rejected_messages(t: Tables) -> DataFrame:
    gone = filters.rejected(t.conversations())
    return gone.groupBy("reason").agg(F.count("*").alias("messages"))


@query
def filter_allowlist(t: Tables) -> DataFrame:
    return filters.filter_allowed(t.events(), "error, click").select("channel", "ts")


@query
def route_messages(t: Tables) -> DataFrame:
    return filters.route_messages(t.conversations()).select("channel", "ts", "route")


@query
def filter_self_joined(t: Tables) -> DataFrame:
    return filters.self_joined(membership_events(t.table("nation")), BOT_USER)


# projections


@query
def normalize_messages(t: Tables) -> DataFrame:
    return normalize.normalize_messages(t.conversations())


@query
def strip_mentions_query(t: Tables) -> DataFrame:
    rows = mention_messages(t.table("conversations"))
    return rows.select("channel", "ts", strip_mentions(F.col("text")).alias("question"))


@query
def classify_questions(t: Tables) -> DataFrame:
    rows = normalize.clean_questions(mention_messages(t.table("conversations")))
    return rows.select("channel", "ts", "kind")


@query
def thread_key(t: Tables) -> DataFrame:
    return t.conversations().select("channel", "ts", normalize.thread_key().alias("reply_to"))


# joins


@query
def join_channel_names(t: Tables) -> DataFrame:
    named = lookups.with_channel_names(t.posts(), roster_scan(t.roster()))
    return named.select("channel", "ts", "channel_name")


@query
def join_permalinks(t: Tables) -> DataFrame:
    linked = lookups.with_permalinks(t.documents().drop("permalink"), t.links())
    return linked.select("id", "permalink")


@query
def resolve_channels(t: Tables) -> DataFrame:
    return lookups.resolve_channels(t.channel_requests(), t.roster())


@query
def unindexed_channels(t: Tables) -> DataFrame:
    joined = roster_scan(t.roster(), only_joined=True)
    return lookups.unindexed_channels(joined, t.known_posts()).select("id", "name")


@query
def backfill_messages(t: Tables) -> DataFrame:
    rows = ingest.backfill_messages(t.posts(), t.roster(), t.known_posts())
    return rows.select("id", "channel_name", "text")


# limits


@query
def cap_after_filter(t: Tables) -> DataFrame:
    kept = filters.drop_bots(filters.drop_blank(t.events()))
    return limits.cap_per_channel(kept, CAP, "ts").select("channel", "ts", "user")


@query
def cap_before_filter(t: Tables) -> DataFrame:
    page = limits.cap_per_channel(t.events(), CAP, "ts")
    return filters.drop_bots(filters.drop_blank(page)).select("channel", "ts", "user")


# chunking


@query
def protected_spans(t: Tables) -> DataFrame:
    return chunking.span_rows(t.bulleted())


@query
def merge_spans(t: Tables) -> DataFrame:
    """Unmerged spans of every kind, merged per message."""
    return chunking.merge_span_rows(chunking.span_rows(t.bulleted(), merged=False))


@query
def chunk_boundaries(t: Tables) -> DataFrame:
    return chunking.chunk_boundaries(t.documents())


@query
def chunk_overlap(t: Tables) -> DataFrame:
    return chunking.chunk_boundaries(t.documents(), overlap=ingest.INDEX_OVERLAP)


@query
def chunk_marked(t: Tables) -> DataFrame:
    return chunking.chunk_boundaries(t.marked())


@query
def chunk_bulleted(t: Tables) -> DataFrame:
    return chunking.chunk_documents(t.bulleted(), overlap=ingest.INDEX_OVERLAP).select("id", "text")


@query
def cjk_share(t: Tables) -> DataFrame:
    return chunking.script_share(t.mixed_script())


@query
def token_budget(t: Tables) -> DataFrame:
    """Budget of chunks that were cut without it, so that some are over."""
    cut = chunking.chunk_documents(t.mixed_script(), use_tokens=False)
    return chunking.token_budget(cut)


@query
def token_retry(t: Tables) -> DataFrame:
    return chunking.chunk_boundaries(t.mixed_script())


@query
def chunk_mixed(t: Tables) -> DataFrame:
    rows = chunking.chunk_documents(t.mixed_script(), overlap=ingest.INDEX_OVERLAP)
    return rows.select("id", "text")


@query
def merge_small_chunks(t: Tables) -> DataFrame:
    """Small chunk size and a large minimum, so that many chunks merge."""
    rows = chunking.chunk_documents(t.documents(), chunk_size=120, min_chunk=90, use_tokens=False)
    return rows.select("id", "text")


@query
def chunk_documents(t: Tables) -> DataFrame:
    return chunking.chunk_documents(t.documents())


# embedding and retrieval


def hash_model(texts: list[str]) -> np.ndarray:
    """Example of a user-supplied model: hashed term frequencies in numpy."""
    words = [re.findall(r"[^\W_]+", text.lower()) for text in texts]
    rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    buckets = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % DIM for w in words for x in w]
    out = np.zeros((len(texts), DIM))
    np.add.at(out, (rows, np.array(buckets, dtype=np.int64)), 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@query
def embed_batches(t: Tables) -> DataFrame:
    made = embedding.embed_batches(t.questions(), hash_model)
    rows = made.select("query_id", F.posexplode_outer("embedding").alias("bucket", "w"))
    return rows.filter(F.col("w") > 0).select(
        "query_id", "bucket", F.round(F.col("w").cast("double"), 4).alias("weight")
    )


@query
def hashed_embeddings(t: Tables) -> DataFrame:
    made = embedding.hashed_embeddings(t.documents().select("id", "text"), DIM)
    return embedding.vector_rows(made)


@query
def embed_missing(t: Tables) -> DataFrame:
    """Vectors of the English documents exist already, the rest is embedded."""
    docs = t.documents()

    def embed(df: DataFrame) -> DataFrame:
        return embedding.hashed_embeddings(df, DIM)

    english = docs.filter(F.col("user") == "en").withColumn("text_hash", F.md5("text"))
    existing = embed(english).select("id", "text_hash", "buckets", "weights")
    rows = embedding.embed_missing(docs.select("id", "text"), existing, embed, ["buckets", "weights"])
    return rows.select("id", "reused", vector_text().alias("vector"))


_BUILT: dict[tuple, str] = {}


def _built(t: Tables, name: str, tables: tuple[str, ...], build: Callable[[str], None]) -> str:
    """Where an index over tables of the folder is: built once an application, for the files as they are."""
    files = [fingerprint(t.spark, f"{t.folder}/{table}.parquet") for table in tables]
    key = (t.spark.sparkContext.applicationId, name, t.folder, *files)
    if key not in _BUILT:
        path = fresh_path(t.spark, name)
        build(path)
        _BUILT[key] = path
    return _BUILT[key]


@query
def topk_dense(t: Tables) -> DataFrame:
    """The questions are every row whose id is divisible by 50, here and below."""
    return retrieval.top_k(t.vectors(), t.row_questions())


@query
def topk_dense_blocks(t: Tables) -> DataFrame:
    """Four questions to a file, so that a task walks several files."""
    return retrieval.top_k(t.vectors(), t.row_questions(), block_bytes=4 * 64 * 8)


@query
def topk_dense_labels(t: Tables) -> DataFrame:
    """One question per label: the mean of its vectors."""
    return retrieval.top_k(t.vectors(), t.centroids())


@query
def topk_approx(t: Tables) -> DataFrame:
    """Six independent sets of cells as files by cell; a question probes five cells of each."""
    path = _built(t, "cells", ("embeddings",), lambda path: retrieval.write_cells(t.vectors(), t.row_centres(), path))
    return retrieval.top_k_cell_files(path, t.row_centres(), t.row_questions(), probes=5)


@query
def topk_dense_rows(t: Tables) -> DataFrame:
    return retrieval.top_k(t.vectors(), t.row_questions())


@query
def topk_approx_rows(t: Tables) -> DataFrame:
    """The same cells and probes over rows that carry their cells, all of which are read."""
    centres = [stored(c, "centres") for c in t.row_centres()]
    placed = stored(retrieval.cell_index(t.vectors(), centres), "cells")
    return retrieval.top_k_cells(placed, centres, t.row_questions(), probes=5)


def vector_text() -> Column:
    """A sparse vector as text: bucket:weight in millionths, by bucket."""
    pairs = F.arrays_zip("buckets", "weights")
    return F.array_join(
        F.transform(
            pairs,
            lambda p: F.concat(
                p["buckets"], F.lit(":"), F.round(p["weights"] * 1e6).cast("bigint").cast("string")
            ),
        ),
        " ",
    )


def text_index_path(t: Tables) -> str:
    """Index of all documents with permalinks and vectors."""

    def build(path: str) -> None:
        linked = lookups.with_permalinks(t.documents().drop("permalink"), t.links())
        index.append(ingest.index_documents(linked), path, 1)

    return _built(t, "index", ("documents", "pages"), build)


def text_index(t: Tables) -> DataFrame:
    return index.current(t.spark, text_index_path(t))


def text_hits(t: Tables) -> DataFrame:
    chunks = text_index(t)
    return retrieval.with_chunk_fields(retrieval.top_k_text(chunks, t.questions()), chunks)


@query
def topk_text(t: Tables) -> DataFrame:
    return retrieval.top_k_text(text_index(t), t.questions())


@query
def topk_text_postings(t: Tables) -> DataFrame:
    """The same from posting lists of the index."""
    path = _built(t, "postings", ("documents", "pages"), lambda path: postings.write_postings(text_index(t), path))
    return postings.top_k_text_postings(path, t.questions())


# answers


@query
def top_score(t: Tables) -> DataFrame:
    return answers.top_score(retrieval.top_k_text(text_index(t), t.questions()))


@query
def context_blocks(t: Tables) -> DataFrame:
    return answers.context_blocks(text_hits(t))


@query
def citations(t: Tables) -> DataFrame:
    return answers.citations(text_hits(t))


@query
def answer_route(t: Tables) -> DataFrame:
    """A threshold in the middle of the scores, so that both branches are taken."""
    return answers.answer_route(t.questions(), text_hits(t), min_similarity=0.4)


@query
def prompt_table(t: Tables) -> DataFrame:
    return answers.prompt_table(t.questions(), text_hits(t))


@query
def preview_results(t: Tables) -> DataFrame:
    return answers.preview_results(t.questions(), text_hits(t))


@query
def score_listing(t: Tables) -> DataFrame:
    return answers.score_listing(text_hits(t))


# index


def _updated(t: Tables) -> DataFrame:
    """Index of two writes: all documents, then the English ones cut without overlap."""
    path = fresh_path(t.spark, "log")
    docs = t.documents()
    index.append(ingest.index_documents(docs), path, 1)
    english = docs.filter(F.col("user") == "en")
    index.append(ingest.index_documents(english, overlap=0), path, 2)
    return index.current(t.spark, path)


@query
def index_upsert(t: Tables) -> DataFrame:
    return _updated(t).select("id", "text", "channel", "user")


@query
def index_upsert_batch(t: Tables) -> DataFrame:
    docs = t.documents()
    english = docs.filter(F.col("user") == "en")
    old = stored(ingest.index_documents(docs), "index")
    new = stored(ingest.index_documents(english, overlap=0), "update")
    return index.upsert(old, new).select("id", "text", "channel", "user")


@query
def index_replace(t: Tables) -> DataFrame:
    docs = t.documents()
    english = docs.filter(F.col("user") == "en")
    old = stored(ingest.index_documents(docs), "index")
    new = stored(ingest.index_documents(english, overlap=0), "update")
    return index.upsert(old, new, replace_document=True).select("id", "text", "channel", "user")


@query
def index_reset_count(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "log")
    index.append(ingest.index_documents(t.documents()), path, 1)
    before = index.read_log(t.spark, path).agg(F.count("*").alias("rows_before")).first()[0]
    index.reset(t.spark, path)
    after = index.size(index.current(t.spark, path))
    return after.select(F.lit(before).cast("bigint").alias("rows_before"), F.col("chunks").alias("rows_after"))


@query
def index_count(t: Tables) -> DataFrame:
    return index.size(_updated(t))


@query
def indexed_channels(t: Tables) -> DataFrame:
    return lookups.indexed_channels(ingest.index_documents(t.documents()))


@query
def index_documents(t: Tables) -> DataFrame:
    """Chunks with their vectors, as the index holds them."""
    made = index.with_vectors(ingest.index_documents(t.documents()))
    return made.select(*index.DATA, "text_hash", vector_text().alias("vector"))


@query
def index_job(t: Tables) -> DataFrame:
    """Metrics of a second job over all documents, of which the English ones are indexed."""
    path = fresh_path(t.spark, "index")
    docs = t.documents()
    ingest.run_index(docs.filter(F.col("user") == "en"), path, 1)
    return ingest.run_index(docs, path, 2)


@query
def index_compacted(t: Tables) -> DataFrame:
    """A compacted log and one more write on top."""
    path = fresh_path(t.spark, "index")
    docs = t.documents()
    index.append(ingest.index_documents(docs), path, 1)
    index.append(ingest.index_documents(docs.filter(F.col("user") == "fr"), overlap=0), path, 2)
    index.compact(t.spark, path)
    index.append(ingest.index_documents(docs.filter(F.col("user") == "en"), overlap=0), path, 3)
    return index.current(t.spark, path).select("id", "text", "channel", "user")


@query
def index_during_compaction(t: Tables) -> DataFrame:
    """What readers see while a compaction has written files but not committed, and a replay as well.

    The index has a base, a batch over it and a batch that came while the base was made.
    """
    path = fresh_path(t.spark, "index")
    docs = t.documents()
    index.append(ingest.index_documents(docs), path, 1)
    index.compact(t.spark, path)
    index.vacuum(t.spark, path)  # nobody holds the batch that was merged
    index.append(ingest.index_documents(docs.filter(F.col("user") == "fr"), overlap=0), path, 2)
    opened = index.current(t.spark, path)
    left = index.current(t.spark, path).limit(10)
    for folder in ("base=unfinished/_temporary/0", "base=unfinished/bucket=0", "batch=unfinished"):
        with tidy(t.spark):
            left.write.parquet(f"{path}/data/{folder}")
    index.compact(t.spark, path)  # a reader that opened the index before goes on
    opened = opened.filter(F.col("user") != "en")
    index.append(ingest.index_documents(docs.filter(F.col("user") == "en"), overlap=0), path, 3)
    later = index.current(t.spark, path).filter(F.col("user") == "en")
    return opened.unionByName(later).select("id", "text", "channel", "user")


@query
def index_messages(t: Tables) -> DataFrame:
    return ingest.index_messages(t.conversations())


# reports


@query
def ingest_summary(t: Tables) -> DataFrame:
    """A job over all documents, into an index that holds them."""
    docs = t.documents()
    return reports.ingest_summary(docs, ingest.index_documents(docs), text_index(t))


def strict_model(texts: list[str]) -> np.ndarray:
    """A user-supplied model that refuses some texts: fixed marks that the SQL knows as well."""
    if any(len(x) > MOST_CHARACTERS for x in texts):
        raise ValueError("text too long")
    if any(REFUSED in x for x in texts):
        raise ValueError("text refused")
    return hash_model(texts)


MOST_CHARACTERS = 590
REFUSED = "7 BUILDING"


@query
def embed_rejects(t: Tables) -> DataFrame:
    """Chunks of all documents that a model fails for; the others are embedded."""
    chunks = ingest.index_documents(t.documents()).select("id", "channel", "text")
    tried = stored(embedding.embed_or_reject(chunks, strict_model), "tried")
    failed = embedding.rejected(tried).select("id", "channel", "reason")
    made = embedding.embedded(tried).select("id", "channel", F.lit("embedded").alias("reason"))
    return failed.unionByName(made)


@query
def channel_outcomes(t: Tables) -> DataFrame:
    """All posts embedded by a model that fails for some: their channels failed, the others go on."""
    roster = t.roster()
    posts = normalize.normalize_messages(t.posts(), roster)
    tried = stored(embedding.embed_or_reject(ingest.index_documents(posts), strict_model), "tried")
    return reports.channel_outcomes(roster, posts, embedding.embedded(tried), embedding.rejected(tried))


@query
def membership_report(t: Tables) -> DataFrame:
    return reports.membership_report(roster_scan(t.roster()))


@query
def dry_run_listing(t: Tables) -> DataFrame:
    return reports.dry_run_listing(roster_scan(t.roster()))


def _event_roster(t: Tables) -> DataFrame:
    """One channel per event type; the bot is in all but one of them."""
    kinds = t.table("events").select(F.col("event_type").alias("id")).distinct()
    return kinds.select(
        "id",
        F.upper("id").alias("name"),
        (F.col("id") != "error").alias("is_member"),
        F.lit(None).cast("int").alias("num_members"),
        F.lit(False).alias("is_archived"),
    )


@query
def catchup_summary(t: Tables) -> DataFrame:
    roster = _event_roster(t)
    found = ingest.catchup_messages(t.events(), roster, t.events_cutoff(), time_column="event_time")
    found = stored(found, "recent")
    path = fresh_path(t.spark, "index")
    index.append(ingest.index_documents(t.documents()), path, 1)
    ingest.run_index(found, path, 2)
    return reports.catchup_summary(
        roster_scan(roster, only_joined=True),
        found,
        ingest.index_documents(found),
        index.current(t.spark, path),
    )


# incremental jobs


@query
def catchup_index(t: Tables) -> DataFrame:
    """The index that a catch-up job wrote."""
    path = fresh_path(t.spark, "index")
    found = ingest.catchup_messages(
        t.events(), _event_roster(t), t.events_cutoff(), time_column="event_time"
    )
    ingest.run_index(found, path, 1)
    return index.current(t.spark, path).select(*index.DATA)


@query
def backfill_index(t: Tables) -> DataFrame:
    """The index that a backfill job wrote."""
    path = fresh_path(t.spark, "index")
    ingest.run_index(ingest.backfill_messages(t.posts(), t.roster(), t.known_posts()), path, 1)
    return index.current(t.spark, path).select(*index.DATA)


@query
def stream_index(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "log")
    feed = conversation_messages(t.feed("conversations"))
    running = jobs.stream_index(feed, path, fresh_path(t.spark, "state"), 1, available_now=True)
    running.awaitTermination()
    return index.current(t.spark, path).select(*index.DATA)


def _run_live(t: Tables, feed: DataFrame, path: str, state: str, seq: int = 1, writer: str = "live") -> None:
    jobs.stream_index(feed, path, state, seq, available_now=True, writer=writer).awaitTermination()


def _edited(t: Tables, feed: DataFrame) -> DataFrame:
    """Turns of a feed as they read after an edit: even ones sort before the old text, odd ones after."""
    said = F.concat(F.when(F.col("turn") % 2 == 0, "  !edited ").otherwise("zzz edited "), F.col("text"))
    return conversation_messages(feed.withColumn("text", said))


@query
def stream_edit(t: Tables) -> DataFrame:
    """A stream that first brings all turns and then, in a later batch, an edit of each."""
    path, feed, state = (fresh_path(t.spark, n) for n in ("log", "feed", "state"))
    turns = t.table("conversations")
    for rows in (conversation_messages(turns), _edited(t, turns)):
        rows.select(*RAW_MESSAGE.fieldNames()).write.mode("append").parquet(feed)
        _run_live(t, stream_messages(t.spark, feed), path, state)
    return index.current(t.spark, path).select(*index.DATA)


@query
def stream_edit_after_batch(t: Tables) -> DataFrame:
    """A stream, then a batch job over the same turns, then their edits on the stream: the last write wins."""
    path, feed, state = (fresh_path(t.spark, n) for n in ("log", "feed", "state"))
    turns = t.table("conversations")
    for n, rows in enumerate((conversation_messages(turns), _edited(t, turns))):
        rows.select(*RAW_MESSAGE.fieldNames()).write.mode("append").parquet(feed)
        if n:
            index.append(jobs.live_chunks(conversation_messages(turns)), path, 2)
        _run_live(t, stream_messages(t.spark, feed), path, state)
    return index.current(t.spark, path).select(*index.DATA)


@query
def stream_replayed(t: Tables) -> DataFrame:
    """Counts of two streams over the same feed: the second embeds nothing and adds nothing."""
    path = fresh_path(t.spark, "log")
    feed = t.feed("conversations")
    for writer in ("first", "second"):
        _run_live(t, conversation_messages(feed), path, fresh_path(t.spark, "state"), writer=writer)
    held = index.size(index.current(t.spark, path)).select(F.col("chunks").alias("index_chunks"))
    done = index.batches(t.spark, path).select("writer", "messages", F.col("rows").alias("chunks"), "embedded")
    return done.join(F.broadcast(held))


@query
def stream_and_batch(t: Tables) -> DataFrame:
    """Two streams and a batch job write one index."""
    path = fresh_path(t.spark, "log")
    _run_live(t, conversation_messages(t.feed("conversations")), path, fresh_path(t.spark, "state"))
    index.append(ingest.index_documents(t.documents()), path, 2)
    history = history_scan(t.posts(), roster_scan(t.roster()))
    jobs.stream_backfill(
        membership_events(t.feed("nation")), history, BOT_USER, path, fresh_path(t.spark, "state"), 3,
        available_now=True,
    ).awaitTermination()
    return index.current(t.spark, path).select("id", "text", "channel")


@query
def reset_then_stream(t: Tables) -> DataFrame:
    """A stream goes on after a reset; what it wrote before is gone."""
    path, feed, state = (fresh_path(t.spark, n) for n in ("log", "feed", "state"))
    rows = conversation_messages(t.table("conversations")).select(*RAW_MESSAGE.fieldNames())
    for n, kept in enumerate((F.col("ts") == "0", F.col("ts") != "0")):
        rows.filter(kept).write.mode("append").parquet(feed)
        if n:
            index.reset(t.spark, path)
        _run_live(t, stream_messages(t.spark, feed), path, state)
    return index.current(t.spark, path).select(*index.DATA)


@query
def stream_backfill(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "log")
    events = membership_events(t.feed("nation"))
    history = history_scan(t.posts(), roster_scan(t.roster()))
    running = jobs.stream_backfill(
        events, history, BOT_USER, path, fresh_path(t.spark, "state"), 1, available_now=True
    )
    running.awaitTermination()
    return index.current(t.spark, path).select(*index.DATA)


@query
def stream_questions(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "questions")
    feed = conversation_messages(t.feed("conversations"))
    running = jobs.stream_questions(feed, path, fresh_path(t.spark, "state"), available_now=True)
    running.awaitTermination()
    answers = fresh_path(t.spark, "answers")
    for run in (1, 2):  # the second run finds every question answered
        made = jobs.write_answers(t.spark, path, answers, text_index(t), run, min_similarity=0.4)
    return made.drop("run")


@query
def stream_answers(t: Tables) -> DataFrame:
    """The same questions answered on the stream; a second start adds nothing."""
    path, state = fresh_path(t.spark, "answers"), fresh_path(t.spark, "state")
    for _ in range(2):
        feed = conversation_messages(t.feed("conversations"))
        running = jobs.stream_answers(
            feed, text_index_path(t), path, state, min_similarity=0.4, available_now=True
        )
        running.awaitTermination()
    return jobs.read_answers(t.spark, path).drop("batch")


@query
def stream_mentions(t: Tables) -> DataFrame:
    """Mentions of the bot as questions; a bare mention is landed as empty and not answered."""
    path = fresh_path(t.spark, "questions")
    feed = mention_messages(t.feed("conversations"))
    running = jobs.stream_questions(
        feed, path, fresh_path(t.spark, "state"), mentions=True, available_now=True
    )
    running.awaitTermination()
    made = jobs.write_answers(t.spark, path, fresh_path(t.spark, "answers"), text_index(t), 1, min_similarity=0.4)
    return made.drop("run")


# a few queries share a name with the operator they call
for _name in ("history_scan", "recent_scan", "roster_scan", "strip_mentions"):
    QUERIES[_name] = QUERIES.pop(f"{_name}_query")
