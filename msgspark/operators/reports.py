"""Reports over ingest jobs and the channel roster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest_summary(messages: DataFrame, chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Messages, chunks and longest chunk per channel; the row without channel is the total.

    ``chunks`` are those of the job, ``index_chunks`` counts the whole ``index`` after it
    by channel. Totals are summed from the channel rows, so each input is read once.
    """
    held = index.groupBy(F.col("channel").alias("_i")).agg(F.count("*").alias("_held"))
    said = messages.groupBy("channel").agg(F.count("*").alias("messages"))
    cut = chunks.groupBy(F.col("channel").alias("_c")).agg(
        F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest")
    )
    per = said.join(cut, said["channel"] == cut["_c"], "left")
    per = per.join(held, per["channel"] == held["_i"], "full_outer").select(
        F.coalesce("channel", "_i").alias("channel"),
        F.coalesce("messages", F.lit(0)).alias("messages"),
        F.coalesce("_held", F.lit(0)).alias("index_chunks"),
        F.coalesce("chunks", F.lit(0)).alias("chunks"),
        F.coalesce("longest", F.lit(0)).cast("bigint").alias("longest_chunk"),
    )
    return per.rollup("channel").agg(
        F.count("*").alias("channels"),
        F.sum("messages").alias("messages"),
        F.sum("chunks").alias("chunks"),
        F.max("longest_chunk").alias("longest_chunk"),
        F.sum("index_chunks").alias("index_chunks"),
    )


def channel_outcomes(
    roster: DataFrame, messages: DataFrame, chunks: DataFrame, failed: DataFrame | None = None
) -> DataFrame:
    """Outcome of every channel: indexed, no messages or failed; one failure stops no other.

    ``failed`` are rows with a channel that a job rejected, ``chunks`` those it indexed.
    """
    said = messages.groupBy(F.col("channel").alias("_m")).agg(F.count("*").alias("messages"))
    cut = chunks.groupBy(F.col("channel").alias("_k")).agg(F.count("*").alias("chunks"))
    rows = roster.join(said, roster["id"] == said["_m"], "left")
    rows = rows.join(cut, rows["id"] == cut["_k"], "left")
    broken = F.lit(False)
    if failed is not None:
        bad = failed.select(F.col("channel").alias("_f")).distinct()
        rows = rows.join(bad, rows["id"] == bad["_f"], "left")
        broken = F.col("_f").isNotNull()
    outcome = (
        F.when(broken, "failed")
        .when(F.coalesce("messages", F.lit(0)) == 0, "no messages")
        .otherwise("indexed")
    )
    return rows.select(
        F.col("id").alias("channel"),
        "name",
        F.coalesce("messages", F.lit(0)).alias("messages"),
        F.coalesce("chunks", F.lit(0)).alias("chunks"),
        outcome.alias("outcome"),
    )


def membership_report(roster: DataFrame) -> DataFrame:
    """One row per channel with its state and how many channels share that state."""
    state = F.when(F.coalesce("is_member", F.lit(False)), "joined").otherwise("not joined")
    rows = roster.select("id", "name", state.alias("state"))
    counts = rows.groupBy("state").agg(F.count("*").alias("channels_in_state"))
    return rows.join(counts, "state").select("state", "channels_in_state", "id", "name")


def dry_run_listing(roster: DataFrame) -> DataFrame:
    """What an ingest of these channels would visit."""
    state = F.when(F.col("is_member"), "joined").otherwise("not joined")
    line = F.format_string("#%s (%s) - %d members [%s]", "name", "id", "num_members", state)
    return roster.select("id", line.alias("line"))


def catchup_summary(
    roster: DataFrame, messages: DataFrame, chunks: DataFrame, index: DataFrame
) -> DataFrame:
    """Channels checked, messages found, chunks written by a catch-up, and chunks of the whole index."""
    held = index.agg(F.count("*").alias("chunks"))
    checked = roster.agg(F.count("*").alias("channels"))
    found = messages.agg(F.count("*").alias("messages"))
    cut = chunks.agg(F.count("*").alias("chunks"))
    parts = [
        checked.select(F.lit("channels").alias("metric"), F.col("channels").alias("value")),
        found.select(F.lit("messages").alias("metric"), F.col("messages").alias("value")),
        cut.select(F.lit("chunks").alias("metric"), F.col("chunks").alias("value")),
        held.select(F.lit("index_chunks").alias("metric"), F.col("chunks").alias("value")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
