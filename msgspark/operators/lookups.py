"""Lookups against the roster and the link table.

No join is forced to broadcast: Spark picks it from the size it knows or, under
adaptive execution, from the size it measures, and splits skewed keys otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_set


def with_channel_names(messages: DataFrame, roster: DataFrame) -> DataFrame:
    """Add ``channel_name``; an unknown channel keeps its id as name."""
    names = roster.groupBy(F.col("id").alias("_cid")).agg(F.min("name").alias("_name"))
    joined = messages.join(names, messages["channel"] == names["_cid"], "left")
    return joined.withColumn("channel_name", F.coalesce("_name", "channel")).drop("_cid", "_name")


def with_permalinks(messages: DataFrame, links: DataFrame) -> DataFrame:
    """Add ``permalink`` by channel and timestamp, ``''`` when there is none."""
    known = links.groupBy(F.col("channel").alias("_lc"), F.col("ts").alias("_lt")).agg(
        F.min("permalink").alias("_url")
    )
    on = (messages["channel"] == known["_lc"]) & (messages["ts"] == known["_lt"])
    joined = messages.join(known, on, "left")
    return joined.withColumn("permalink", F.coalesce("_url", F.lit(""))).drop("_lc", "_lt", "_url")


def resolve_channels(requests: DataFrame, roster: DataFrame) -> DataFrame:
    """Requested channel names (a leading ``#`` is ignored) to ids.

    Output: ``request, name, id, found``; ``id`` is null for a rejected request.
    """
    asked = requests.select(
        F.col("request"), F.regexp_replace("request", "^#+", "").alias("name")
    )
    ids = roster.groupBy(F.col("name").alias("_name")).agg(F.min("id").alias("id"))
    joined = asked.join(ids, asked["name"] == ids["_name"], "left").drop("_name")
    return joined.withColumn("found", F.col("id").isNotNull())


def indexed_channels(chunks: DataFrame) -> DataFrame:
    """Every channel that has at least one chunk in the index."""
    return chunks.filter(is_set(F.col("channel"))).select("channel").distinct()


def unindexed_channels(roster: DataFrame, chunks: DataFrame) -> DataFrame:
    """Joined channels without a single indexed chunk."""
    done = indexed_channels(chunks)
    return roster.join(done, roster["id"] == done["channel"], "left_anti")


def messages_of(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """Messages whose channel is in ``channels`` (column ``id``)."""
    return messages.join(channels, messages["channel"] == channels["id"], "left_semi")
