"""Raw message events to normalised messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_set, strip, strip_mentions
from .filters import drop_blank, drop_bots, drop_keyless
from .lookups import with_channel_names, with_permalinks

# Fixed value: author of a message without a user.
UNKNOWN_USER = "unknown"

MESSAGE_FIELDS = ["id", "channel", "channel_name", "text", "user", "ts", "permalink", "thread_ts"]


def message_id() -> Column:
    return F.concat_ws("-", "channel", "ts")


def normalize_messages(
    raw: DataFrame,
    roster: DataFrame | None = None,
    links: DataFrame | None = None,
    bots: bool = False,
    trim_text: bool = True,
) -> DataFrame:
    """Filter raw events, fill defaults and look up channel name and permalink.

    ``bots=True`` keeps bot messages and ``trim_text=False`` keeps the text as
    written; a history scan wants both.
    """
    kept = drop_keyless(drop_blank(raw if bots else drop_bots(raw)))
    base = kept.select(
        message_id().alias("id"),
        "channel",
        (strip(F.col("text")) if trim_text else F.col("text")).alias("text"),
        F.coalesce("user", F.lit(UNKNOWN_USER)).alias("user"),
        "ts",
        "thread_ts",
    )
    named = (
        with_channel_names(base, roster)
        if roster is not None
        else base.withColumn("channel_name", F.col("channel"))
    )
    linked = (
        with_permalinks(named, links)
        if links is not None
        else named.withColumn("permalink", F.lit(""))
    )
    return linked.select(*MESSAGE_FIELDS)


def thread_key() -> Column:
    """Where a reply goes: the thread, or the message itself; empty counts as missing."""
    return F.coalesce(F.when(is_set(F.col("thread_ts")), F.col("thread_ts")), F.col("ts"))


def clean_questions(raw: DataFrame) -> DataFrame:
    """Questions from mentions and direct messages.

    Adds ``question`` (mentions removed, trimmed), ``kind`` (``'empty'`` or
    ``'question'``) and ``reply_to``.
    """
    asked = raw.withColumn("question", strip_mentions(F.coalesce("text", F.lit(""))))
    return asked.withColumn(
        "kind", F.when(F.col("question") == "", "empty").otherwise("question")
    ).withColumn("reply_to", thread_key())
