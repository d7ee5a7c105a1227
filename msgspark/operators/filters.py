"""Row filters of the message pipeline; all of them are plain predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, is_set

# How automatic messages and direct-message channels are marked.
BOT_SUBTYPE = "bot_message"
DIRECT_PREFIX = "D"


def is_bot() -> Column:
    return is_set(F.col("bot_id")) | (F.coalesce(F.col("subtype"), F.lit("")) == BOT_SUBTYPE)


def is_direct() -> Column:
    return F.coalesce(F.col("channel"), F.lit("")).startswith(DIRECT_PREFIX)


def drop_blank(messages: DataFrame) -> DataFrame:
    """Keep rows whose text has something besides white space."""
    return messages.filter(~is_blank(F.col("text")))


def drop_bots(messages: DataFrame) -> DataFrame:
    """Drop rows written by bots; a null or empty ``bot_id`` keeps the row."""
    return messages.filter(~is_bot())


def drop_keyless(messages: DataFrame) -> DataFrame:
    """Drop rows without channel or timestamp."""
    return messages.filter(is_set(F.col("channel")) & is_set(F.col("ts")))


def rejected(messages: DataFrame) -> DataFrame:
    """Rows normalisation leaves out, with the first reason that applies."""
    reason = (
        F.when(is_bot(), "bot")
        .when(is_blank(F.col("text")), "blank")
        .when(~is_set(F.col("channel")) | ~is_set(F.col("ts")), "no key")
    )
    return messages.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def allowed_ids(allowed: str) -> list[str]:
    """Comma-separated channel ids, each trimmed; empty text means all channels."""
    return [part.strip() for part in allowed.split(",")] if allowed else []


def filter_allowed(messages: DataFrame, allowed: str | DataFrame = "") -> DataFrame:
    """Keep messages of the allowed channels.

    A text is compared by id only. A long list can be given as a frame with an
    ``id`` column and becomes a semi join.
    """
    if isinstance(allowed, DataFrame):
        ids = allowed.select(F.trim("id").alias("_allowed"))
        return messages.join(ids, messages["channel"] == ids["_allowed"], "left_semi")
    ids = allowed_ids(allowed)
    return messages.filter(F.col("channel").isin(ids)) if ids else messages


def route_messages(messages: DataFrame, realtime: bool = True) -> DataFrame:
    """Add ``route``: direct messages are questions, others go to the index if it is on."""
    other = "index" if realtime else "skip"
    return messages.withColumn("route", F.when(is_direct(), "question").otherwise(other))


def self_joined(events: DataFrame, bot_user: str) -> DataFrame:
    """Membership events of the bot itself."""
    return events.filter(F.col("user") == bot_user)
