"""Message, roster and link sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import message_time
from ..operators.filters import drop_blank, drop_bots
from ..operators.limits import cap_per_channel
from ..operators.normalize import normalize_messages
from ..schemas import LINK, RAW_MESSAGE, ROSTER

#: Partition column of landed messages.
DAY = "landed_day"


def read_table(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    fmt: str = "parquet",
    spread_by: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Read files with a declared schema (Parquet may supply its own).

    ``spread_by`` names a column to repartition by, for a job that knows its files
    give too few splits; ``parts`` is the number of partitions then (the session's
    shuffle partitions if not given).
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if spread_by is not None:
        df = df.repartition(parts, spread_by) if parts else df.repartition(spread_by)
    return df


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, RAW_MESSAGE, fmt)


def read_roster(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, ROSTER, fmt)


def read_links(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, LINK, fmt)


def stream_messages(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RAW_MESSAGE,
    fmt: str = "parquet",
    files: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Live feed over a directory of files."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def land_messages(raw: DataFrame, path: str, time_column: str | None = None) -> None:
    """Write raw messages by the UTC day of their time, for scans of recent days.

    The days of ``raw`` replace those that are there, other days stay. The time is that of
    ``time_column``, else of ``ts``; messages without one stand in a day of their own. Only
    few rows of a day are needed to write it in one file: Spark splits a large day.
    """
    day = F.to_date(message_time(F.col("ts")) if time_column is None else F.col(time_column))
    days = raw.withColumn(DAY, day).hint("rebalance", DAY)
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def history_scan(
    raw: DataFrame,
    roster: DataFrame | None = None,
    links: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Channel history: drop blank texts, keep bots; ``limit`` caps every channel after that."""
    kept = drop_blank(raw)
    capped = cap_per_channel(kept, limit, "ts") if limit else kept
    return normalize_messages(capped, roster, links, bots=True, trim_text=False)


def recent_scan(
    raw: DataFrame,
    cutoff: dt.datetime,
    roster: DataFrame | None = None,
    limit: int | None = None,
    time_column: str | None = None,
) -> DataFrame:
    """Messages since ``cutoff`` without bots and blanks.

    ``limit`` caps the raw rows of every channel first, so dropped rows count too.

    Of messages landed by day only the days since the cutoff are read.

    With ``time_column`` the cutoff is a plain comparison that reaches the file
    scan; otherwise the time is taken from ``ts``. No permalink is looked up. A
    cutoff without time zone is UTC.
    """
    page = raw.filter(_since(raw, cutoff, time_column))
    if DAY in raw.columns:
        first = cutoff.astimezone(dt.timezone.utc) if cutoff.tzinfo else cutoff
        page = page.filter(F.col(DAY) >= F.lit(first.date())).drop(DAY)
    if limit:
        page = cap_per_channel(page, limit, "ts")
    return normalize_messages(drop_blank(drop_bots(page)), roster)


def _since(raw: DataFrame, cutoff: dt.datetime, time_column: str | None) -> Column:
    utc = cutoff.replace(tzinfo=cutoff.tzinfo or dt.timezone.utc)
    if time_column is None:
        return message_time(F.col("ts")) >= F.lit(utc)
    if isinstance(raw.schema[time_column].dataType, T.TimestampNTZType):
        plain = utc.astimezone(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
        return F.col(time_column) >= F.expr(f"timestamp_ntz '{plain}'")
    return F.col(time_column) >= F.lit(utc)


def roster_scan(roster: DataFrame, only_joined: bool = False) -> DataFrame:
    """Channels that are not archived, optionally only the joined ones."""
    rows = roster.filter(~F.coalesce("is_archived", F.lit(False))).select(
        "id",
        "name",
        F.coalesce("is_member", F.lit(False)).alias("is_member"),
        F.coalesce("num_members", F.lit(0)).alias("num_members"),
    )
    return rows.filter("is_member") if only_joined else rows
