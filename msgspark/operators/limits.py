"""Per-key limits that survive a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def top_n_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int,
    salt_on: str,
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """First ``n`` rows per key in ``order``, numbered from 1 in column ``rank``.

    Two rounds: each key is first cut into ``salts`` parts by a hash of
    ``salt_on`` and limited there, so the task that ranks a hot key sees at most
    ``salts * n`` rows. ``order`` must be total for the result to be unique.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    near = salted.withColumn("_part_rank", F.row_number().over(part)).filter(
        F.col("_part_rank") <= n
    )
    whole = Window.partitionBy(*keys).orderBy(*order)
    ranked = near.drop("_salt", "_part_rank").withColumn(rank, F.row_number().over(whole))
    return ranked.filter(F.col(rank) <= n)


def newest_first(ts: str = "ts", key: str = "ts") -> list[Column]:
    """Newest message first; equal times by ``key``."""
    return [F.col(ts).try_cast("decimal(16,6)").desc_nulls_last(), F.col(key).asc()]


def cap_per_channel(messages: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """Newest ``limit`` messages of every channel."""
    capped = top_n_per_key(messages, ["channel"], newest_first("ts", key), limit, key, "_rank")
    return capped.drop("_rank")
