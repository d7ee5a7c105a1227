"""Exact dedup with DataFrame functions only: hash groups, a stable survivor, bytes compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: The white space that equality ignores.
SPACE = " \t\n\x0b\x0c\r"


def md5_bytes(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame, *, content_hash: Callable[[Column], Column] = md5_bytes
) -> DataFrame:
    """Group of every document: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after deleting the characters of ``SPACE``; null
    counts as empty. Of equal texts the row with the most code points in the original
    text stays, then the smallest doc_id; a null id comes after all others. Rows that
    repeat the survivor's id and length count as that row. Texts of any length are read
    whole, an empty table gives no rows. Other columns are ignored, also those that are
    named as the results.

    The least and the greatest text of a hash group are kept while it is aggregated,
    before the shuffle already, so copies meet as one row per task and the bytes of
    every member are compared. Only a group whose two texts differ (a collision of
    the 128-bit hash) is grouped once more by the text itself.
    """
    scratch = Scratch(docs.sparkSession)
    original = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.translate(original, SPACE, "").alias("norm"),
        (-F.char_length(original)).cast("long").alias("shortness"),
    ).withColumn("hash", content_hash(F.col("norm")))
    order = F.struct("shortness", F.isnull("doc_id").alias("none"), "doc_id")
    measures = [F.count("*").alias("group_size"), F.min(order).alias("best")]
    groups = scratch.write(
        rows.groupBy("hash")
        .agg(*measures, F.min("norm").alias("low"), F.max("norm").alias("high"))
        .select("hash", "group_size", "best", (F.col("low") != F.col("high")).alias("clash")),
        "groups",
    )
    clean = _members(rows, groups.where("not clash"), ["hash"])
    clashing = groups.where("clash").select("hash")
    if clashing.isEmpty():
        return clean
    apart = rows.join(clashing, "hash", "left_semi")
    return clean.union(_members(apart, apart.groupBy("hash", "norm").agg(*measures), ["hash", "norm"]))


def _members(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    if keys == ["hash"]:  # the hash stands for the text, which stays behind
        rows = rows.select("doc_id", "shortness", "hash", F.sha2("norm", 256).alias("text_sha256"))
    else:
        rows = rows.withColumn("text_sha256", F.sha2("norm", 256))
    return rows.join(groups, keys).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (
            F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
            & (F.col("shortness") == F.col("best.shortness"))
        ).alias("kept"),
        "text_sha256",
    )
