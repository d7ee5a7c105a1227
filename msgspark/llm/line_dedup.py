"""Line dedup with DataFrame functions only: repeated windows of consecutive lines go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

WINDOW = 3
_OUT = ("n_lines", "n_removed", "n_spans")


def dedup_lines(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Remove every line covered by a window of lines that also stands earlier.

    A window is ``window`` consecutive lines of one document (lines end at ``\\n``).
    Earlier means a smaller doc_id or the same document and an earlier line; a null
    id comes last, and texts that share an id are ordered by a hash of the text.
    Rows that repeat both id and text count as one document. Windows overlap: their
    lines are merged, so a run of repeated windows goes as one span. A document of
    fewer lines than a window has none and stays as it is; a null text stays null, an
    empty text is one empty line and an empty table gives no rows. The work for a very
    long text grows with its lines.

    Returns all columns of ``docs``, the text without removed lines, and n_lines,
    n_removed, n_spans, which replace input columns of these names.

    Only 128-bit window hashes are shuffled. A window found everywhere is counted
    before the shuffle, and its rows meet the first occurrence in a join that Spark
    can split. Texts move once, to meet their removed lines.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in _OUT])
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns(
        {"__id": F.col("doc_id").cast("long"), "__tag": F.xxhash64(text)}
    )
    lines = F.transform(F.split(text, "\n"), F.md5)
    count = F.size("lines")
    windows = (
        keyed.select("__id", "__tag", lines.alias("lines"))
        .where(count >= window)
        .select(
            "__id",
            "__tag",
            F.posexplode(
                F.transform(
                    F.sequence(F.lit(1), count - (window - 1)),
                    lambda i: F.unhex(
                        F.md5(F.concat(*[F.element_at("lines", i + k) for k in range(window)]))
                    ),
                )
            ).alias("pos", "hash"),
        )
    )
    place = F.struct(F.isnull("__id").alias("none"), "__id", "__tag", "pos")
    first = scratch.write(
        windows.groupBy("hash")
        .agg(F.count("*").alias("n"), F.min(place).alias("first"))
        .where("n > 1")
        .drop("n"),
        "windows",
    )
    hits = (
        windows.join(first, "hash")
        .where(place > F.col("first"))
        .groupBy("__id", "__tag")
        .agg(F.collect_set("pos").alias("__hits"))
    )
    covered = F.array_distinct(
        F.flatten(F.transform("__hits", lambda p: F.array(*[p + k for k in range(window)])))
    )
    hits = hits.select(
        F.col("__id").alias("__of"), F.col("__tag").alias("__as"), covered.alias("__covered")
    )
    met = keyed.join(
        hits,
        F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__tag") == F.col("__as")),
        "left",
    )
    gone = F.coalesce("__covered", F.array().cast("array<int>"))
    parts = F.split(text, "\n")

    def joined(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    # an array of one element binds the lines to a variable: they are split once, not once a line
    kept = F.get(F.transform(F.array(parts), joined), F.lit(0))
    return met.select(
        *[
            F.when(F.size(gone) == 0, F.col("text")).otherwise(kept).alias("text")
            if c == "text"
            else F.col(c)
            for c in docs.columns
        ],
        F.size(parts).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        F.size(F.array_except(gone, F.transform(gone, lambda c: c + 1))).cast("long").alias("n_spans"),
    )
