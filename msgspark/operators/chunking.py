"""Messages to chunk rows.

The work per message is one fold, so the job is a plain map over the scan: no
shuffle, whatever the number of channels or the size of one channel. Python workers
fold texts of ordinary length, longer ones and those with another token count are
folded natively, with the same chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import (
    CHUNK_SIZE,
    MIN_CHUNK,
    chunk_pieces,
    cut_pieces,
    cut_texts,
    default_tokens,
    is_sent,
    merge_small,
    token_limit,
)
from ..functions.spans import find_spans, merge_spans, protected_spans
from ..functions.text import cjk_share, is_blank, strip

CHUNK_FIELDS = ["channel", "channel_name", "user", "ts", "permalink"]


_ASIDE = ("_clean", "_spans", "_sent", "_folded")


def _cleaned(
    df: DataFrame, text: str, chunk_size: int, overlap: int, use_tokens: bool, tokens: Callable[[Column], Column]
) -> tuple[DataFrame, Column]:
    """Non-blank rows with their stripped text, and how it is folded; with the default tokens
    also with the spans of long texts and whether a Python worker cuts it instead."""
    rows = df.filter(~is_blank(F.col(text))).withColumn("_clean", strip(F.col(text)))
    clean = F.col("_clean")
    if tokens is not default_tokens:
        return rows, chunk_pieces("_clean", chunk_size, overlap, use_tokens, tokens)
    long = F.length(clean) > int(chunk_size)
    rows = rows.withColumns({"_spans": F.when(long, protected_spans(clean)), "_sent": is_sent(clean, chunk_size)})
    return rows, F.when(~F.col("_sent"), chunk_pieces("_clean", chunk_size, overlap, use_tokens, tokens, "_spans"))


def _either(sent: Column, folded: Column) -> Column:
    return F.when(F.col("_sent"), sent).otherwise(folded)


def with_pieces(
    df: DataFrame,
    text: str = "text",
    out: str = "pieces",
    chunk_size: int = CHUNK_SIZE,
    overlap: int = 0,
    use_tokens: bool = True,
    tokens: Callable[[Column], Column] = default_tokens,
) -> DataFrame:
    """Add the unmerged chunk slices of every non-blank text; blank rows are left out."""
    sent = cut_pieces(F.col("_clean"), F.col("_spans"), F.col("_sent"), chunk_size, overlap, use_tokens)
    rows, folded = _cleaned(df, text, chunk_size, overlap, use_tokens, tokens)
    return rows.withColumn(out, folded if tokens is not default_tokens else _either(sent, folded)).drop(*_ASIDE)


def with_chunks(
    df: DataFrame,
    text: str = "text",
    out: str = "chunks",
    chunk_size: int = CHUNK_SIZE,
    overlap: int = 0,
    use_tokens: bool = True,
    min_chunk: int = MIN_CHUNK,
    tokens: Callable[[Column], Column] = default_tokens,
) -> DataFrame:
    """Add the final chunk texts of every non-blank text as ``array<string>``."""
    sent = cut_texts(F.col("_clean"), F.col("_spans"), F.col("_sent"), chunk_size, overlap, use_tokens, min_chunk)
    rows, folded = _cleaned(df, text, chunk_size, overlap, use_tokens, tokens)
    texts = rows.withColumn("_folded", F.transform(folded, lambda p: p["text"]))
    folded = merge_small(F.col("_folded"), chunk_size, min_chunk) if min_chunk > 0 else F.col("_folded")
    return texts.withColumn(out, folded if tokens is not default_tokens else _either(sent, folded)).drop(*_ASIDE)


def chunk_documents(
    messages: DataFrame,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = 0,
    use_tokens: bool = True,
    min_chunk: int = MIN_CHUNK,
    tokens: Callable[[Column], Column] = default_tokens,
) -> DataFrame:
    """Normalised messages to chunk rows ``id, text, <fields>, chunk_index``.

    Missing metadata fields become ``''``; the thread key is not carried over.
    """
    fields = [
        (F.coalesce(F.col(c), F.lit("")) if c in messages.columns else F.lit("")).alias(c)
        for c in CHUNK_FIELDS
    ]
    source = messages.select(F.col("id").alias("_doc"), F.col("text"), *fields)
    cut = with_chunks(
        source, "text", "_chunks", chunk_size, overlap, use_tokens, min_chunk, tokens
    ).drop("text")
    # The outer form keeps Catalyst from copying the fold into a size(..) > 0 filter;
    # blank texts are gone already, so it yields the same rows as the inner form.
    rows = cut.select("_doc", *CHUNK_FIELDS, F.posexplode_outer("_chunks").alias("chunk_index", "text"))
    return rows.select(
        F.concat(F.col("_doc"), F.lit("-chunk-"), F.col("chunk_index")).alias("id"),
        "text",
        *CHUNK_FIELDS,
        "chunk_index",
    )


def chunk_boundaries(
    messages: DataFrame,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = 0,
    use_tokens: bool = True,
    tokens: Callable[[Column], Column] = default_tokens,
) -> DataFrame:
    """One row per unmerged slice: ``id, piece_index, start_pos, end_pos``."""
    cut = with_pieces(
        messages.select("id", "text"), "text", "_pieces", chunk_size, overlap, use_tokens, tokens
    )
    rows = cut.select("id", F.posexplode_outer("_pieces").alias("piece_index", "_p"))
    return rows.select(
        "id", "piece_index", F.col("_p.s").alias("start_pos"), F.col("_p.e").alias("end_pos")
    )


def span_rows(messages: DataFrame, merged: bool = True) -> DataFrame:
    """Protected spans as rows ``id, span_index, start_pos, end_pos``."""
    clean = messages.filter(~is_blank(F.col("text"))).select("id", strip(F.col("text")).alias("_t"))
    if merged:
        found = clean.select("id", protected_spans(F.col("_t")).alias("_s"))
    else:
        found = clean.select("id", find_spans(F.col("_t")).alias("_s"))
    rows = found.select("id", F.posexplode_outer("_s").alias("span_index", "_p"))
    return rows.filter(F.col("span_index").isNotNull()).select(
        "id", "span_index", F.col("_p.s").alias("start_pos"), F.col("_p.e").alias("end_pos")
    )


def merge_span_rows(spans: DataFrame) -> DataFrame:
    """Merge span rows ``id, start_pos, end_pos`` per message where they overlap or touch.

    The spans of one message are bounded by its own text, so they fit in one row.
    """
    pair = F.struct(F.col("start_pos").cast("int").alias("s"), F.col("end_pos").cast("int").alias("e"))
    listed = spans.groupBy("id").agg(F.sort_array(F.collect_list(pair)).alias("_all"))
    merged = listed.select("id", merge_spans(F.col("_all")).alias("_m"))
    rows = merged.select("id", F.posexplode_outer("_m").alias("span_index", "_p"))
    return rows.select(
        "id", "span_index", F.col("_p.s").alias("start_pos"), F.col("_p.e").alias("end_pos")
    )


def script_share(messages: DataFrame) -> DataFrame:
    """CJK share of every text and whether it counts as CJK-heavy."""
    share = cjk_share(F.col("text"))
    return messages.select(
        "id", F.round(share, 6).alias("cjk_share"), (share > 0.3).alias("cjk_heavy")
    )


def token_budget(
    chunks: DataFrame,
    chunk_size: int = CHUNK_SIZE,
    tokens: Callable[[Column], Column] = default_tokens,
) -> DataFrame:
    """Token count, limit and overrun flag per chunk."""
    counted = chunks.select(
        "id",
        tokens(F.col("text")).cast("bigint").alias("tokens"),
        token_limit(F.col("text"), chunk_size).cast("bigint").alias("token_limit"),
    )
    return counted.withColumn("over_budget", F.col("tokens") > F.col("token_limit"))
