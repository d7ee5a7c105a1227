"""Answer assembly: hits in, one row per question out.

A question has at most k hits, so gathering them in one row is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_set

MIN_SIMILARITY = 0.25
LOW_CONFIDENCE_SOURCES = 3
PREVIEW = 200

# The messages and the prompt of an answer. ``{place}`` names the
# message platform in the prompt.
NO_HITS = "I couldn't find any relevant information in the indexed messages for this channel."
LOW_CONFIDENCE = (
    "I couldn't find enough relevant information in this channel's indexed messages "
    "to answer that confidently."
)
LOW_SOURCES = "\n\nSources (possibly related but low confidence):\n"
SOURCES = "\n\nSources:\n"
NO_RESULTS = "No results found."
PROMPT_HEAD = (
    "You are a helpful assistant answering questions using only the provided context "
    "from {place} messages.\n\n"
    "Rules:\n"
    "- Answer based ONLY on the context below\n"
    "- If the answer isn't in the context, say \"I couldn't find that information in the "
    'channel history."\n'
    "- Be concise and direct\n"
    "- DO NOT fabricate or make assumptions beyond the provided context\n\n"
    "Question:\n"
)
PROMPT_CONTEXT = "\n\nContext:\n"
PLACE = "chat"


def _in_order(*fields: Column) -> Column:
    return F.sort_array(F.collect_list(F.struct("rank", *fields)))


def _bullets(urls: Column) -> Column:
    return F.array_join(F.transform(urls, lambda u: F.concat(F.lit("- "), u)), "\n")


def top_score(hits: DataFrame) -> DataFrame:
    """Best score per question."""
    return hits.groupBy("query_id").agg(F.max("score").alias("top_score"))


def _context_line() -> Column:
    number = F.concat(F.lit("["), F.col("rank"), F.lit("] "))
    place = F.when(
        is_set(F.col("channel_name")), F.concat(F.lit("(from #"), F.col("channel_name"), F.lit(") "))
    ).otherwise("")
    return F.concat(number, place, F.col("text"))


def context_blocks(hits: DataFrame) -> DataFrame:
    """Numbered context text per question, in rank order."""
    lines = hits.groupBy("query_id").agg(_in_order(_context_line().alias("line")).alias("_l"))
    return lines.select("query_id", F.array_join("_l.line", "\n\n").alias("context"))


def citations(hits: DataFrame) -> DataFrame:
    """Source block per question: distinct sorted permalinks, ``''`` if there are none."""
    urls = hits.groupBy("query_id").agg(
        F.sort_array(F.collect_set(F.when(is_set(F.col("permalink")), F.col("permalink")))).alias("_u")
    )
    block = F.when(F.size("_u") > 0, F.concat(F.lit(SOURCES), _bullets(F.col("_u")))).otherwise("")
    return urls.select("query_id", block.alias("citations"))


def _low_message(hits: Column) -> Column:
    first = F.filter(hits, lambda h: h["rank"] <= LOW_CONFIDENCE_SOURCES)
    urls = F.filter(F.transform(first, lambda h: h["permalink"]), lambda u: is_set(u))
    tail = F.when(F.size(urls) > 0, F.concat(F.lit(LOW_SOURCES), _bullets(urls))).otherwise("")
    return F.concat(F.lit(LOW_CONFIDENCE), tail)


def answer_route(
    questions: DataFrame, hits: DataFrame, min_similarity: float = MIN_SIMILARITY
) -> DataFrame:
    """Confidence gate: ``query_id, status, top_score, message``.

    ``no_hits`` and ``low_confidence`` questions get their message; an
    ``answerable`` one has a null message. Only the best score is tested.
    """
    found = hits.groupBy("query_id").agg(
        F.max("score").alias("top_score"), _in_order(F.col("permalink")).alias("_h")
    )
    joined = questions.select("query_id").join(found, "query_id", "left")
    status = (
        F.when(F.col("top_score").isNull(), "no_hits")
        .when(F.col("top_score") < min_similarity, "low_confidence")
        .otherwise("answerable")
    )
    message = F.when(F.col("status") == "no_hits", NO_HITS).when(
        F.col("status") == "low_confidence", _low_message(F.col("_h"))
    )
    return joined.withColumn("status", status).select(
        "query_id", "status", "top_score", message.alias("message")
    )


def prompt_table(
    questions: DataFrame,
    hits: DataFrame,
    min_similarity: float = MIN_SIMILARITY,
    place: str = PLACE,
) -> DataFrame:
    """Prompts of the answerable questions: ``query_id, prompt, citations``."""
    found = hits.groupBy("query_id").agg(
        F.max("score").alias("_top"),
        _in_order(_context_line().alias("line")).alias("_l"),
        F.sort_array(F.collect_set(F.when(is_set(F.col("permalink")), F.col("permalink")))).alias("_u"),
    )
    ready = questions.select("query_id", "text").join(
        found.filter(F.col("_top") >= min_similarity), "query_id"
    )
    prompt = F.concat(
        F.lit(PROMPT_HEAD.format(place=place)),
        F.col("text"),
        F.lit(PROMPT_CONTEXT),
        F.array_join("_l.line", "\n\n"),
    )
    block = F.when(F.size("_u") > 0, F.concat(F.lit(SOURCES), _bullets(F.col("_u")))).otherwise("")
    return ready.select("query_id", prompt.alias("prompt"), block.alias("citations"))


def _four(score: Column) -> Column:
    return F.format_string("%.4f", score)


def preview_results(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Readable result list per question."""
    lines = F.concat(
        F.col("rank"),
        F.lit(". "),
        F.substring("text", 1, PREVIEW),
        F.lit("...\n"),
        F.when(
            is_set(F.col("permalink")), F.concat(F.lit("   Source: "), F.col("permalink"), F.lit("\n"))
        ).otherwise(""),
        F.lit("   Similarity: "),
        _four(F.col("score")),
        F.lit("\n"),
    )
    listed = hits.groupBy("query_id").agg(_in_order(lines.alias("line")).alias("_l"))
    joined = questions.select("query_id").join(listed, "query_id", "left")
    return joined.select(
        "query_id", F.coalesce(F.array_join("_l.line", "\n"), F.lit(NO_RESULTS)).alias("preview")
    )


def score_listing(hits: DataFrame) -> DataFrame:
    """Debug view: one line per hit in rank order."""
    line = F.concat(
        F.lit("  ["),
        F.col("rank"),
        F.lit("] score="),
        _four(F.col("score")),
        F.lit(" - "),
        F.col("permalink"),
    )
    listed = hits.groupBy("query_id").agg(_in_order(line.alias("line")).alias("_l"))
    return listed.select("query_id", F.array_join("_l.line", "\n").alias("scores"))
