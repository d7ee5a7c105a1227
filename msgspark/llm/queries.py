"""Queries of the corpus operators over the given tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language
from .decontaminate import contamination
from .exact_dedup import exact_duplicates
from .filter_audit import filter_audit
from .lexical_search import ranked_search
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .page_text import main_text
from .pieces import encode
from .quality import fit, with_quality
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .vector_forest import nearest
from .vocabulary import Vocabulary

#: The vocabulary of the token queries; any model file of that library will do.
VOCABULARY_PATH = "/opt/tokenizers/piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents")).select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(table(spark, folder, "documents")).select(
        "doc_id",
        "n_lines",
        "n_removed",
        "n_spans",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


@query
def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    )
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    model = language.fit(docs.where(part != 0))
    return language.identify(docs, model).select(
        "doc_id",
        F.coalesce(part == 0, F.lit(False)).alias("held_out"),
        F.col("lang").alias("lang_pred"),
        "score",
    )


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), Vocabulary.load(VOCABULARY_PATH))


@query
def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = Vocabulary.load(VOCABULARY_PATH)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    second = F.get("alternatives", F.lit(0))
    return encode(docs, vocabulary, keep=["doc_id"], verify=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        "score",
        (F.col("score") - second["score"]).alias("loss_of_second"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        "round_trip",
    )


def quality_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels to learn from; the others are held out."""
    return table(spark, folder, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


@query
def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit(docs, quality_labels(spark, folder))
    return with_quality(docs, model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages"))


@query
def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op12_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))
