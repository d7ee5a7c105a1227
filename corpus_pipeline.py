"""From raw documents to pieces: quality, lines, near copies, test items, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet
and read back as the docs of the next. All but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgspark.llm.decontaminate import contamination
from msgspark.llm.line_dedup import dedup_lines
from msgspark.llm.near_dedup import PERCENT, near_duplicates
from msgspark.llm.pieces import encode
from msgspark.llm.quality import fit, with_quality
from msgspark.llm.queries import VOCABULARY_PATH, quality_labels, table
from msgspark.llm.scratch import Scratch
from msgspark.llm.vocabulary import Vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the quality threshold go; the model learns from the labelled ones.

    Null and empty texts are scored as texts without words; where no two labels can be
    compared all documents stay. Repeated rows go or stay alike; no rows give no rows.
    """
    model = fit(docs, quality_labels(spark, sf_dir))
    return with_quality(docs, model, name="__score").where("__score >= 0.5").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows of three lines go; so do documents of which no line is left.

    n_chars is that of the remaining text. A null or empty text has one line and stays. Rows
    that repeat id and text count as one document; a null id comes last. No rows give no rows.
    """
    left = dedup_lines(docs).where("n_removed < n_lines")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast("long"))
    return left.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id.

    Near copies share ``percent`` of their five-word shingles. Below 85, 32 bands of 4 are
    used, which miss a pair at 80 with a probability of 5e-8.
    Rows that share an id (also null) are told apart by no column here: they stay together.
    Texts without words link with nothing and stay. No rows give no rows.
    """
    wider = {"bands": 32, "rows": 4} if percent < PERCENT else {}
    found = near_duplicates(docs, percent=percent, **wider)
    kept = found.where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; fewer hit words than the limit leave a document as it is.

    Null and empty texts have no words and stay, repeated rows go or stay alike.
    """
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, their score and number, the next best ones, and whether decoding gives the text back.

    A null or empty text has no pieces. Columns of documents with names of the results are replaced.
    """
    vocabulary = Vocabulary.load(VOCABULARY_PATH)
    encoded = encode(docs, vocabulary, verify=True)
    return encoded.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near_copies),
    ("benchmark decontamination", test_items),
    ("sentencepiece encoding and decoding", pieces),
]

#: The classifier, the sketches and the pieces are no SQL; tests hold run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; every stage but the last is written."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
