"""The driver tables seen as messages, roster, links, vectors and questions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.messages import read_table

BOT_USER = "UBOT"
# Session setting: partitions to deal the documents out to, for a table that is one
# file of one row group. Unset, the files' own splits are used.
SPREAD = "msgspark.documents.partitions"
# Pieces of the composed texts.
LINK = "https://pages.example.org/item?id="
CJK = "漢字の文章です、"


class Tables:
    """Lazy access to the tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet")

    def texts(self) -> DataFrame:
        parts = self.spark.conf.get(SPREAD, None)
        path = f"{self.folder}/documents.parquet"
        if parts:
            return read_table(self.spark, path, spread_by="doc_id", parts=int(parts))
        return read_table(self.spark, path)

    def feed(self, name: str) -> DataFrame:
        """The same table as a stream of files."""
        schema = self.table(name).schema
        reader = self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
        return reader.parquet(self.folder)

    # raw messages

    def conversations(self) -> DataFrame:
        return conversation_messages(self.table("conversations"))

    def events(self) -> DataFrame:
        us = F.expr(
            "timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', cast(ts AS timestamp_ntz))"
        )
        ts = F.format_string("%d.%06d", F.expr("_us div 1000000"), F.expr("_us % 1000000"))
        return self.table("events").withColumn("_us", us).select(
            F.col("event_type").alias("channel"),
            ts.alias("ts"),
            F.col("user_id").cast("string").alias("user"),
            F.col("props").alias("text"),
            F.when(F.col("value") < 5, "B1").alias("bot_id"),
            F.lit(None).cast("string").alias("subtype"),
            F.lit(None).cast("string").alias("thread_ts"),
            F.col("ts").alias("event_time"),
        )

    def events_cutoff(self, hours: int = 24) -> dt.datetime:
        last = self.table("events").agg(F.max("ts")).first()[0]
        return last - dt.timedelta(hours=hours)

    def posts(self) -> DataFrame:
        none = F.lit(None).cast("string")
        return self.table("customer").select(
            F.col("c_nationkey").cast("string").alias("channel"),
            F.col("c_custkey").cast("string").alias("ts"),
            F.col("c_mktsegment").alias("user"),
            F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"),
            none.alias("bot_id"),
            none.alias("subtype"),
            none.alias("thread_ts"),
        )

    # normalised messages

    def documents(self) -> DataFrame:
        return document_messages(self.texts())

    def marked(self) -> DataFrame:
        """Every document with a link in the middle of the text."""
        url = F.concat(F.lit(LINK), "doc_id")
        text = F.concat("text", F.lit(" see "), url, F.lit(" "), "text")
        return document_messages(self.texts().withColumn("text", text))

    def bulleted(self) -> DataFrame:
        """Every document between two list lines; code, a link and fenced code around it."""
        url = F.concat(F.lit(LINK), "doc_id")
        fenced = F.concat(F.lit("\n```\nrun "), url, F.lit("\n```\n"))
        text = F.concat(
            F.lit("- see `"), url, F.lit("` or "), url, F.lit("\n"), "text", fenced, F.lit("1. done")
        )
        return document_messages(self.texts().withColumn("text", text))

    def mixed_script(self) -> DataFrame:
        """Every document with CJK sentences in it: few in some, over a third in others."""
        said = F.concat(F.lit("。"), F.repeat(F.lit(CJK), F.pmod("doc_id", F.lit(8)).cast("int")))
        text = F.regexp_replace("text", r"\. ", F.concat(F.lit(". "), said, F.lit(" ")))
        return document_messages(self.texts().withColumn("text", text))

    # dimensions

    def roster(self) -> DataFrame:
        members = self.table("customer").groupBy("c_nationkey").agg(
            F.count("*").cast("int").alias("num_members")
        )
        nation = self.table("nation")
        joined = nation.join(members, nation["n_nationkey"] == members["c_nationkey"], "left")
        return joined.select(
            F.col("n_nationkey").cast("string").alias("id"),
            F.col("n_name").alias("name"),
            (F.col("n_regionkey") != 0).alias("is_member"),
            "num_members",
            (F.col("n_regionkey") == 4).alias("is_archived"),
        )

    def links(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "source")
        pages = self.table("pages")
        return pages.join(docs, pages["page_id"] == docs["doc_id"]).select(
            F.col("source").alias("channel"),
            F.col("page_id").cast("string").alias("ts"),
            F.col("url").alias("permalink"),
        )

    def channel_requests(self) -> DataFrame:
        nations = self.table("nation").select(F.concat(F.lit("#"), "n_name").alias("request"))
        regions = self.table("region").select(F.concat(F.lit("##"), "r_name").alias("request"))
        return nations.unionByName(regions)

    def known_posts(self) -> DataFrame:
        """Posts of the channels of one region: those count as indexed already."""
        known = self.table("nation").filter("n_regionkey = 1").select(
            F.col("n_nationkey").cast("string").alias("id")
        )
        posts = self.posts()
        return posts.join(known, posts["channel"] == known["id"], "left_semi")

    # vectors and questions

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")

    def centroids(self) -> DataFrame:
        """One question per label: the mean of its vectors."""
        rows = self.table("embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
        means = rows.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("mean"))
        listed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("at", "mean"))).alias("_m"))
        return listed.select(
            F.col("label").cast("bigint").alias("query_id"), F.col("_m.mean").alias("embedding")
        )

    def row_questions(self) -> DataFrame:
        """Every row whose id is divisible by 50 as a question."""
        return self.table("embeddings").where("vec_id % 50 = 0").select(
            F.col("vec_id").cast("bigint").alias("query_id"), "embedding"
        )

    def row_centres(self) -> list[DataFrame]:
        """Six sets of 49 rows that are no questions, as centres of cells."""
        rows = self.table("embeddings").where("vec_id % 50 <> 0")
        return [
            rows.where(F.floor(F.col("vec_id") / 50) == n).select(F.col("vec_id").cast("string").alias("id"), "embedding")
            for n in range(6)
        ]

    def questions(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), "text")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    kind = F.when(F.col("conv_id") % 5 == 0, "D").otherwise("C")
    return conversations.select(
        F.concat(kind, F.col("conv_id")).alias("channel"),
        F.col("turn").cast("string").alias("ts"),
        F.when(F.col("role") != "system", F.col("role")).alias("user"),
        "text",
        F.when(F.col("role") == "assistant", "B1").alias("bot_id"),
        F.lit(None).cast("string").alias("subtype"),
        F.when(F.col("turn") > 0, "0").alias("thread_ts"),
    )


def mention_messages(conversations: DataFrame) -> DataFrame:
    """Conversation turns as mentions of a bot; a system turn is a bare mention."""
    said = F.when(F.col("role") == "system", "").otherwise(F.col("text"))
    text = F.concat(F.lit("<@U"), F.col("conv_id"), F.lit("> "), said)
    return conversation_messages(conversations.withColumn("text", text))


def document_messages(documents: DataFrame) -> DataFrame:
    ts = F.col("doc_id").cast("string")
    return documents.select(
        F.concat_ws("-", "source", ts).alias("id"),
        F.col("source").alias("channel"),
        F.col("source").alias("channel_name"),
        "text",
        F.col("lang").alias("user"),
        ts.alias("ts"),
        F.lit("").alias("permalink"),
    )


def membership_events(nations: DataFrame) -> DataFrame:
    """The bot joins the channels of one region, users join the others."""
    key = F.col("n_nationkey").cast("string")
    return nations.select(
        F.when(F.col("n_regionkey") == 2, BOT_USER).otherwise(F.concat(F.lit("U"), key)).alias("user"),
        key.alias("channel"),
        key.alias("ts"),
    )
