"""Row schemas of the message pipeline."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType(), True) for n in names]


RAW_MESSAGE = T.StructType(
    _strings("channel", "ts", "user", "text", "bot_id", "subtype", "thread_ts")
)
MEMBERSHIP_EVENT = T.StructType(_strings("user", "channel", "ts"))
ROSTER = T.StructType(
    _strings("id", "name")
    + [
        T.StructField("is_member", T.BooleanType(), True),
        T.StructField("num_members", T.IntegerType(), True),
        T.StructField("is_archived", T.BooleanType(), True),
    ]
)
LINK = T.StructType(_strings("channel", "ts", "permalink"))
MESSAGE = T.StructType(
    _strings("id", "channel", "channel_name", "text", "user", "ts", "permalink", "thread_ts")
)
CHUNK = T.StructType(
    _strings("id", "text", "channel", "channel_name", "user", "ts", "permalink")
    + [T.StructField("chunk_index", T.IntegerType(), True)]
)
# A chunk in the index also carries its vector, its message's version and the number of the
# commit that it came with, which a batch learns when it is read.
INDEX_ROW = T.StructType(
    CHUNK.fields
    + [
        T.StructField("text_hash", T.StringType(), True),
        T.StructField("buckets", T.ArrayType(T.IntegerType()), True),
        T.StructField("weights", T.ArrayType(T.DoubleType()), True),
        T.StructField("version", T.DecimalType(16, 6), True),
        T.StructField("commit", T.LongType(), True),
    ]
)
QUESTION = T.StructType(_strings("query_id", "text"))
