"""Column helpers for message text. Everything here is a JVM expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character the data model treats as white space when it
# trims a text (tab..carriage return, the four separators, space, next line,
# no-break space and the Unicode spaces).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: a user mention inside a message.
MENTION = r"<@[A-Z0-9]+>"


def strip(text: Column) -> Column:
    """Trim all Unicode white space; Spark's one-argument trim only knows U+0020."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return strip(F.coalesce(text, F.lit(""))) == ""


def strip_mentions(text: Column) -> Column:
    """Remove user mentions, then trim."""
    return strip(F.regexp_replace(text, MENTION, ""))


def is_set(value: Column) -> Column:
    """True unless the value is null or the empty string."""
    return F.coalesce(value, F.lit("")) != ""


def cjk_count(text: Column) -> Column:
    """Number of characters in U+3000-U+9FFF or U+FF00-U+FFEF."""
    others = F.regexp_replace(text, r"[\u3000-\u9fff\uff00-\uffef]+", "")
    return F.length(text) - F.length(others)


def cjk_share(text: Column) -> Column:
    """Share of CJK characters, 0 for empty text."""
    size = F.length(text)
    return F.when(size > 0, cjk_count(text) / size).otherwise(F.lit(0.0))


def message_time(ts: Column) -> Column:
    """Epoch-seconds string to a timestamp, exact to the microsecond (never through double).

    Null when it is not a number.
    """
    return F.timestamp_micros((ts.try_cast("decimal(16,6)") * 1000000).cast("bigint"))
