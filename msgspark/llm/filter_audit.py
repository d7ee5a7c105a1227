"""Filter interaction audit: what each filter removes in every order, and its share by potentials."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import packed, slices
from .scratch import Scratch

FILTERS = "ABCDE"
COALITIONS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_BIT = {name: 1 << k for k, name in enumerate(FILTERS)}

#: Fixed values of the failure conditions.
LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
_CAPITALS = bytes(range(65, 91))
_MARKS = b"#$%&*|"

_CONTINUATION = bytes(range(0x80, 0xC0))
_WHITE = re.compile(rb"[ \t-\r]")
#: Bytes of a text that are split into words at once, and of a text whose words fit one set.
PIECE = 1 << 20
ONE_SET = 4 << 20


def pieces(raw: bytes, size: int) -> Iterator[bytes]:
    """Runs of about ``size`` bytes that end in front of white space, so no word is cut."""
    at = 0
    while at < len(raw):
        found = _WHITE.search(raw, at + size)
        end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end


def word_counts(raw: bytes, piece: int = PIECE, one_set: int = ONE_SET) -> tuple[int, int]:
    """Words and distinct words. A long text is read several times, each time for a share
    of its words by their hash, so a set never holds more than ``one_set`` bytes' words."""
    if len(raw) <= piece:
        words = raw.split()
        return len(words), len(set(words))
    total = distinct = 0
    passes = max(1, -(-len(raw) // one_set))
    for k in range(passes):
        seen: set[bytes] = set()
        for part in pieces(raw, piece):
            words = part.split()
            total += len(words) if not k else 0
            seen.update(words if passes == 1 else [w for w in words if hash(w) % passes == k])
        distinct += len(seen)
    return total, distinct


def failures(raw: bytes) -> int:
    """Bits of the failed filters A to D of one text; E needs the other texts."""
    words, distinct = word_counts(raw)
    points = len(raw.translate(None, _CONTINUATION))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (
        _BIT["A"] * (words < LEAST_WORDS)
        | _BIT["B"] * (100 * distinct < LEAST_DISTINCT * words)
        | _BIT["C"] * (100 * capitals > MOST_CAPITALS * points)
        | _BIT["D"] * (len(raw.translate(None, _MARKS)) != len(raw))
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in slices(packed(batches, "text", 2 << 20), "text"):
        digests, masks = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            raw = data[a:b].tobytes()
            digests.append(hashlib.sha256(raw).digest())
            masks.append(failures(raw))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())],
            names=["doc_id", "part", "digest", "mask"],
        )


def failed_filters(docs: DataFrame, *, part: str = "source") -> DataFrame:
    """Failed filters of every document: (doc_id, part, mask), bit k for the filter ``FILTERS[k]``.

    Texts are identical when their SHA-256 is; E fails where a smaller doc_id has the
    same text. A null text is empty, a null part the empty string, a null doc_id is larger
    than any other. Rows that repeat a doc_id fail alike: none is smaller than the other.
    Other columns are ignored, also those that are named as these. Texts are read once and
    do not move; a text that very many rows share has its smallest id found before
    the shuffle, and rows meet it in a join that Spark can split.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        "text",
    )
    table = scratch.write(
        rows.mapInArrow(_measured, "doc_id long, part string, digest binary, mask int"), "failures"
    )
    shared = (
        table.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    later = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    return table.join(shared, "digest", "left").select(
        "doc_id",
        "part",
        (F.col("mask") + F.when(later, _BIT["E"]).otherwise(0)).alias("mask"),
    )


def _game(column: str) -> Column:
    """What every coalition removes: rows that fail at least one of its filters."""
    return F.array(
        *(F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(column)).otherwise(0)) for s in range(COALITIONS))
    )


def coalition_values(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """The removal games of every part: (part, n, removed, good, toxic), arrays by coalition.

    Counts are taken by (part, mask) before the shuffle, at most 32 rows a part and task.
    A document counts as good or toxic where any row of ``labels`` with its doc_id
    says 1; rows of a null doc_id say nothing.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    patterns = (
        failed.join(marks, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.coalesce("good", F.lit(0))).alias("good"),
            F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
        )
    )
    return patterns.groupBy("part").agg(
        F.sum("n").alias("n"), *(_game(c).alias("removed" if c == "n" else c) for c in ("n", "good", "toxic"))
    )


def potentials(values: Column) -> Column:
    """Hart-Mas-Colell potential P of every coalition, times the factorial of its size.

    P of none is 0 and |S| P(S) = v(S) + the sum of P over S without one of its members.
    Times |S|! all terms are whole: Q(S) = (|S| - 1)! v(S) + the sum of those Q.
    """
    factorials = F.lit([1, 1, 2, 6, 24])
    bits = F.lit([1 << k for k in range(len(FILTERS))])

    def grow(done: Column, s: Column) -> Column:
        own = F.get(factorials, F.bit_count(s) - 1).cast("long") * F.get(values, s)
        rest = F.aggregate(
            bits,
            F.lit(0).cast("long"),
            lambda total, bit: total
            + F.when(s.bitwiseAND(bit) != 0, F.get(done, s - bit)).otherwise(F.lit(0).cast("long")),
        )
        return F.array_append(done, own + rest)

    return F.aggregate(F.sequence(F.lit(1), F.lit(COALITIONS - 1)), F.array(F.lit(0).cast("long")), grow)


def audit(games: DataFrame) -> DataFrame:
    """Every order and step of every part, from the values of its coalitions.

    A step is the difference of two coalitions: the filters so far with and without its
    own. shapley is 120 times the grand potential less that without the filter, which is
    what the filter removes, summed over all orders.
    """
    grand = COALITIONS - 1
    bit, before = [], []
    for order in ORDERS:
        for k, name in enumerate(order):
            bit.append(_BIT[name])
            before.append(sum(_BIT[x] for x in order[:k]))
    steps = F.explode(F.sequence(F.lit(0), F.lit(len(bit) - 1))).alias("at")
    rows = games.withColumn("potential", potentials(F.col("removed"))).select("*", steps)
    rows = rows.withColumns({
        "own": F.get(F.lit(bit), F.col("at")),
        "before": F.get(F.lit(before), F.col("at")),
    })
    after = F.col("before") + F.col("own")

    def value(game: str, coalition: Column) -> Column:
        return F.get(game, coalition)

    gained = {c: value(c, after) - value(c, F.col("before")) for c in ("removed", "good", "toxic")}
    alone, grand_value = value("removed", F.col("own")), value("removed", F.lit(grand))
    without = grand - F.col("own")
    return rows.select(
        "part",
        F.get(F.lit(ORDERS), F.floor(F.col("at") / len(FILTERS)).cast("int")).alias("filter_order"),
        (F.col("at") % len(FILTERS) + 1).alias("step"),
        (F.col("n") - value("removed", after)).alias("kept"),
        gained["removed"].alias("removed"),
        (alone - gained["removed"]).alias("redundant"),
        (grand_value - value("removed", without)).alias("unique_fails"),
        gained["good"].alias("good_lost"),
        gained["toxic"].alias("toxic_lost"),
        (value("potential", F.lit(grand)) - len(FILTERS) * value("potential", without)).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, *, part: str = "source") -> DataFrame:
    """Counts of every part, filter order and step; see ``failed_filters`` and ``audit``.

    Filters: A too few words, B too few distinct words, C too many capitals, D a mark,
    E the text of a smaller doc_id. Words are runs without ASCII white space. Very long
    texts are read in pieces. An empty table has no parts and gives no rows; a part whose
    documents all pass gives rows of zeros.
    """
    return audit(coalition_values(failed_filters(docs, part=part), labels))
