"""Protected spans: parts of a message that a chunk boundary must not cut.

Positions are half-open code-point offsets. The four kinds are looked for
independently on the same text and then merged where they overlap or touch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import Push, empty_array, fold_emit, let

SPAN = "struct<s:int,e:int>"

# The protected patterns. Flags: (?U) makes \s Unicode-aware,
# (?m) anchors at line ends, (?d) lets only \n end a line. The class _S adds the
# four separator characters that count as white space in the data model.
_S = r"[\s\x1c-\x1f]"
FENCED_CODE = r"(?s)```.*?```"
INLINE_CODE = r"`[^`\n]+`"
LINK = r"(?U)https?://[^\s\x1c-\x1f<>\[\]()]+|<https?://[^>|]+(?:\|[^>]+)?>"
LIST_ITEM = (
    rf"(?Umd)^{_S}*"
    r"(?:[-*•・‣⁃]|[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]|[０-９]+[.．、]|[0-9]+[.．、])"
    rf"{_S}*.+$"
)


def _parts(text: Column, pattern: str) -> Column:
    return F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
    )


def _offsets(parts: Column) -> Column:
    """Offsets of all matches: running lengths over the gaps and the matches."""

    def step(pos: Column, i: Column, push: Push) -> Column:
        start = pos + F.length(F.get(parts["gaps"], i))
        end = start + F.length(F.get(parts["hits"], i))
        span = F.struct(start.alias("s"), end.alias("e"))
        return let(span, lambda x: push(x["e"], F.array(x)))

    return fold_emit(F.size(parts["hits"]), F.lit(0), SPAN, step)["out"]


def find_spans(text: Column) -> Column:
    """All protected spans of a text, unmerged, ordered by start."""
    # a cheap look for the marker characters first; most texts have none
    kinds = [
        (text.contains("`"), FENCED_CODE),
        (text.contains("`"), INLINE_CODE),
        (text.contains("http"), LINK),
        (text.rlike(LIST_ITEM), LIST_ITEM),
    ]
    found = [F.when(likely, _parts(text, pattern)) for likely, pattern in kinds]
    some = F.filter(F.array(*found), lambda x: x.isNotNull())
    return F.sort_array(F.flatten(F.transform(some, _offsets)))


def merge_spans(spans: Column) -> Column:
    """Merge ordered spans that overlap or touch."""

    def step(cur: Column, i: Column, push: Push) -> Column:
        nxt = F.get(spans, i + 1)
        joins = nxt["s"] <= cur["e"]
        grown = F.struct(cur["s"].alias("s"), F.greatest(cur["e"], nxt["e"]).alias("e"))
        fresh = F.struct(nxt["s"].alias("s"), nxt["e"].alias("e"))
        return push(
            F.when(joins, grown).otherwise(fresh),
            F.when(joins, empty_array(SPAN)).otherwise(F.array(cur)),
        )

    def run(first: Column) -> Column:
        folded = fold_emit(F.size(spans) - 1, first, SPAN, step)
        return let(folded, lambda r: F.concat(r["out"], F.array(r["st"])))

    return F.when(F.size(spans) < 2, spans).otherwise(run(F.get(spans, F.lit(0))))


def protected_spans(text: Column) -> Column:
    """Merged protected spans of a text as ``array<struct<s:int,e:int>>``."""
    return let(find_spans(text), merge_spans)
