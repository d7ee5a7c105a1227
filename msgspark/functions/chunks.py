"""Boundary-aware chunking of one text, as a fold over windows of the text.

Each step looks at one window, picks the best boundary inside it and moves on.
A window is cut from blocks of the text, so a step costs the same at the start
and at the end of a very long message.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cuts
from .folds import Push, empty_array, fold_emit, let, walk_emit
from .spans import protected_spans
from .text import cjk_count, cjk_share, strip

PIECE = "struct<s:int,e:int,text:string>"
BLOCK_BITS = 8
TEXT_BLOCK = 1 << BLOCK_BITS

# Default sizes of the data model.
CHUNK_SIZE = 600
MIN_CHUNK = 50
MERGE_GROWTH = 1.5
CJK_HEAVY = 0.3
TOKENS_PER_CJK_CHAR = 1.2
TOKENS_PER_CHAR = 0.35
RETRY_SIZE = 0.7
RETRY_MIN_SPAN = 200
RETRY_MIN_KEPT = 100
#: Bytes of texts that may go to a Python worker, which gets thousands at a time; longer ones are folded where they are.
SENT_BYTES = 1 << 15

# Stand-ins for protected characters inside a window. Only the position of a
# boundary is read from a masked window, never its text, so any character that
# already has one of these code points is first replaced by a plain letter.
_OTHER, _NO_CUT, _STOP, _CJK_STOP = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
_OPEN = "[^\ufdd0-\ufdd3]"
_HARD_BREAK = (
    "(?s)^.+(?:"
    "(?=\n\n)"
    f"|(?<=[.!?{_STOP}])(?=[ \n].)"
    f"|(?<=[。！？])(?={_OPEN}.)"
    ")"
)
_NEWLINE = f"(?s)^.+(?<!{_CJK_STOP})(?=\n.)"
_SPACE = f"(?s)^.+(?<!{_CJK_STOP})(?= .)"
_CJK_COMMA = f"(?s)^.+(?<=、)(?={_OPEN}.)"


def default_tokens(text: Column) -> Column:
    """Token estimate: one per CJK character, one per four other characters."""
    cjk = cjk_count(text)
    return F.ceil(cjk + (F.length(text) - cjk) / 4).cast("int")


def token_limit(text: Column, chunk_size: int = CHUNK_SIZE) -> Column:
    """Token budget of a chunk, larger when the chunk is mostly CJK."""
    return (
        F.when(cjk_share(text) > CJK_HEAVY, F.lit(int(chunk_size * TOKENS_PER_CJK_CHAR)))
        .otherwise(F.lit(int(chunk_size * TOKENS_PER_CHAR)))
    )


def _blocks(text: Column) -> Column:
    short = F.length(text) <= TEXT_BLOCK
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    return F.when(short, F.array(text)).otherwise(cut)


def _slice(blocks: Column, start: Column, end: Column) -> Column:
    """Characters ``start .. end-1``; ``end`` may lie past the end of the text."""
    first = F.shiftright(start, BLOCK_BITS)
    last = F.shiftright(end - 1, BLOCK_BITS)
    # blocks are short: few characters are passed over before the slice begins
    near = F.when(first == last, F.get(blocks, first)).otherwise(
        F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    )
    return F.substring(near, start - first * TEXT_BLOCK + 1, end - start)


def _mask_span(text: Column) -> Column:
    other = F.regexp_replace(text, "(?s)[^.!?。！？]", _OTHER)
    return F.translate(other, ".!?。！？", _STOP * 3 + _CJK_STOP * 3)


def _mask(window: Column, base: Column, spans: Column) -> Column:
    """Hide the protected characters of a window that starts at offset ``base``."""
    width = F.length(window)
    plain = F.translate(window, _OTHER + _NO_CUT + _STOP + _CJK_STOP, "xxxx")

    def run(w: Column) -> Column:
        def add(acc: Column, span: Column) -> Column:
            s = F.greatest(span["s"] - base, F.lit(0))
            e = F.least(span["e"] - base, width)
            gap = F.substring(w, acc["at"] + 1, s - acc["at"])
            inside = F.substring(w, s + 1, e - s)
            # a free newline that runs into a protected one offers no boundary
            gap = F.when(
                gap.endswith("\n") & inside.startswith("\n"),
                F.concat(F.substring(gap, F.lit(1), F.length(gap) - 1), F.lit(_NO_CUT)),
            ).otherwise(gap)
            return F.struct(
                F.concat(acc["text"], gap, _mask_span(inside)).alias("text"), e.alias("at")
            )

        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
        return let(
            F.aggregate(spans, start, add),
            lambda r: F.concat(r["text"], F.substring(w, r["at"] + 1, width)),
        )

    return let(plain, run)


def _last(pattern: str, text: Column) -> Column:
    """Length of the longest match that starts at the front of ``text``, 0 if none."""
    return F.length(F.regexp_extract(text, pattern, 0))


def _pick(tail: Column, masked: Column, width: Column) -> Column:
    """Boundary inside a masked window of ``width + 2`` characters, ``tail`` being its last half.

    Strong breaks (paragraph, sentence) in the last half win, rightmost first;
    then a newline, a space, a CJK comma there; then any space; then the width.
    """
    half = F.shiftright(width, 1)

    def strong(tail: Column) -> Column:
        def kind(i: Column, around: Column) -> Column:
            ahead = F.substring(around, F.lit(2), F.lit(2))
            behind = F.substring(around, F.lit(1), F.lit(1))
            return half + i + (
                F.when(ahead == "\n\n", 2)
                .when(behind.isin(".", "!", "?", _STOP) & (ahead.startswith(" ") | ahead.startswith("\n")), 1)
                .otherwise(0)
            )

        def found(i: Column) -> Column:
            return F.when(i > 0, let(F.substring(tail, i, F.lit(3)), lambda around: kind(i, around)))

        return let(_last(_HARD_BREAK, tail), found)

    def weak(tail: Column, pattern: str, extra: int) -> Column:
        return let(_last(pattern, tail), lambda i: F.when(i > 0, half + i + extra))

    def any_space() -> Column:
        def after(head: Column) -> Column:
            return F.when(head.contains(" "), width - F.length(F.substring_index(head, " ", -1)) + 1)

        return let(F.substring(masked, F.lit(2), width), after)

    def choose(tail: Column) -> Column:
        return F.coalesce(
            strong(tail),
            weak(tail, _NEWLINE, 1),
            weak(tail, _SPACE, 1),
            weak(tail, _CJK_COMMA, 0),
            any_space(),
            width,
        )

    return let(tail, choose)


def _boundary(src: Column, pos: Column, target: Column) -> Column:
    """End offset of the chunk that starts at ``pos`` and may reach ``target``."""
    blocks, spans = src["blocks"], src["spans"]
    holding = F.get(F.filter(spans, lambda x: (x["s"] <= target) & (target < x["e"])), F.lit(0))

    def cut(hold: Column) -> Column:
        width = F.when(hold.isNotNull(), hold["s"]).otherwise(target) - pos
        return F.when(hold["s"] <= pos, hold["e"]).otherwise(let(width, within))

    def within(width: Column) -> Column:
        end = pos + width + 2
        half = F.shiftright(width, 1)

        def window(first: Column) -> Column:
            part = _slice(blocks, first, end)
            return F.when(end <= src["total"], part).otherwise(F.rpad(part, end - first, "x"))

        near = F.filter(spans, lambda x: (x["e"] > pos) & (x["s"] < end))
        masked = F.when(src["plain"], window(pos)).otherwise(
            let(window(pos), lambda w: let(near, lambda n: _mask(w, pos, n)))
        )
        # a window without mask is not cut whole: mostly its last half is all that is read
        tail = F.when(src["plain"], window(pos + half)).otherwise(F.substring(masked, half + 1, width + 2 - half))
        return pos + _pick(tail, masked, width)

    return F.when(F.size(spans) == 0, let(target - pos, within)).otherwise(let(holding, cut))


def _restart(piece: Column, pos: Column, end: Column, overlap: int) -> Column:
    """Where the next chunk starts: after the first space of the overlap, else at ``end``."""
    if overlap <= 0:
        return end
    # the overlap region is the last ``overlap`` characters of the unstripped piece
    region = F.substring(piece, end - pos - overlap + 1, F.lit(overlap))
    after = let(F.instr(region, " "), lambda at: F.when(at > 0, end - overlap + at).otherwise(end))
    return F.when(end - overlap > pos, after).otherwise(end)


@lru_cache(maxsize=32)
def chunk_pieces(
    text: str,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = 0,
    use_tokens: bool = True,
    tokens: Callable[[Column], Column] = default_tokens,
    spans: str | None = None,
) -> Column:
    """Chunks of the stripped text in column ``text`` before small ones are merged.

    Returns ``array<struct<s,e,text>>``: offsets of the raw slice and its
    stripped text; blank slices are left out. ``tokens`` maps a text column to a
    token count and must be a Spark expression. ``spans`` is a column with the
    protected spans, if there is one. The expression is large, so it is built once
    per set of arguments.
    """
    text = F.col(text)
    size = int(chunk_size)
    shorter = int(size * RETRY_SIZE)

    def surely_fits(body: Column) -> Column:
        # A CJK character takes three bytes and none more than four, so the byte count
        # bounds the default estimate, more closely with the number of characters; most
        # texts pass here and skip the exact count.
        if tokens is not default_tokens:
            return F.lit(False)
        n, held = F.length(body), F.octet_length(body)
        most = F.ceil(n / 4 + 0.75 * (held - n) / 2)
        limit = int(size * TOKENS_PER_CHAR)
        return (held * 11 <= limit * 32) | (most <= limit)

    def piece(s: Column, e: Column, body: Column) -> Column:
        return F.struct(s.alias("s"), e.alias("e"), body.alias("text"))

    def kept(s: Column, e: Column, body: Column) -> Column:
        return F.when(body == "", empty_array(PIECE)).otherwise(F.array(piece(s, e, body)))

    def long_text(src: Column) -> Column:
        blocks, spans, total = src["blocks"], src["spans"], src["total"]

        def found(pos: Column, end: Column, raw: Column, body: Column, push: Push) -> Column:
            restart = F.when(end >= total, end).otherwise(_restart(raw, pos, end, overlap))
            return push(restart, kept(pos, end, body))

        def last_piece(pos: Column, push: Push) -> Column:
            return let(
                strip(_slice(blocks, pos, total)),
                lambda body: push(total, kept(pos, total, body)),
            )

        def attempt(pos: Column) -> Callable[[Column, Column], Column]:
            def best(acc: Column, target: Column) -> Column:
                def offer(end: Column, raw: Column, body: Column) -> Column:
                    fits = F.lit(True)
                    if use_tokens:
                        fits = (
                            (body == "")
                            | (end - pos <= RETRY_MIN_SPAN)
                            | surely_fits(body)
                            | (tokens(body) <= token_limit(body, size))
                        )
                    new = F.struct(
                        end.alias("end"), raw.alias("raw"), body.alias("body"), fits.alias("fits")
                    )
                    # the first try is always taken, the shorter one only if it keeps enough
                    good = acc["end"].isNull() | ((end > pos + RETRY_MIN_KEPT) & (body != ""))
                    return F.when(good, new).otherwise(acc)

                tried = let(
                    _boundary(src, pos, pos + target),
                    lambda end: let(
                        _slice(blocks, pos, end),
                        lambda raw: let(strip(raw), lambda body: offer(end, raw, body)),
                    ),
                )
                return F.when(acc["fits"], acc).otherwise(tried)

            return best

        def step(pos: Column, push: Push) -> Column:
            targets = F.array(*[F.lit(n) for n in ([size, shorter] if use_tokens else [size])])
            none = F.struct(
                F.lit(None).cast("int").alias("end"),
                F.lit("").alias("raw"),
                F.lit("").alias("body"),
                F.lit(False).alias("fits"),
            )
            taken = F.aggregate(
                targets, none, attempt(pos), lambda t: found(pos, t["end"], t["raw"], t["body"], push)
            )
            return F.when(pos + size >= total, last_piece(pos, push)).otherwise(taken)

        return walk_emit(total, PIECE, step)

    def with_plain(x: Column) -> Column:
        # no protected part and no stand-in character: windows need no mask
        plain = (F.size(x) == 0) & ~text.rlike(f"[{_OTHER}-{_CJK_STOP}]")
        return F.struct(
            _blocks(text).alias("blocks"),
            x.alias("spans"),
            plain.alias("plain"),
            F.length(text).alias("total"),
        )

    return F.when(F.length(text) <= size, kept(F.lit(0), F.length(text), text)).otherwise(
        let(let(F.col(spans) if spans else protected_spans(text), with_plain), long_text)
    )


def is_sent(text: Column, chunk_size: int = CHUNK_SIZE) -> Column:
    """True for texts that a Python worker cuts: more than one chunk, and not too long."""
    some = (F.length(text) > int(chunk_size)) & (F.octet_length(text) <= SENT_BYTES)
    return some & F.is_valid_utf8(text)


def _worked(text: Column, spans: Column, sent: Column, kind: str, one: Callable[[str, list], list]) -> Column:
    def run(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        made = cuts.rows(texts, starts, ends, one)
        return made if PIECE in kind else pa.ListArray.from_arrays(made.offsets, made.values.field("text"))

    # two fields, so that Catalyst keeps the spans as a column: a fold among the arguments is not found again
    return F.arrow_udf(run, kind)(*[F.when(sent, x) for x in (text, spans["s"], spans["e"])])


def cut_pieces(
    text: Column, spans: Column, sent: Column, chunk_size: int, overlap: int, use_tokens: bool
) -> Column:
    """What ``chunk_pieces`` gives with the default tokens, for texts that are ``sent``."""
    size = int(chunk_size)

    def one(text: str, spans: list) -> list:
        return list(cuts.pieces(text, spans, size, overlap, use_tokens))

    return _worked(text, spans, sent, f"array<{PIECE}>", one)


def cut_texts(
    text: Column, spans: Column, sent: Column, chunk_size: int, overlap: int, use_tokens: bool, min_chunk: int
) -> Column:
    """Texts of ``cut_pieces`` with small ones merged."""
    size = int(chunk_size)

    def one(text: str, spans: list) -> list:
        bodies = (body for _, _, body in cuts.pieces(text, spans, size, overlap, use_tokens))
        return [(0, 0, x) for x in (cuts.merged(bodies, chunk_size, min_chunk) if min_chunk > 0 else bodies)]

    return _worked(text, spans, sent, "array<string>", one)


def merge_small(
    texts: Column, chunk_size: int = CHUNK_SIZE, min_chunk: int = MIN_CHUNK
) -> Column:
    """Join chunks below ``min_chunk`` characters to a neighbour, left to right."""
    limit = int(chunk_size * MERGE_GROWTH)

    def step(cur: Column, i: Column, push: Push) -> Column:
        nxt = F.get(texts, i + 1)
        # a character has four bytes at most, so most chunks are told by their bytes
        few = F.least(F.octet_length(cur), F.octet_length(nxt)) < 4 * min_chunk
        small = few & (F.least(F.length(cur), F.length(nxt)) < min_chunk)
        joins = small & (F.length(cur) + F.length(nxt) + 1 <= limit)
        return let(joins, lambda joined: push(
            F.when(joined, F.concat(cur, F.lit(" "), nxt)).otherwise(nxt),
            F.when(joined, empty_array("string")).otherwise(F.array(cur)),
        ))

    folded = fold_emit(F.size(texts) - 1, F.get(texts, F.lit(0)), "string", step)
    joined = let(folded, lambda r: F.concat(r["out"], F.array(r["st"])))
    return F.when(F.size(texts) < 2, texts).otherwise(joined)
