"""The fold of ``chunks`` over one text in plain Python, as an Arrow step of a task runs it.

The rules and fixed values are those of ``chunks``; spans come from there. Pieces go to
growing buffers, so a batch never stands in memory as Python objects.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

from .text import WHITE_SPACE

# Fixed values, see ``chunks``.
MERGE_GROWTH = 1.5
CJK_HEAVY = 0.3
TOKENS_PER_CJK_CHAR = 1.2
TOKENS_PER_CHAR = 0.35
RETRY_SIZE = 0.7
RETRY_MIN_SPAN = 200
RETRY_MIN_KEPT = 100
OTHER, NO_CUT, STOP, CJK_STOP = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
OPEN = "[^\ufdd0-\ufdd3]"
HARD_BREAK = (
    "(?s).+(?:"
    "(?=\n\n)"
    f"|(?<=[.!?{STOP}])(?=[ \n].)"
    f"|(?<=[。！？])(?={OPEN}.)"
    ")"
)
NEWLINE = f"(?s).+(?<!{CJK_STOP})(?=\n.)"
SPACE = f"(?s).+(?<!{CJK_STOP})(?= .)"
CJK_COMMA = f"(?s).+(?<=、)(?={OPEN}.)"

Span = tuple[int, int]
Piece = tuple[int, int, str]

_hard = re.compile(HARD_BREAK).match
_weak = [(re.compile(p).match, extra) for p, extra in ((NEWLINE, 1), (SPACE, 1), (CJK_COMMA, 0))]
_marks = re.compile("[\ufdd0-\ufdd3]").search
_cjk = re.compile("[\u3000-\u9fff\uff00-\uffef]")
_plain = str.maketrans(dict.fromkeys((OTHER, NO_CUT, STOP, CJK_STOP), "x"))
_inside = re.compile("(?s)[^.!?。！？]").sub
_stops = str.maketrans(dict.fromkeys(".!?", STOP) | dict.fromkeys("。！？", CJK_STOP))


def fits(body: str, size: int) -> bool:
    """Whether the default token estimate of a chunk is within its limit."""
    n, held = len(body), len(body.encode())
    # as in ``chunks``: the byte count bounds the estimate, most texts pass here
    if math.ceil(n / 4 + 0.75 * (held - n) / 2) <= int(size * TOKENS_PER_CHAR):
        return True
    cjk = len(_cjk.findall(body))
    share = cjk / n if n else 0.0
    limit = int(size * (TOKENS_PER_CJK_CHAR if share > CJK_HEAVY else TOKENS_PER_CHAR))
    return math.ceil(cjk + (n - cjk) / 4) <= limit


def _mask(window: str, base: int, spans: list[Span]) -> str:
    w, width, at, out = window.translate(_plain), len(window), 0, []
    for first, last in spans:
        s, e = max(first - base, 0), min(last - base, width)
        gap, inside = w[at:s], w[s:e]
        if gap.endswith("\n") and inside.startswith("\n"):
            gap = gap[:-1] + NO_CUT
        out += [gap, _inside(OTHER, inside).translate(_stops)]
        at = e
    return "".join([*out, w[at:]])


def _pick(tail: str, masked: Callable[[], str], width: int) -> int:
    half = width >> 1
    if m := _hard(tail):
        i = m.end()
        ahead = tail[i : i + 2]
        if ahead == "\n\n":
            return half + i + 2
        return half + i + (tail[i - 1] in ".!?" + STOP and ahead[:1] in (" ", "\n"))
    for match, extra in _weak:
        if m := match(tail):
            return half + m.end() + extra
    head = masked()[1 : 1 + width]
    last = head.rfind(" ")
    return width if last < 0 else width - (len(head) - last - 1) + 1


def _boundary(text: str, spans: list[Span], plain: bool, pos: int, target: int) -> int:
    width = target - pos
    if hold := next((x for x in spans if x[0] <= target < x[1]), None):
        if hold[0] <= pos:
            return hold[1]
        width = hold[0] - pos
    end, half = pos + width + 2, width >> 1

    def window(first: int) -> str:
        return text[first:end].ljust(end - first, "x")

    if plain:
        return pos + _pick(window(pos + half), lambda: window(pos), width)
    masked = _mask(window(pos), pos, [x for x in spans if x[1] > pos and x[0] < end])
    return pos + _pick(masked[half:], lambda: masked, width)


def pieces(text: str, spans: list[Span], size: int, overlap: int, use_tokens: bool) -> Iterator[Piece]:
    """Offsets and stripped texts of the slices of a stripped text; blank slices are left out."""
    total, pos = len(text), 0
    plain = not spans and (text.isascii() or not _marks(text))
    targets = [size, int(size * RETRY_SIZE)] if use_tokens else [size]
    if total <= size:
        if text:
            yield 0, total, text
        return
    while pos < total:
        if pos + size >= total:
            if body := text[pos:].strip(WHITE_SPACE):
                yield pos, total, body
            return
        taken = None
        for target in targets:
            end = _boundary(text, spans, plain, pos, pos + target)
            raw = text[pos:end]
            body = raw.strip(WHITE_SPACE)
            # the first try is always taken, the shorter one only if it keeps enough
            if taken is None or (end > pos + RETRY_MIN_KEPT and body):
                taken = end, raw, body
                if not use_tokens or not body or end - pos <= RETRY_MIN_SPAN or fits(body, size):
                    break
        end, raw, body = taken
        if body:
            yield pos, end, body
        restart = end
        if end < total and 0 < overlap < end - pos:
            at = raw.find(" ", end - pos - overlap)
            restart = end if at < 0 else pos + at + 1
        pos = restart


def merged(texts: Iterable[str], size: int, min_chunk: int) -> Iterator[str]:
    """Texts with those below ``min_chunk`` characters joined to a neighbour, left to right."""
    limit, cur = int(size * MERGE_GROWTH), None
    for nxt in texts:
        if cur is None:
            cur = nxt
        elif min(len(cur), len(nxt)) < min_chunk and len(cur) + len(nxt) + 1 <= limit:
            cur = f"{cur} {nxt}"
        else:
            yield cur
            cur = nxt
    if cur is not None:
        yield cur


def rows(
    texts: pa.StringArray, starts: pa.ListArray, ends: pa.ListArray, one: Callable[[str, list[Span]], list[Piece]]
) -> pa.ListArray:
    """Pieces that ``one`` makes of every text and its spans, as lists; none for a null."""
    bounds, first, last, at, held = array("i", [0]), array("i"), array("i"), array("i", [0]), bytearray()
    for text, s, e in zip(texts, starts, ends, strict=True):
        if (text := text.as_py()) is not None:
            for begin, end, body in one(text, list(zip(s.as_py(), e.as_py(), strict=True))):
                first.append(begin)
                last.append(end)
                held += body.encode()
                at.append(len(held))
        bounds.append(len(first))
    # the buffers are taken as they are: a batch is held once
    bodies = pa.StringArray.from_buffers(len(first), pa.py_buffer(at), pa.py_buffer(held))
    spans = [pa.Array.from_buffers(pa.int32(), len(first), [None, pa.py_buffer(x)]) for x in (first, last)]
    found = pa.StructArray.from_arrays([*spans, bodies], ["s", "e", "text"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found)
