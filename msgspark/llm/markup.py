"""Text lines of a web page, each with what the markup says about it."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

#: Fixed values of HTML: elements without text of their own, without an end, and blocks.
_RAW = "script style noscript template svg iframe object textarea select option canvas audio video head".split()
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p "
    "pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th caption figcaption".split())
_FURNITURE = frozenset("nav footer aside form menu dialog button title head search fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of class and id values that name page furniture.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "footer masthead toolbar comment comments commentlist respond reply replies discussion disqus share "
    "sharing social related recommended recommendations widget login search form".split()
)
#: Of these, names and elements that a part of an article may have as well: there they only
#: say that a line may go if the nearest page has it too.
_LOOSE = frozenset(
    "social related recommended recommendations widget search login discussion banner notice notices alert promo "
    "promotion sponsor sponsored notification overlay modal menu toolbar".split()
)
_LOOSE_KINDS = frozenset("aside dialog search menu fieldset".split())
_COMMENTS = frozenset("comment comments commentlist respond reply replies discussion disqus".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(_RAW)})(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*>|(?=<body)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-z][^>]*+>|<[!?/][^>]*+>|<[a-z/!?][^>]*+\Z",
    re.I | re.S,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Ids that name the comments of an article; its other ids are anchors of its sections.
_COMMENT_IDS = frozenset("comment comments commentlist respond disqus".split())
#: How an element is marked as furniture: not, by a part of a name, by a whole name, by a name
#: of comments (part, whole), by its kind. A mark is handed down, the strongest one wins.
_NONE, _PART, _COMMENT_PART, _WHOLE, _COMMENT, _KIND = range(6)
#: Furniture unless the page has no other article.
_HELD = 6


@dataclass(frozen=True)
class Line:
    text: str
    main: bool  # inside the element that holds the article
    prose: bool  # in an element for running text
    furniture: bool  # inside navigation, adverts, comments and the like
    loose: bool = False  # inside a part of the article that is named like furniture


def _judge(name: str, rest: str, in_main: bool) -> tuple[bool, int, bool]:
    """(is a main element, its mark of furniture, is loose) for an opened element.

    Inside the article only whole names count, and of ids only those of comments; what
    may as well be a part of the article is loose and no furniture.
    """
    words: set[str] = set()
    whole: set[str] = set()
    role = ""
    for kind, *values in _NAMED.findall(rest):
        value = next((v for v in values if v), "")
        if kind.lower() == "role":
            role = value.strip().lower()
            continue
        words.update(w.lower() for w in _WORD.findall(value))
        names = set(value.lower().split())
        whole |= names & _COMMENT_IDS if in_main and kind.lower() == "id" else names
    if name in ("html", "body"):
        return False, _NONE, False
    if name in ("article", "main") or role in ("main", "article"):
        return True, _COMMENT if whole & _COMMENTS else _NONE, False
    if name == "header" or "header" in (whole if in_main else words):
        return False, _NONE if in_main else _KIND, False
    if in_main and name in _LOOSE_KINDS:
        return False, _COMMENT if whole & _COMMENTS else _WHOLE if whole & (_NAMES - _LOOSE) else _NONE, True
    if name in _FURNITURE or (role in _ROLES and not (in_main and role == "complementary")):
        return False, _KIND, False
    if whole & (_COMMENTS - _LOOSE if in_main else _COMMENTS):
        return False, _COMMENT, False
    if whole & (_NAMES - _LOOSE if in_main else _NAMES):
        return False, _WHOLE, False
    if in_main:
        return False, _NONE, bool(whole & _LOOSE)
    if not words & _NAMES:
        return False, _NONE, False
    return False, _COMMENT_PART if words & _COMMENTS else _PART, False


def _settled(found: list[tuple[Line, int]]) -> list[Line]:
    """Lines whose marks depend on the rest of the page.

    An article inside an element that is named like furniture is the article where the
    page has no other. Where nothing else is left, parts of names mark no furniture.
    """
    if not any(line.main and not mark for line, mark in found):
        found = [(line, _NONE if mark == _HELD else mark) for line, mark in found]
    if all(found_mark for _, found_mark in found):
        found = [(line, _NONE if mark in (_PART, _COMMENT_PART) else mark) for line, mark in found]
    return [Line(line.text, line.main, line.prose, mark != _NONE, line.loose) for line, mark in found]


def lines(html: str | None) -> list[Line]:
    """Blocks of a page in order: references decoded, inner white space one space.

    Comments, scripts, styles and the head are no text. Unclosed and stray tags are
    put up with: an end tag closes down to its element or is ignored, a block ends an
    open paragraph, a list item the one before.
    """
    out: list[tuple[Line, int]] = []
    stack: list[tuple[str, bool, int, bool]] = []  # name, main, mark of furniture, loose, all inherited
    words: list[str] = []
    at = 0
    html = html or ""

    def flush() -> None:
        text = " ".join(unescape("".join(words)).split())
        words.clear()
        if text:
            _, main, mark, loose = stack[-1] if stack else ("", False, _NONE, False)
            block = next((n for n, *_ in reversed(stack) if n in _BLOCK), "")
            out.append((Line(text, main, block in _PROSE, False, loose), mark))

    for tag in _TOKEN.finditer(html):
        if tag.start() > at:
            words.append(html[at : tag.start()])
        at = tag.end()
        if not tag["name"]:
            if tag["raw"] and tag["raw"].lower() == "head":
                flush()
            continue
        name = tag["name"].lower()
        if name == "br":
            words.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if tag["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in _VOID:
            continue
        if name in _BLOCK:
            closes = {"li": "li", "dd": "dd", "dt": "dd", "td": "td", "tr": "tr"}.get(name)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == closes:
                    del stack[k:]
                    break
                if stack[k][0] in _BLOCK:
                    break
        _, main, mark, loose = stack[-1] if stack else ("", False, _NONE, False)
        starts, own, slack = _judge(name, tag["rest"], main)
        if starts and own == _NONE and not main:
            # a name says what surrounds an article only where the page has another one
            if mark == _PART or (mark and mark < _KIND and name == "main"):
                mark = _NONE
            elif mark in (_COMMENT_PART, _WHOLE):
                mark = _HELD
        stack.append((name, main or (starts and own == _NONE), max(mark, own), loose or slack))
    words.append(html[at:])
    flush()
    return _settled(out)
