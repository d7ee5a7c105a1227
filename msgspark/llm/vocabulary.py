"""A piece vocabulary read as a unigram model, and the texts' split into independent parts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import ahocorasick

SPACE = "▁"
#: Fixed value of the tokenizer: what an unknown character costs below the least score.
UNKNOWN_PENALTY = 10.0
#: Distinct parts that a task remembers before it starts afresh.
MOST_REMEMBERED = 300_000
MOST_REMEMBERED_CHARACTERS = 4 << 20


@dataclass(frozen=True, eq=False)
class Vocabulary:
    """Pieces with scores; ids are positions. Bytes stand in for unknown characters.

    A text is read with a space mark in front and space marks for spaces. The score of
    a segmentation is the sum of its pieces' scores in 64-bit arithmetic, the best is
    the greatest. Of equal segmentations the one whose last differing piece, seen from
    the end, starts earlier wins. A character without a piece of its own may be taken
    as unknown, for the least score minus ``UNKNOWN_PENALTY``.
    """

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: frozenset[int]
    byte_ids: tuple[int, ...]

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read a model file of the sentencepiece library; done once, on the driver."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = tuple(model.id_to_piece(i) for i in ids)
        by_name = {p: i for i, p in enumerate(pieces)}
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        return Vocabulary(
            pieces,
            tuple(model.get_score(i) for i in ids),
            frozenset(set(ids) - special),
            tuple(by_name[f"<0x{b:02X}>"] for b in range(256)),
        )

    def __getstate__(self):
        return self.pieces, self.scores, self.normal, self.byte_ids

    def __setstate__(self, state):
        for name, value in zip(("pieces", "scores", "normal", "byte_ids"), state, strict=True):
            object.__setattr__(self, name, value)

    @cached_property
    def matches(self) -> ahocorasick.Automaton:
        """All pieces that end at a position, the longest first: (length, score, id)."""
        out = ahocorasick.Automaton()
        for i in self.normal:
            out.add_word(self.pieces[i], (len(self.pieces[i]), self.scores[i], i))
        out.make_automaton()
        return out

    @cached_property
    def digest(self) -> bytes:
        """What tells vocabularies apart, whichever copy it is."""
        return hashlib.sha256(repr((self.pieces, self.scores, sorted(self.normal), self.byte_ids)).encode()).digest()

    @cached_property
    def unknown(self) -> float:
        return min(self.scores[i] for i in self.normal) - UNKNOWN_PENALTY

    @cached_property
    def single(self) -> frozenset[str]:
        return frozenset(self.pieces[i] for i in self.normal if len(self.pieces[i]) == 1)

    @cached_property
    def parts(self) -> Callable[[str], list[str]]:
        """Cuts a marked text where no piece can cross: before a space mark that follows
        another character, and around characters that no piece contains. Best
        segmentations of the parts make up the best one of the text.
        """
        known = {c for i in self.normal for c in self.pieces[i]} - {SPACE}
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in self.normal):
            return re.compile(r"(?s).+").findall  # pieces cross words: no cut is safe
        inside = "".join(map(re.escape, sorted(known)))
        return re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{SPACE}{inside}]").findall

    def byte_pieces(self, text: str) -> list[int]:
        return [self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")]


def marked(text: str | None) -> str:
    """The text as the pieces see it; a null or empty one has no pieces."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Remembered(dict):
    """A bounded memory of a function of text parts."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make = make

    def __missing__(self, part: str):
        if len(self) >= MOST_REMEMBERED:
            self.clear()
        value = self.make(part) if len(part) <= 4096 else None
        if value is None:  # long parts are not kept
            return self.make(part)
        self[part] = value
        return value
