"""Forward and backward Viterbi scores of many text parts at once."""

from __future__ import annotations

from collections import defaultdict
from itertools import count, islice

import numpy as np

from .arrays import U, mix, ragged
from .vocabulary import MOST_REMEMBERED, MOST_REMEMBERED_CHARACTERS, Vocabulary

#: Parts of one length that are scored together.
GROUP = 20_000
_BASE = U(0x9E3779B97F4A7C15)


class PieceTable:
    """Finds pieces, and strings that pieces begin with, by a fingerprint of their characters."""

    def __init__(self, vocabulary: Vocabulary):
        ids = sorted(vocabulary.normal)
        pieces = [vocabulary.pieces[i] for i in ids]
        known: dict[str, int] = {}
        for p in pieces:
            for k in range(1, len(p) + 1):
                known.setdefault(p[:k], -1)
        known |= {p: k for k, p in enumerate(pieces)}
        prints = self.fingerprints(list(known))
        own = np.array(list(known.values()), dtype=np.int64)
        order = np.argsort(prints)
        self.prints, own = np.append(prints[order], U(0)), own[order]  # a stop after the last
        self.piece = own >= 0
        self.ids = np.where(self.piece, np.array([*ids, -1], dtype=np.int32)[own], -1).astype(np.int32)
        self.scores = np.array([*(vocabulary.scores[i] for i in ids), -np.inf])[own]
        top = (self.prints[:-1] >> U(44)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << 20) + 1)).astype(np.int32)
        self.depth = int(np.diff(self.first).max(initial=0))

    @staticmethod
    def step(before: np.ndarray, points: np.ndarray) -> np.ndarray:
        return mix(before * _BASE + points.astype(U))

    def fingerprints(self, strings: list[str]) -> np.ndarray:
        out = np.zeros(len(strings), dtype=U)
        live = np.arange(len(strings))
        for k in range(max(map(len, strings), default=0)):
            live = live[[len(strings[i]) > k for i in live.tolist()]]
            out[live] = self.step(out[live], np.array([ord(strings[i][k]) for i in live.tolist()]))
        return out

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the strings begin a piece, and their places in the table."""
        top = (prints >> U(44)).astype(np.int64)
        place, stop = self.first[top], self.first[top + 1]
        at = np.flatnonzero(place < stop)  # most strings are ruled out here
        place, stop, prints = place[at], stop[at], prints[at]
        for _ in range(self.depth - 1):
            place = place + ((self.prints[place] < prints) & (place + 1 < stop))
        hit = self.prints[place] == prints
        return at[hit], place[hit]


_LAST: dict[bytes, PieceTable] = {}


def _table(vocabulary: Vocabulary) -> PieceTable:
    """The table of the vocabulary, known by its content: every task gets a copy of its own
    of the vocabulary, and a worker keeps one table for all of them."""
    if vocabulary.digest not in _LAST:
        _LAST.clear()
        _LAST[vocabulary.digest] = PieceTable(vocabulary)
    return _LAST[vocabulary.digest]


class Segments:
    """Best segmentation of every part: score, loss of the second best, ids.

    ``ids`` of part k are ``flat[bounds[k] : bounds[k + 1]]``. The second best of a part
    is the best way over any piece that is not on the best path; its loss is infinite
    where there is no other way, and not asked for unless ``second``.
    """

    def __init__(self, vocabulary: Vocabulary, parts: list[str], second: bool = True):
        self.score = np.zeros(len(parts))
        self.loss = np.full(len(parts), np.inf)
        counts = np.zeros(len(parts), dtype=np.int64)
        begin = np.zeros(len(parts), dtype=np.int64)
        flats, total = [], 0
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            length = int(sizes[order[a]])
            most = max(1, GROUP * 8 // (length * min(length, 16)))
            for c in range(a, b, most):
                own = order[c : min(c + most, b)]
                flat, who = self._group(vocabulary, [parts[k] for k in own.tolist()], own, length, second)
                counts[own] = np.bincount(who, minlength=len(own))
                begin[own] = total + np.searchsorted(who, np.arange(len(own)))
                total += len(flat)
                flats.append(flat)
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        self.flat = np.concatenate(flats)[ragged(begin, counts)] if flats else np.empty(0, np.int32)

    def _group(
        self, vocabulary: Vocabulary, parts: list[str], own: np.ndarray, n: int, second: bool
    ) -> tuple[np.ndarray, np.ndarray]:
        """Scores the parts of one length; their ids end to end, and whose each is."""
        table = _table(vocabulary)
        u = len(parts)
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = np.ascontiguousarray(points.reshape(u, n).T)
        # by their end: (start, which parts, score, id), pieces and then unknown characters
        ends: list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(n + 1)]
        for s in range(n):
            live, prints = np.arange(u), np.zeros(u, dtype=U)
            for e in range(s + 1, n + 1):
                prints = table.step(prints, points[e - 1, live])
                at, place = table.find(prints)
                live, prints = live[at], prints[at]
                whole = table.piece[place]
                at, place = live[whole], place[whole]
                score, ids = table.scores[place], table.ids[place]
                if e == s + 1 and len(at) < u:
                    lonely = np.ones(u, dtype=bool)
                    lonely[at] = False
                    none = np.flatnonzero(lonely)
                    at = np.concatenate([at, none])
                    score = np.concatenate([score, np.full(len(none), vocabulary.unknown)])
                    ids = np.concatenate([ids, np.full(len(none), -1, dtype=np.int32)])
                if len(at):
                    ends[e].append((s, at, score, ids))
                if not len(live):
                    break
        ahead = np.full((n + 1, u), -np.inf)
        ahead[0] = 0
        came = np.zeros((n + 1, u), dtype=np.int32)
        piece = np.full((n + 1, u), -1, dtype=np.int32)
        for e in range(1, n + 1):
            for s, at, score, ids in ends[e]:  # earlier starts first: they win ties
                score = ahead[s, at] + score
                better = score > ahead[e, at]
                at = at[better]
                ahead[e, at], came[e, at], piece[e, at] = score[better], s, ids[better]
        on_path = np.zeros((n + 1, u), dtype=bool)
        on_path[n] = True
        for e in range(n, 0, -1):
            live = np.flatnonzero(on_path[e])
            on_path[came[e, live], live] = True
        self.score[own] = ahead[n]
        if second:
            back = np.full((n + 1, u), -np.inf)
            back[n] = 0
            other = np.full(u, -np.inf)
            for e in range(n, 0, -1):
                for s, at, score, _ in ends[e]:
                    rest = back[e, at] + score
                    back[s, at] = np.maximum(back[s, at], rest)
                    best = on_path[e, at] & (came[e, at] == s)
                    if not best.all():
                        at, rest = at[~best], rest[~best]
                        other[at] = np.maximum(other[at], ahead[s, at] + rest)
            self.loss[own] = ahead[n] - other
        who, where = np.nonzero(on_path[1:].T)  # part by part, its pieces in order
        ids = piece[1:][where, who]
        unknown = np.flatnonzero(ids < 0)
        if not len(unknown):
            return ids, who
        spelt = [vocabulary.byte_pieces(parts[who[k]][where[k]]) for k in unknown.tolist()]
        each = np.ones(len(ids), dtype=np.int64)
        each[unknown] = [len(x) for x in spelt]
        first = np.cumsum(each) - each
        out = np.repeat(ids, each)
        for k, x in zip(first[unknown].tolist(), spelt, strict=True):
            out[k : k + len(x)] = x
        return out, np.repeat(who, each)


class Lexicon:
    """Remembers the segmentations of the parts met so far, up to a number of parts and of characters."""

    def __init__(self, vocabulary: Vocabulary, second: bool):
        self.vocabulary, self.second = vocabulary, second
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = defaultdict(count().__next__)  # numbered as they come
        self.characters = 0
        self.known: dict[int, object] = {}
        self.score, self.loss, self.flat = np.empty(0), np.empty(0), np.empty(0, np.int32)
        self.bounds = np.zeros(1, dtype=np.int64)

    def read(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Numbers of the parts of every text; new parts are scored together."""
        if len(self.index) > MOST_REMEMBERED or self.characters > MOST_REMEMBERED_CHARACTERS:
            self.clear()
        index, old = self.index, len(self.index)
        number = index.__getitem__
        codes = [np.fromiter(map(number, parts), dtype=np.int64, count=len(parts)) for parts in texts]
        if len(index) > old:
            parts = list(islice(index, old, None))
            self.characters += sum(map(len, parts))
            new = Segments(self.vocabulary, parts, self.second)
            self.score = np.concatenate([self.score, new.score])
            self.loss = np.concatenate([self.loss, new.loss])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + new.bounds[1:]])
            self.flat = np.concatenate([self.flat, new.flat])
        return codes
