"""SentencePiece models of the merge kind: parsing, normalising and merging.

Supports what such models state: identity normalisation, dummy prefix, escaped
white space, normal pieces and byte fallback.  Anything else (unigram scores are
kept for wfst.py; character maps, user-defined pieces) is refused, not guessed.
"""

from __future__ import annotations

import heapq
import math
import re
from functools import cached_property

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SHORT = 40


def fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, data[at : at + size]
        at += size


class PieceModel:
    """Vocabulary and normaliser settings of a serialised model."""

    def __init__(self, data: bytes) -> None:
        import struct

        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.dummy_prefix, self.squeeze, self.escape, self.fallback = UNIGRAM, True, True, True, False
        self.unk_surface = " ⁇ "
        for number, value in fields(data):
            if number == 1:
                p = dict(fields(value))
                self.pieces.append(p[1].decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.kinds.append(p.get(3, NORMAL))
            elif number == 2:
                t = dict(fields(value))
                self.kind, self.fallback = t.get(3, UNIGRAM), bool(t.get(35, 0))
                self.unk_surface = t.get(44, self.unk_surface.encode()).decode()
            elif number == 3:
                n = dict(fields(value))
                self.dummy_prefix, self.squeeze, self.escape = bool(n.get(3, 1)), bool(n.get(4, 1)), bool(n.get(5, 1))
                if n.get(2):
                    raise ValueError("models with a normalisation map are not supported")
        if USER in self.kinds or UNUSED in self.kinds or not self.fallback or self.squeeze or not self.escape:
            raise ValueError("this model's settings are not supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.rank = {p: -self.scores[i] for p, i in self.ids.items()}
        self.byte_ids = [0] * 256
        for i, k in enumerate(self.kinds):
            if k == BYTE:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has white space behind another character, so texts can't be cut there")

    def normalised(self, text: str) -> str:
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def merge(self, text: str) -> list[str]:
        """Pieces of a normalised text: the best-ranked neighbours are joined first, the leftmost of equals."""
        if len(text) > SHORT:
            return self._merge_long(text)
        parts, get, none = list(text), self.rank.get, math.inf
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) is not none:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], none)
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], none)
        return parts

    def _merge_long(self, text: str) -> list[str]:
        """The same with a heap, for texts of any length."""
        parts: list[str | None] = list(text)
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, heap = self.rank, []

        def offer(i):
            j = after[i]
            if j >= 0 and (r := rank.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) < 0 or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def to_ids(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in p.encode()]
        return out

    @cached_property
    def whole(self) -> frozenset[str]:
        """Vocabulary strings that merge into just themselves, shown by merging each."""
        return frozenset(p for p in self.ids if self.merge(p) == [p])


RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Segments(dict):
    """Value of each stretch of text between two spaces, the space before it included.

    No piece has a space behind another character, so nothing merges across the
    start of a run of spaces, and the parts of a text are encoded one by one.
    The value is ``solve(normalised part)``; values join by ``join``.  Line ends
    are no part of a larger piece either and cut a part further.  ``fixed`` holds
    values that always stay; others are dropped together at ``limit`` entries.
    """

    def __init__(self, model: PieceModel, solve, join, fixed=(), limit: int = 1_000_000, normalise=None) -> None:
        super().__init__()
        self.model, self.solve, self.join, self.limit = model, solve, join, limit
        self.normalise = normalise or model.normalised
        self.bare: dict = {}
        self.fixed = dict(fixed)
        self.update(self.fixed)
        self.cut = "\n" if not any("\n" in p for p in model.ids) else None
        self.line = solve("\n") if self.cut else None

    def __missing__(self, part: str):
        if self.cut and self.cut in part:
            head, *rest = part.split(self.cut)
            out = [self[head]]
            for x in rest:
                out.append(self.line)
                if x:
                    out.append(self._bare(x))
            return self.join(out)
        value = self.solve(SPACE + part)
        if len(part) <= 64:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.fixed)
            self[part] = value
        return value

    def _bare(self, part: str):
        value = self.bare.get(part)
        if value is None:
            value = self.solve(part)
            if len(part) <= 64:
                if len(self.bare) >= self.limit // 4:
                    self.bare.clear()
                self.bare[part] = value
        return value

    def values_of(self, text: str) -> list:
        """Values of the parts of a text, in order."""
        if not text:
            return []
        norm = self.normalise(text)
        parts = norm.split(SPACE)
        if norm[0] == SPACE and "" not in parts[1:]:
            return list(map(self.__getitem__, parts[1:]))
        return [self[x[1:]] if x[0] == SPACE else self._bare(x) for x in RUNS.findall(norm)]
