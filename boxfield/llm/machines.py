"""Weighted finite-state transducers over the tropical semiring.

A machine has numbered states, a start, final states and arcs (input, output,
weight, next state).  Weights are costs: along a path they add up, and of several
paths the least counts.  ``None`` as input or output reads or writes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Iterable
from dataclasses import dataclass, field

Symbol = Hashable


@dataclass
class Machine:
    start: int = 0
    finals: dict[int, float] = field(default_factory=dict)
    arcs: list[dict[Symbol, list[tuple[Symbol, float, int]]]] = field(default_factory=list)

    def state(self) -> int:
        self.arcs.append({})
        return len(self.arcs) - 1

    def add(self, state: int, read: Symbol, write: Symbol, weight: float, to: int) -> None:
        if weight < math.inf:
            self.arcs[state].setdefault(read, []).append((write, weight, to))


def compiled(start: Hashable, step, symbols: Iterable[Symbol], final) -> Machine:
    """The machine whose states are what ``step(state, symbol)`` -> [(output, weight, state)] reaches from ``start``.

    ``final(state)`` is a state's final weight, infinite where a path must not end.
    """
    symbols = list(symbols)
    out = Machine()
    number = {start: out.state()}
    left = [start]
    while left:
        at = left.pop()
        if (w := final(at)) < math.inf:
            out.finals[number[at]] = w
        for x in symbols:
            for write, weight, to in step(at, x):
                if to not in number:
                    number[to] = out.state()
                    left.append(to)
                out.add(number[at], x, write, weight, number[to])
    return out


def compose(a: Machine, b: Machine) -> Machine:
    """The machine that hands what ``a`` writes to ``b``; only pairs of states that can be reached are made."""
    out = Machine()
    number = {(a.start, b.start): out.state()}
    left = [(a.start, b.start)]

    def to(pair: tuple[int, int]) -> int:
        if pair not in number:
            number[pair] = out.state()
            left.append(pair)
        return number[pair]

    while left:
        p, q = pair = left.pop()
        here = number[pair]
        if p in a.finals and q in b.finals:
            out.finals[here] = a.finals[p] + b.finals[q]
        for read, arcs in a.arcs[p].items():
            for mid, w, p2 in arcs:
                if mid is None:
                    out.add(here, read, None, w, to((p2, q)))
                    continue
                for write, v, q2 in b.arcs[q].get(mid, ()):
                    out.add(here, read, write, w + v, to((p2, q2)))
        for write, v, q2 in b.arcs[q].get(None, ()):
            out.add(here, None, write, v, to((p, q2)))
    return out


def trimmed(m: Machine) -> Machine:
    """Without states from which no final state can be reached."""
    back: dict[int, set[int]] = {}
    for s, arcs in enumerate(m.arcs):
        for found in arcs.values():
            for _, _, t in found:
                back.setdefault(t, set()).add(s)
    alive, left = set(m.finals), list(m.finals)
    while left:
        for s in back.get(left.pop(), ()):
            if s not in alive:
                alive.add(s)
                left.append(s)
    arcs = [{x: kept for x, found in a.items() if (kept := [r for r in found if r[2] in alive])} if s in alive else {} for s, a in enumerate(m.arcs)]
    return Machine(m.start, dict(m.finals), arcs)


def shortest(m: Machine, tape: list[list[tuple[Symbol, float]]]) -> tuple[float, list[Symbol]]:
    """(cost, what is written) of the lightest path over an input of alternatives (symbol, weight) at each place.

    Relaxes the composition of the input with ``m`` place by place.  Infinite cost
    where there is no path; of equal paths the one that was found first.
    """
    front: dict[int, tuple[float, tuple | None]] = {m.start: (0.0, None)}
    for k in range(len(tape) + 1):
        agenda = list(front)
        while agenda:  # arcs that read nothing
            s = agenda.pop()
            for write, w, t in m.arcs[s].get(None, ()):
                c = front[s][0] + w
                if c < front.get(t, (math.inf,))[0]:
                    front[t] = (c, front[s][1] if write is None else (write, front[s][1]))
                    agenda.append(t)
        if k == len(tape):
            break
        after: dict[int, tuple[float, tuple | None]] = {}
        for s, (c, path) in front.items():
            arcs = m.arcs[s]
            for x, own in tape[k]:
                for write, w, t in arcs.get(x, ()):
                    total = c + own + w
                    if t not in after or total < after[t][0]:
                        after[t] = (total, path if write is None else (write, path))
        front = after
    best, path = math.inf, None
    for s, (c, p) in front.items():
        if s in m.finals and c + m.finals[s] < best:
            best, path = c + m.finals[s], p
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return best, out[::-1]


def every_path(m: Machine, tape: list[list[tuple[Symbol, float]]]) -> list[tuple[float, tuple]]:
    """(cost, written) of every path, by walking them all; for tests on small inputs of machines without arcs that read nothing."""
    paths = [(0.0, (), m.start)]
    for place in tape:
        paths = [(c + own + w, out if write is None else (*out, write), t) for c, out, s in paths for x, own in place for write, w, t in m.arcs[s].get(x, ())]
    return [(c + m.finals[s], out) for c, out, s in paths if s in m.finals]
