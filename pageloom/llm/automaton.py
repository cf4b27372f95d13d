"""Regular expressions to minimal automata: parse, subset construction, partition refinement, transition array.

Syntax: literals, ``.``, classes, ``\\d \\w \\s`` and escaped signs, groups, ``|``, ``? * + {m} {m,} {m,n}``. Texts are UTF-8: ``.`` and a
negated class take a whole character of it, whatever its number of bytes; cases are ignored for ASCII letters. A match is leftmost-longest.

All rules are scanned in one pass over the bytes. Where one rule counts a long run, another may begin anywhere within, so an automaton of all rules
would need the product of their counters; rules are joined to one automaton as long as it has at most ``MOST_STATES`` states, and the
automata that result advance side by side.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np

from pageloom.llm.tokens import mix

_SETS = {"d": frozenset(range(48, 58)), "s": frozenset(b" \t\n\r\f\v")}
_SETS["w"] = frozenset([*range(48, 58), *range(65, 91), 95, *range(97, 123)])
_ASCII = frozenset(range(128))
#: Rules share an automaton up to so many states.
MOST_STATES = 20_000
#: Bytes in a chunk of a text, and bytes before it from which its first state is guessed; a wrong guess is run again.
CHUNK, WARM = 4096, 64


def _bytes(low: int, high: int) -> tuple:
    return ("set", frozenset(range(low, high + 1)))


#: A character beyond ASCII.
_WIDE = ("or", [("then", [_bytes(lead, last), *[_bytes(0x80, 0xBF)] * n]) for lead, last, n in ((0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3))])


class _Parser:
    def __init__(self, pattern: str, fold: bool) -> None:
        self.p, self.i, self.fold = pattern, 0, fold

    def more(self) -> bool:
        return self.i < len(self.p)

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def chars(self, found: frozenset, others: frozenset = frozenset()) -> tuple:
        """A class of ASCII characters and of some beyond."""
        if self.fold:
            found = found | {c ^ 32 for c in found if 65 <= c & ~32 <= 90}
        wide = [("then", [_bytes(b, b) for b in c.encode()]) for c in sorted(others)]
        return ("or", [("set", found), *wide]) if wide else ("set", found)

    def either(self) -> tuple:
        options = [self.chain()]
        while self.more() and self.p[self.i] == "|":
            self.take()
            options.append(self.chain())
        return options[0] if len(options) == 1 else ("or", options)

    def chain(self) -> tuple:
        parts = []
        while self.more() and self.p[self.i] not in "|)":
            part = self.atom()
            while self.more() and self.p[self.i] in "?*+{":
                c = self.take()
                if c == "{":
                    to = self.p.index("}", self.i)
                    least, comma, most = self.p[self.i : to].partition(",")
                    self.i = to + 1
                    part = ("times", part, int(least), int(most) if most else (None if comma else int(least)))
                else:
                    part = ("times", part, int(c == "+"), 1 if c == "?" else None)
            parts.append(part)
        return ("then", parts)

    def escape(self) -> frozenset:
        c = self.take()
        return _SETS.get(c) or frozenset({ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))})

    def atom(self) -> tuple:
        c = self.take()
        if c == "(":
            inner = self.either()
            if self.take() != ")":
                raise ValueError(f"unbalanced group in {self.p!r}")
            return inner
        if c == "[":
            negated = self.p[self.i] == "^"
            self.i += negated
            found: set[int] = set()
            while (c := self.take()) != "]":
                low = self.escape() if c == "\\" else frozenset({ord(c)})
                if self.p[self.i] == "-" and self.p[self.i + 1] != "]" and len(low) == 1:
                    self.take()
                    low = frozenset(range(min(low), ord(self.take()) + 1))
                found |= low
            others = {chr(c) for c in found if c > 127}
            if len(others) > 1000 or negated and others:
                raise ValueError(f"too many characters beyond ASCII in a class of {self.p!r}")
            if negated:
                folded = self.chars(frozenset(found))[1]
                return ("or", [("set", _ASCII - folded), _WIDE])
            return self.chars(frozenset(found) & _ASCII, frozenset(others))
        if c == ".":
            return ("or", [("set", _ASCII - {10}), _WIDE])
        if c != "\\" and ord(c) > 127:
            return ("then", [_bytes(b, b) for b in c.encode()])
        return self.chars(self.escape() if c == "\\" else frozenset({ord(c)}))


def parse(pattern: str, fold: bool = False) -> tuple:
    parser = _Parser(pattern, fold)
    tree = parser.either()
    if parser.more():
        raise ValueError(f"unexpected {pattern[parser.i]!r} in {pattern!r}")
    return tree


def _backwards(tree: tuple) -> tuple:
    if tree[0] == "then":
        return ("then", [_backwards(x) for x in reversed(tree[1])])
    if tree[0] == "or":
        return ("or", [_backwards(x) for x in tree[1]])
    return ("times", _backwards(tree[1]), *tree[2:]) if tree[0] == "times" else tree


class _Threads:
    """Thompson's automaton: per state its empty moves and its moves by a set of bytes."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append(None)
        return len(self.free) - 1

    def add(self, tree: tuple, at: int) -> int:
        kind = tree[0]
        if kind == "set":
            self.moves[at] = (tree[1], to := self.state())
            to2 = self.state()
            self.free[to].append(to2)
            return to2
        if kind == "then":
            for part in tree[1]:
                at = self.add(part, at)
            return at
        if kind == "or":
            end = self.state()
            for part in tree[1]:
                self.free[at].append(own := self.state())
                self.free[self.add(part, own)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            at = self.add(part, at)
        end = self.state()
        if most is None:
            self.free[at].append(loop := self.state())
            self.free[loop] += [end, own := self.state()]
            self.free[self.add(part, own)].append(loop)
            return end
        for _ in range(most - least):
            self.free[at] += [end, own := self.state()]
            at = self.add(part, own)
        self.free[at].append(end)
        return end

    def closure(self, states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


@dataclass(frozen=True, eq=False)
class Automaton:
    """Transition array ``next[state * classes + class]`` (states premultiplied), byte classes, and the rules that each state accepts.

    States are ordered so that those from ``accepting`` on accept something.
    """

    next: np.ndarray
    of_byte: np.ndarray
    classes: int
    start: int
    accepting: int
    accepts: tuple[tuple[int, ...], ...]

    @property
    def states(self) -> int:
        return len(self.accepts)


def build(trees: list[tuple], anywhere: bool, first: bool = False, most_states: int = 60_000) -> Automaton:
    """``anywhere``: a match may begin at each byte; else only at the first (a dead state then has no way on). ``first``: behind a
    match it begins anew, which finds whether there is any with far fewer states than it takes to find all."""
    nfa = _Threads()
    root = nfa.state()
    ends = {}
    for rule, tree in enumerate(trees):
        nfa.free[root].append(own := nfa.state())
        ends[nfa.add(tree, own)] = rule
    sets = list({m[0] for m in nfa.moves if m})
    signature: dict[tuple, int] = {}
    of_byte = np.array([signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256)], np.uint8)
    n = len(signature)
    sample = [int(np.flatnonzero(of_byte == c)[0]) for c in range(n)]
    begin = nfa.closure({root})
    number, order, rows = {begin: 0}, [begin], []
    while len(rows) < len(order):
        now, row = order[len(rows)], []
        if first and any(s in ends for s in now):
            now = begin
        for byte in sample:
            to = nfa.closure({m[1] for s in now if (m := nfa.moves[s]) and byte in m[0]} | ({root} if anywhere else set()))
            if first and (met := to & ends.keys()):
                to = frozenset(met)
            if to not in number:
                if len(number) >= most_states:
                    raise ValueError("the rules need too many states")
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
    return _minimal(np.array(rows), of_byte, [tuple(sorted(ends[s] for s in states if s in ends)) for states in order], 0)


def _minimal(table: np.ndarray, of_byte: np.ndarray, accepts: list[tuple[int, ...]], start: int) -> Automaton:
    """Refines states by what they accept, then by where each class leads."""
    n = table.shape[1]
    kinds = {a: i for i, a in enumerate(sorted(set(accepts)))}
    part = np.array([kinds[a] for a in accepts])
    while True:
        code = part.astype(np.uint64)
        for k in range(n):
            code = mix(code * np.uint64(0x9E3779B97F4A7C15) + part[table[:, k]].astype(np.uint64) + np.uint64(1))
        _, refined = np.unique(code, return_inverse=True)
        if refined.max() == part.max():
            break
        part = refined
    _, first = np.unique(part, return_index=True)
    final = [accepts[i] for i in first]
    order = np.array(sorted(range(len(first)), key=lambda p: (final[p] != (), p)))
    new = np.empty(len(order), np.int64)
    new[order] = np.arange(len(order))
    moves = (new[part[table[first[order]]]] * n).astype(np.int32)
    final = tuple(final[p] for p in order)
    return Automaton(moves.reshape(-1), of_byte, n, int(new[part[start]]) * n, sum(a == () for a in final) * n, final)


def joined(one: Automaton, two: Automaton, most_states: int) -> Automaton | None:
    """The automaton that runs both, with the rules of either; None where it needs more than ``most_states``."""
    pairs = one.of_byte.astype(np.int64) * two.classes + two.of_byte
    names, of_byte = np.unique(pairs, return_inverse=True)
    x = one.next.reshape(-1, one.classes)[:, names // two.classes] // one.classes
    y = two.next.reshape(-1, two.classes)[:, names % two.classes] // two.classes
    begin = np.array([one.start // one.classes * two.states + two.start // two.classes])
    known, new, at = begin, begin, []
    while len(new):
        to = x[new // two.states].astype(np.int64) * two.states + y[new % two.states]
        at.append((new, to))
        new = np.setdiff1d(to.reshape(-1), known)
        known = np.union1d(known, new)
        if len(known) > most_states:  # products of minimal automata hardly shrink
            return None
    table = np.empty((len(known), len(names)), np.int64)
    for states, to in at:
        table[np.searchsorted(known, states)] = np.searchsorted(known, to)
    accepts = [tuple(sorted(one.accepts[k // two.states] + two.accepts[k % two.states])) for k in known.tolist()]
    out = _minimal(table, of_byte.astype(np.uint8), accepts, int(np.searchsorted(known, begin[0])))
    return out if out.states <= most_states else None


@lru_cache(maxsize=8)
def scanner(rules: tuple[tuple[str, str, bool], ...], most_states: int = MOST_STATES) -> tuple[tuple[Automaton, ...], tuple[Automaton, ...], tuple[Automaton, ...]]:
    """For rules (name, pattern, ignore case): the automata that find all of them in one pass; per rule the one that reads backwards and
    accepts where a match begins, and the one that accepts where a match from the first byte on ends."""
    trees = [parse(p, fold) for _, p, fold in rules]
    machines: list[Automaton] = []
    own = [replace(m := build([t], True, True), accepts=tuple((i,) if a else () for a in m.accepts)) for i, t in enumerate(trees)]
    for machine in sorted(own, key=lambda m: m.states):
        for k, other in enumerate(machines):
            if both := joined(other, machine, most_states):
                machines[k] = both
                break
        else:
            machines.append(machine)
    return tuple(machines), tuple(build([_backwards(t)], True) for t in trees), tuple(build([t], False) for t in trees)


def _run(machine: Automaton, classes: np.ndarray, at: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Advances all chunks together. Gives each one's last state, and (chunk, state) wherever one enters an accepting state."""
    order = np.argsort(-size, kind="stable")
    by_size = size[order]
    a, s = at[order].copy(), state[order].astype(np.int32)
    who, states, done = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], 0
    if (entered := s >= machine.accepting).any():  # so that a state that is kept counts in its chunk too
        who.append(order[entered])
        states.append(s[entered])
    for until in np.unique(size).tolist():
        active = int(np.searchsorted(-by_size, -until, "right"))
        x, y = a[:active], s[:active]
        for _ in range(until - done):
            to = np.take(machine.next, y + classes[x])
            x += 1
            if (found := to >= machine.accepting).any():
                found = np.flatnonzero(found & (to != y))
                if len(found):
                    who.append(order[found])
                    states.append(to[found])
            y = to
        s[:active] = y
        done = until
    last = np.empty_like(s)
    last[order] = s
    return last, np.concatenate(who), np.concatenate(states)


def hits(machine: Automaton, data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK, warm: int = WARM) -> set[tuple[int, int]]:
    """(text, rule) of all that occurs. One pass: all chunks of all texts advance byte by byte together."""
    classes = machine.of_byte[data].astype(np.int32)
    sizes = np.diff(offsets)
    count = -(-sizes // chunk)
    text = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[:-1][text] + number * chunk
    size = np.minimum(chunk, offsets[1:][text] - at)
    state = np.full(len(text), machine.start, np.int32)
    later = np.flatnonzero(number > 0)
    if len(later):
        near = min(warm, chunk)
        state[later] = _run(machine, classes, at[later] - near, np.full(len(later), near), state[later])[0]
    todo, last = np.arange(len(text)), np.empty(len(text), np.int32)
    who, states = np.zeros(0, np.int64), np.zeros(0, np.int32)
    while len(todo):
        last[todo], w, s = _run(machine, classes, at[todo], size[todo], state[todo])
        kept = ~np.isin(who, todo)
        who, states = np.concatenate([who[kept], todo[w]]), np.concatenate([states[kept], s])
        todo = later[state[later] != last[later - 1]]
        state[todo] = last[todo - 1]
    found = np.unique(text[who] * (machine.states + 1) + states // machine.classes)
    return {(int(f // (machine.states + 1)), rule) for f in found for rule in machine.accepts[f % (machine.states + 1)]}


def walk(machine: Automaton, data: np.ndarray, at: int, to: int) -> list[int]:
    """The places where the automaton accepts on its way from ``at`` to ``to`` (backwards where ``to`` is less), nearest first."""
    n = machine.classes
    classes = machine.of_byte[data[at:to] if to >= at else data[to:at][::-1]].tobytes()
    rows, limit = _rows(machine)
    found, s, ahead = [], machine.start // n, 1 if to >= at else -1
    for p, c in enumerate(classes, 1):
        s = rows[s][c]
        if s >= limit:
            found.append(at + ahead * p)
        elif rows[s] is None:
            break  # nothing can follow
    return found


def last_end(machine: Automaton, data: np.ndarray, at: int, to: int) -> int | None:
    """Where the longest match from ``at`` on ends; ``data`` is read a piece at a time, as far as a match can go."""
    rows, limit = _rows(machine)
    found, s, width = None, machine.start // machine.classes, 256
    while at < to:
        for p, c in enumerate(machine.of_byte[data[at : min(to, at + width)]].tobytes(), at + 1):
            s = rows[s][c]
            if s >= limit:
                found = p
            elif rows[s] is None:
                return found
        at, width = at + width, 4 * width
    return found


@lru_cache(maxsize=64)
def _rows_of(next_: bytes, classes: int) -> list[list[int] | None]:
    rows = (np.frombuffer(next_, np.int32).reshape(-1, classes) // classes).tolist()
    return [None if all(x == i for x in row) else row for i, row in enumerate(rows)]


_KEPT: dict[int, tuple] = {}


def _rows(machine: Automaton) -> tuple[list[list[int] | None], int]:
    """Transitions as lists (None: no way on), and the first accepting state."""
    kept = _KEPT.get(id(machine))
    if kept is None or kept[0] is not machine:
        kept = _KEPT[id(machine)] = (machine, _rows_of(machine.next.tobytes(), machine.classes), machine.accepting // machine.classes)
    return kept[1], kept[2]
