"""Byte automata from regular expressions: parse, subset construction, minimisation, transition arrays.

The dialect: literals, escapes (\\xNN and escaped punctuation), classes, groups, alternation, ?, *, +, {m}, {m,},
{m,n}. Patterns are over bytes; `fold` lets letters match in either case.

`starts` reads every byte of many texts once, from right to left, and tells where matches of which rules begin. Texts
are cut into lanes that advance together, a byte of each lane at a time. A lane cannot know in which state the one to
its right ends, so it first reads the last WARM bytes of that one; where that was not enough, its bytes are read again
from the right state until both runs agree, which for rules without long gaps is at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of a lane, and bytes that it reads in advance.
LANE = 512
WARM = 24


@dataclass
class _Nfa:
    """Transitions by state: lists of (bytes as a 256-bit mask, target), and empty moves."""

    moves: list[list[tuple[int, int]]]
    empty: list[list[int]]

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1


class _Parser:
    def __init__(self, nfa: _Nfa, pattern: str, fold: bool) -> None:
        self.nfa, self.p, self.i, self.fold = nfa, pattern, 0, fold

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def next(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    # Each method returns a tree: ("set", mask), ("cat", [...]), ("alt", [...]), ("rep", tree, least, most or None).
    def alternation(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.next()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        tree = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.next()
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                tree = ("rep", tree, int(low), int(high) if high else None if comma else int(low))
            else:
                tree = ("rep", tree, int(c == "+"), 1 if c == "?" else None)
        return tree

    def atom(self):
        c = self.next()
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            tree = self.alternation()
            if self.next() != ")":
                raise ValueError(f"unclosed group in {self.p}")
            return tree
        if c == "[":
            return ("set", self.members())
        return ("set", self.folded(1 << self.code(c)))

    def code(self, c: str) -> int:
        if c != "\\":
            return ord(c)
        c = self.next()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "r": 13, "t": 9}.get(c, ord(c))

    def members(self) -> int:
        mask, invert = 0, self.peek() == "^"
        if invert:
            self.next()
        while self.peek() != "]":
            low = self.code(self.next())
            high = low
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.next()
                high = self.code(self.next())
            mask |= sum(1 << b for b in range(low, high + 1))
        self.next()
        mask = self.folded(mask)
        return mask ^ ((1 << 256) - 1) if invert else mask

    def folded(self, mask: int) -> int:
        if self.fold:
            upper, lower = sum(1 << b for b in range(65, 91)), sum(1 << b for b in range(97, 123))
            mask |= (mask & upper) << 32 | (mask & lower) >> 32
        return mask


def _build(nfa: _Nfa, tree, start: int) -> int:
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.moves[start].append((tree[1], end))
        return end
    if kind == "cat":
        for t in tree[1]:
            start = _build(nfa, t, start)
        return start
    if kind == "alt":
        end = nfa.state()
        for t in tree[1]:
            begin = nfa.state()
            nfa.empty[start].append(begin)
            nfa.empty[_build(nfa, t, begin)].append(end)
        return end
    _, inner, least, most = tree
    for _ in range(least):
        start = _build(nfa, inner, start)
    if most is None:
        loop = nfa.state()
        nfa.empty[start].append(loop)
        nfa.empty[_build(nfa, inner, loop)].append(loop)
        return loop
    end = nfa.state()
    nfa.empty[start].append(end)
    for _ in range(most - least):
        start = _build(nfa, inner, start)
        nfa.empty[start].append(end)
    return end


@dataclass(frozen=True)
class Automaton:
    """classes[byte] is a byte's class; table[state * width + class] the next state times width; accepts[state * width] has a bit for each rule. State 0 is dead, `start` (times width) begins."""

    classes: np.ndarray
    width: int
    table: np.ndarray
    accepts: np.ndarray
    start: int


def _turned(tree):
    """The tree of the same texts read from right to left."""
    if tree[0] == "cat":
        return ("cat", [_turned(t) for t in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [_turned(t) for t in tree[1]])
    return ("rep", _turned(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


def compile_rules(rules: list[tuple[str, bool]], anywhere: bool, backward: bool = False) -> Automaton:
    """One automaton for all (pattern, fold). anywhere: a match may begin at any byte. backward: texts are read from right to left."""
    nfa = _Nfa([], [])
    first = nfa.state()
    final: dict[int, int] = {}
    for k, (pattern, fold) in enumerate(rules):
        begin = nfa.state()
        nfa.empty[first].append(begin)
        tree = _Parser(nfa, pattern, fold).alternation()
        final[_build(nfa, _turned(tree) if backward else tree, begin)] = 1 << k
    closures = []
    for s in range(len(nfa.moves)):
        seen, todo = {s}, [s]
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        closures.append(frozenset(seen))
    # Bytes that no rule tells apart share a class.
    masks = sorted({m for moves in nfa.moves for m, _ in moves})
    kinds: dict[tuple, int] = {}
    byte_class = [kinds.setdefault(tuple(m >> b & 1 for m in masks), len(kinds)) for b in range(256)]
    sample = [byte_class.index(c) for c in range(len(kinds))]
    by_class = [[[closures[t] for m, t in nfa.moves[s] if m >> b & 1] for b in sample] for s in range(len(nfa.moves))]
    begin = closures[first]
    ids: dict[frozenset, int] = {frozenset(): 0, begin: 1}
    order, rows, accepts = [frozenset(), begin], [], []
    for states in order:
        mask = 0
        for s in states:
            mask |= final.get(s, 0)
        accepts.append(mask)
        row = []
        for c in range(len(sample)):
            target = set(begin) if anywhere else set()
            for s in states:
                for t in by_class[s][c]:
                    target |= t
            key = frozenset(target)
            if key not in ids:
                ids[key] = len(order)
                order.append(key)
            row.append(ids[key])
        rows.append(row)
    return _minimal(np.array(rows), np.array(accepts), byte_class)


def _minimal(rows: np.ndarray, accepts: np.ndarray, byte_class: list[int]) -> Automaton:
    """Moore's partition refinement: states are one when they accept alike and lead to states that are one."""
    block = np.unique(accepts, return_inverse=True)[1]
    count = 0
    while True:
        signature = np.concatenate([block[:, None], block[rows]], 1)
        _, first, new = np.unique(signature, axis=0, return_index=True, return_inverse=True)
        block = new.reshape(-1)
        if len(first) == count:
            break
        count = len(first)
    # The dead state comes first.
    names = np.argsort(np.argsort(np.where(np.arange(count) == block[0], -1, first)))
    block = names[block]
    first = np.zeros(count, int)
    first[block[::-1]] = np.arange(len(block))[::-1]
    small = block[rows[first]]
    width = small.shape[1]
    return Automaton(np.array(byte_class, np.uint8), width, np.ascontiguousarray(small.reshape(-1) * width).astype(np.int64), np.repeat(accepts[first], width).astype(np.uint8 if accepts.max() < 256 else np.int64), int(block[1]) * width)


def longest(automaton: Automaton, lists: tuple[list[int], list[int], list[int]], text: bytes, at: int) -> int:
    """Where the longest match that begins at `at` ends; `at` without one. lists: classes, table and accepts as lists."""
    classes, table, accepts = lists
    state, end = automaton.start, at
    for i in range(at, len(text)):
        state = table[state + classes[text[i]]]
        if not state:
            break
        if accepts[state]:
            end = i + 1
    return end


def starts(automaton: Automaton, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in raw, ascending, where matches begin, and the rules (as bits) that begin there. The automaton reads backward and anywhere; raw has texts from offsets[k] to offsets[k + 1]."""
    lengths = np.diff(offsets)
    per = -(-lengths // LANE)
    text = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)  # from the right
    stop = offsets[1:][text] - nth * LANE
    size = np.minimum(stop - offsets[:-1][text], LANE)
    order = np.argsort(-size, kind="stable")
    text, nth, stop, size = text[order], nth[order], stop[order], size[order]
    lane_of = np.empty(len(order), np.int64)  # by order in the text
    lane_of[order] = np.arange(len(order))
    n = len(order)
    table, state = automaton.table, np.full(n, automaton.start, np.int64)
    late = np.flatnonzero(nth > 0)
    warm = np.full(len(late), automaton.start, np.int64)
    for i in range(WARM):
        warm = table[warm + automaton.classes[raw[stop[late] + (WARM - 1 - i)]]]
    state[late] = warm
    begun = state.copy()
    steps = int(size[0]) if n else 0
    read = np.empty((steps, n), np.uint8)
    for i in range(0, n, 4096):
        at = stop[i : i + 4096] - 1 - np.arange(steps)[:, None]
        read[:, i : i + 4096] = automaton.classes[raw[np.maximum(at, 0)]]
    seen = np.zeros((steps, n), np.uint16 if len(table) < 1 << 16 else np.int32)
    alive = np.searchsorted(-size, -np.arange(steps), "left")  # lanes longer than i
    for i, k in enumerate(alive.tolist()):
        s = state[:k]
        np.take(table, s + read[i, :k], out=s)
        seen[i, :k] = s
    # Where a lane began in another state than the one to its right has ended in, it is read again from there.
    place = np.flatnonzero(nth[lane_of] > 0)
    right = lane_of[place - 1]
    wrong = seen[LANE - 1, right] != begun[lane_of[place]] if len(place) else np.zeros(0, bool)
    k = 0
    wrong_places = place[wrong].tolist()
    while k < len(wrong_places):
        p = wrong_places[k]
        k += 1
        lane = int(lane_of[p])
        s = int(seen[LANE - 1, lane_of[p - 1]])
        for i in range(int(size[lane])):
            s = int(table[s + int(read[i, lane])])
            if s == seen[i, lane]:
                break
            seen[i, lane] = s
        else:
            # Its last state is new: so is where the lane to its left begins.
            if p + 1 < n and nth[lane_of[p + 1]] > 0 and (k == len(wrong_places) or wrong_places[k] != p + 1):
                wrong_places.insert(k, p + 1)
    hit = automaton.accepts[seen]
    i, lane = np.nonzero(hit)
    at = stop[lane] - 1 - i
    order = np.argsort(at, kind="stable")
    return at[order], hit[i, lane][order]
