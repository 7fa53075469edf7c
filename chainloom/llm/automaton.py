"""Regular expressions compiled together into one deterministic automaton over bytes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

import numpy as np


class _Nfa:
    """States are numbers; moves[s] holds (set of bytes, next state), free[s] the next states without a byte. A backward
    one reads what the expressions match from its end."""

    def __init__(self, backward: bool = False) -> None:
        self._turn = (lambda tree: reversed(list(tree))) if backward else iter
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree: Iterable, at: int, either_case: bool) -> int:
        """Append a parsed expression behind state at; the state behind it."""
        for op, arg in self._turn(tree):
            if op in (sre.LITERAL, sre.IN):
                to = self.state()
                self.moves[at].append((_bytes_of(op, arg, either_case), to))
                at = to
            elif op is sre.SUBPATTERN:
                at = self.add(arg[3], at, either_case)
            elif op is sre.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    start = self.state()
                    self.free[at].append(start)
                    self.free[self.add(branch, start, either_case)].append(end)
                at = end
            elif op is sre.MAX_REPEAT:
                low, high, body = arg
                for _ in range(low):
                    at = self.add(body, at, either_case)
                if high is sre.MAXREPEAT:
                    loop = self.state()
                    self.free[at].append(loop)
                    self.free[self.add(body, loop, either_case)].append(loop)
                    at = loop
                else:
                    ends = [at]
                    for _ in range(high - low):
                        at = self.add(body, at, either_case)
                        ends.append(at)
                    end = self.state()
                    for x in ends:
                        self.free[x].append(end)
                    at = end
            else:
                raise ValueError(f"{op} has no place in a byte automaton")
        return at

    def closed(self, states: Iterable[int]) -> frozenset[int]:
        todo, found = list(states), set()
        while todo:
            s = todo.pop()
            if s not in found:
                found.add(s)
                todo += self.free[s]
        return frozenset(found)


def _bytes_of(op, arg, either_case: bool) -> frozenset[int]:
    found: set[int] = set()
    for kind, x in [(op, arg)] if op is sre.LITERAL else arg:
        if kind is sre.LITERAL:
            found.add(x)
        elif kind is sre.RANGE:
            found.update(range(x[0], x[1] + 1))
        else:
            raise ValueError(f"{kind} has no place in a byte automaton")
    if max(found) > 127:
        raise ValueError("only ASCII can stand in a byte automaton")
    if either_case:
        found |= {ord(chr(c).swapcase()) for c in found if chr(c).isalpha()}
    return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """table[state, class of a byte] is the next state; accepts[state] names the rules whose match ends there.

    State 0 is the start. An automaton that searches reports a rule wherever a match ends (for a backward one: begins),
    whatever came before; one that doesn't, only matches from its start on, and dead is the state that none follows.
    """

    names: tuple[str, ...]
    classes: bytes
    table: np.ndarray
    accepts: tuple[tuple[int, ...], ...]


def compile_rules(rules: Iterable[tuple[str, str, bool]], backward: bool = False, search: bool = True) -> Automaton:
    """(name, expression, either case) of each rule to one minimal automaton: an automaton with free moves for each
    rule, subset construction over byte classes, then merging of states that nothing tells apart."""
    nfa, begins, ends, names = _Nfa(backward), [], {}, []
    for k, (name, expression, either_case) in enumerate(rules):
        names.append(name)
        begins.append(nfa.state())
        ends[nfa.add(parser.parse(expression), begins[-1], either_case)] = k
    sets = sorted({chars for moves in nfa.moves for chars, _ in moves}, key=sorted)
    kinds: dict[tuple[bool, ...], int] = {}
    classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    sample = [classes.index(k) for k in range(len(kinds))]

    start = nfa.closed(begins)
    index, order, table, accepts = {start: 0}, [start], [], []
    for now in order:
        accepts.append(tuple(sorted(ends[s] for s in now if s in ends)))
        row = []
        for byte in sample:
            to = nfa.closed([t for s in now for chars, t in nfa.moves[s] if byte in chars]) | (start if search else frozenset())
            if to not in index:
                index[to] = len(order)
                order.append(to)
            row.append(index[to])
        table.append(row)
    return _minimal(tuple(names), classes, np.array(table), accepts)


def _minimal(names: tuple[str, ...], classes: bytes, table: np.ndarray, accepts: list[tuple[int, ...]]) -> Automaton:
    marks = {x: k for k, x in enumerate(sorted(set(accepts)))}
    block = np.array([marks[x] for x in accepts])
    while True:
        _, first, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_index=True, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    # the start becomes state 0
    rank = np.argsort(np.argsort(np.where(np.arange(len(first)) == finer[0], -1, first)))
    place = np.argsort(rank)
    return Automaton(names, classes, rank[finer[table[first[place]]]].astype(np.int32), tuple(accepts[s] for s in first[place]))


class _Hit:
    """A row of the table that notes that a rule was found."""

    __slots__ = ("row", "seen")

    def __init__(self, row: list, seen: list) -> None:
        self.row, self.seen = row, seen

    def __getitem__(self, kind: int):
        self.seen[0] = True
        return self.row[kind]


class Scanner:
    """The spans of all rules in a text: one pass of their backward automaton over the bytes tells where matches begin,
    and from there the rule's own automaton runs to the longest end. Rows of the table of the first hold the next rows
    themselves, so that a byte costs one look-up; places are noted in a second pass, of texts with a match."""

    def __init__(self, begins: Automaton, ends: Sequence[Automaton]) -> None:
        self._begins, self._seen = begins, [False]
        rows: list[list] = [[] for _ in begins.accepts]
        states = [_Hit(row, self._seen) if rules else row for row, rules in zip(rows, begins.accepts, strict=True)]
        for row, nexts in zip(rows, begins.table.tolist(), strict=True):
            row.extend(states[t] for t in nexts)
        self._start, self._table = states[0], begins.table.tolist()
        self._forward = [(a.classes, a.table.tolist(), [bool(x) for x in a.accepts], _dead(a)) for a in ends]

    def begins(self, data: bytes) -> dict[int, list[int]]:
        """For each rule found the places where a match begins, in order."""
        kinds = data.translate(self._begins.classes)[::-1]
        self._seen[0], state = False, self._start
        for kind in kinds:
            state = state[kind]
        if not self._seen[0] and not isinstance(state, _Hit):
            return {}
        found: dict[int, list[int]] = {}
        table, accepts, now = self._table, self._begins.accepts, 0
        for k, kind in enumerate(kinds, 1):
            now = table[now][kind]
            for rule in accepts[now]:
                found.setdefault(rule, []).append(len(data) - k)
        return {rule: places[::-1] for rule, places in found.items()}

    def end(self, rule: int, data: bytes, start: int) -> int:
        """The longest end of the rule's match that begins at start."""
        classes, table, accepts, dead = self._forward[rule]
        now, end = 0, start
        for k in range(start, len(data)):
            now = table[now][classes[data[k]]]
            if now == dead:
                break
            if accepts[now]:
                end = k + 1
        return end

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes of the leftmost, longest matches of each rule that do not overlap."""
        found = []
        for rule, places in self.begins(data).items():
            last = 0
            for start in places:
                if start >= last:
                    last = self.end(rule, data, start)
                    found.append((start, rule, last))
        return sorted(found)


def _dead(automaton: Automaton) -> int:
    """The state that accepts nothing and leads to itself alone, or -1."""
    table, accepts = automaton.table, automaton.accepts
    return next((s for s in range(len(table)) if not accepts[s] and (table[s] == s).all()), -1)
