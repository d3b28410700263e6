"""Regular expressions over bytes, compiled to minimal deterministic automata.

The language: literals, escapes (``\\x20``, ``\\.``), classes, groups, ``(?i:...)``
for ASCII letters in either case, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}`` and
``{m,n}``. Parsed trees become Thompson automata, subset construction over classes
of equal bytes makes them deterministic, and partition refinement minimises them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

Tree = tuple


class Parser:
    def __init__(self, pattern: str) -> None:
        self.s, self.i, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"pattern ends early: {self.s}")
        self.i += 1
        return c

    def parse(self) -> Tree:
        tree = self.alternatives()
        if self.peek():
            raise ValueError(f"unbalanced pattern: {self.s}")
        return tree

    def alternatives(self) -> Tree:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self) -> Tree:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("then", parts)

    def repeated(self) -> Tree:
        tree = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                end = self.s.index("}", self.i)
                first, comma, last = self.s[self.i : end].partition(",")
                low, high = int(first), int(last) if last else None if comma else int(first)
                self.i = end + 1
            tree = ("repeat", tree, low, high)
        return tree

    def atom(self) -> Tree:
        c = self.take()
        if c == "(":
            before = self.fold
            if self.s.startswith("?i:", self.i):
                self.fold, self.i = True, self.i + 3
            elif self.s.startswith("?:", self.i):
                self.i += 2
            tree = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"group isn't closed: {self.s}")
            self.fold = before
            return tree
        if c == "[":
            return self.either(self.members())
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return self.either({self.escaped() if c == "\\" else ord(c)})

    def either(self, members: Iterable[int]) -> Tree:
        out = set(members)
        if self.fold:
            out |= {x ^ 32 for x in out if 65 <= x & ~32 <= 90}
        return ("set", frozenset(out))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def members(self) -> set[int]:
        negated = self.peek() == "^"
        self.i += negated
        out: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            low = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.s[self.i + 1 : self.i + 2] not in ("]", ""):
                self.take()
                c = self.take()
                out |= set(range(low, (self.escaped() if c == "\\" else ord(c)) + 1))
            else:
                out.add(low)
        self.take()
        return set(range(256)) - out if negated else out


def parse(pattern: str) -> Tree:
    if not pattern.isascii():
        raise ValueError("patterns are over bytes: ASCII and escapes only")
    return Parser(pattern).parse()


def reverse(tree: Tree) -> Tree:
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "repeat":
        return ("repeat", reverse(tree[1]), *tree[2:])
    parts = [reverse(x) for x in tree[1]]
    return (kind, parts[::-1] if kind == "then" else parts)


@dataclass
class Nfa:
    """States by number; ``moves``: (bytes, to) or None; ``free``: moves without a byte."""

    moves: list[tuple[frozenset[int], int] | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append(None)
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree: Tree, start: int) -> int:
        """The state in which what starts at ``start`` has matched ``tree``."""
        kind = tree[0]
        if kind == "set":
            at, end = self.state(), self.state()
            self.free[start].append(at)
            self.moves[at] = (tree[1], end)
            return end
        if kind == "then":
            for x in tree[1]:
                start = self.add(x, start)
            return start
        if kind == "or":
            end = self.state()
            for x in tree[1]:
                self.free[self.add(x, start)].append(end)
            return end
        _, inner, low, high = tree
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            again = self.state()
            self.free[start].append(again)
            self.free[self.add(inner, again)].append(again)
            return again
        end = self.state()
        self.free[start].append(end)
        for _ in range(high - low):
            start = self.add(inner, start)
            self.free[start].append(end)
        return end


@dataclass(frozen=True)
class Dfa:
    """``table[state + byte_class]`` is the next state; states are multiples of the classes.

    Those from ``first_accept`` on accept the labels in ``accepts``. ``dead`` is the
    state without a way out, or -1.
    """

    classes: bytes
    width: int
    table: list[int]
    start: int
    first_accept: int
    accepts: dict[int, tuple[int, ...]]
    dead: int

    @property
    def states(self) -> int:
        return len(self.table) // self.width


def byte_classes(nfa: Nfa) -> list[int]:
    """A number for each byte; bytes that every set of the automaton treats alike share one."""
    sets = list({x[0] for x in nfa.moves if x})
    seen: dict[tuple[bool, ...], int] = {}
    return [seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(256)]


def compile_dfa(trees: Iterable[Tree], *, anywhere: bool, most_states: int = 50_000) -> Dfa:
    """One automaton for all trees, labelled by their number; ``anywhere``: matches may start at any byte."""
    nfa = Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for label, tree in enumerate(trees):
        ends[nfa.add(tree, root)] = label
    if anywhere:
        loop = nfa.state()
        nfa.free[loop].append(root)
        nfa.moves[loop] = (frozenset(range(256)), loop)
        root = loop
    classes = byte_classes(nfa)
    sample = [classes.index(c) for c in range(max(classes) + 1)]

    def closed(states: Iterable[int]) -> frozenset[int]:
        todo, seen = list(states), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += nfa.free[x]
        return frozenset(x for x in seen if nfa.moves[x] or x in ends)

    first = closed([root])
    number, order, rows = {first: 0}, [first], []
    for at in order:  # grows while it is walked through
        row = []
        for byte in sample:
            to = closed(m[1] for x in at if (m := nfa.moves[x]) and byte in m[0])
            if to not in number:
                number[to] = len(order)
                order.append(to)
                if len(order) > most_states:
                    raise ValueError("too many states; use + and a length check in place of counts")
            row.append(number[to])
        rows.append(row)
    labels = [tuple(sorted(ends[x] for x in at if x in ends)) for at in order]
    return _minimal(rows, labels, bytes(classes))


def _minimal(rows: list[list[int]], labels: list[tuple[int, ...]], classes: bytes) -> Dfa:
    """Blocks of states that nothing tells apart, refined until no block splits; accepting ones last."""
    names: dict = {}
    block = [names.setdefault(x, len(names)) for x in labels]
    while True:
        names = {}
        finer = [names.setdefault((block[i], *(block[x] for x in row)), len(names)) for i, row in enumerate(rows)]
        if len(set(finer)) == len(set(block)):
            break
        block = finer
    first_of = {}
    for i, b in enumerate(block):
        first_of.setdefault(b, i)
    order = sorted(first_of.values(), key=lambda i: (bool(labels[i]), i))
    width = len(rows[0])
    place = {block[i]: k * width for k, i in enumerate(order)}
    table = [place[block[x]] for i in order for x in rows[i]]
    accepts = {place[block[i]]: labels[i] for i in order if labels[i]}
    dead = next((place[block[i]] for i in order if not labels[i] and all(block[x] == block[i] for x in rows[i])), -1)
    return Dfa(classes, width, table, place[block[0]], min(accepts, default=len(table)), accepts, dead)


def longest(dfa: Dfa, data: bytes, start: int, stop: int, step: int = 1) -> tuple[int, int]:
    """(first, last) count of bytes from ``start`` towards ``stop`` after which ``dfa`` accepts; -1 if never."""
    table, classes, state, first, last = dfa.table, dfa.classes, dfa.start, -1, -1
    for n, i in enumerate(range(start, stop, step), 1):
        state = table[state + classes[data[i]]]
        if state >= dfa.first_accept:
            first, last = (n if first < 0 else first), n
        elif state == dfa.dead:
            break
    return first, last
