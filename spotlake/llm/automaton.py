"""Regular expressions over bytes, compiled to minimal deterministic automata as numpy transition arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

ALL = (1 << 256) - 1


def _mask(values) -> int:
    out = 0
    for v in values:
        out |= 1 << v
    return out


class _Parser:
    """Literals, [classes], (groups), |, ?, *, +, {m}, {m,}, {m,n} and \\xHH; a tree of tuples comes out."""

    def __init__(self, text: str, fold: bool):
        self.text, self.at, self.fold = text, 0, fold

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def parse(self):
        tree = self.either()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.peek()!r} in {self.text!r}")
        return tree

    def either(self):
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("or", branches)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        tree = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                least, most = int(low), (int(high) if high else None) if comma else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            tree = ("rep", tree, least, most)
        return tree

    def char(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def folded(self, values) -> int:
        both = set(values)
        if self.fold:
            both |= {ord(f(chr(v))) for v in values if chr(v).isascii() and chr(v).isalpha() for f in (str.lower, str.upper)}
        return _mask(both)

    def atom(self):
        if self.peek() == "(":
            self.take()
            tree = self.either()
            if self.take() != ")":
                raise ValueError("unclosed group")
            return tree
        if self.peek() == "[":
            self.take()
            negated = self.peek() == "^"
            self.at += negated
            values: set[int] = set()
            while self.peek() != "]":
                low = self.char()
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    values.update(range(low, self.char() + 1))
                else:
                    values.add(low)
            self.take()
            mask = self.folded(values)
            return ("set", ALL & ~mask if negated else mask)
        if self.peek() == ".":
            self.take()
            return ("set", ALL)
        return ("set", self.folded([self.char()]))


@dataclass
class Nfa:
    edges: list[list[tuple[int, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    accept: dict[int, int] = field(default_factory=dict)

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def add(self, tree, start: int) -> int:
        """Build tree from start; the state where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.edges[start].append((tree[1], end))
            return end
        if kind == "seq":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for branch in tree[1]:
                self.free[self.add(branch, start)].append(end)
            return end
        _, inner, least, most = tree
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            return loop
        ends = [start]
        for _ in range(most - least):
            start = self.add(inner, start)
            ends.append(start)
        end = self.state()
        for x in ends:
            self.free[x].append(end)
        return end

    def closures(self) -> list[int]:
        """For each state the set (as bits) of states that are reached from it freely, itself included."""
        out = []
        for start in range(len(self.free)):
            seen, todo = 1 << start, [start]
            while todo:
                for x in self.free[todo.pop()]:
                    if not seen >> x & 1:
                        seen |= 1 << x
                        todo.append(x)
            out.append(seen)
        return out


@dataclass
class Dfa:
    """next[state, byte]; labels[state]: bit r set where rule r is matched. Where anchored, dead is the state of no way on."""

    next: np.ndarray
    labels: np.ndarray
    start: int
    dead: int
    used: np.ndarray  # bytes that some rule can read

    @property
    def size(self) -> int:
        return len(self.labels)


def compile_rules(rules: list[tuple[str, bool]], search: bool) -> Dfa:
    """rules: (pattern, letters in either case). search: matches may begin anywhere.

    Subset construction over classes of bytes that no rule tells apart, then partition refinement.
    """
    nfa = Nfa()
    start = nfa.state()
    for r, (pattern, fold) in enumerate(rules):
        nfa.accept[nfa.add(_Parser(pattern, fold).parse(), start)] = r
    masks = sorted({m for e in nfa.edges for m, _ in e})
    kinds: dict[tuple, int] = {}
    byte_class = np.array([kinds.setdefault(tuple(m >> b & 1 for m in masks), len(kinds)) for b in range(256)])
    member = [list(byte_class).index(k) for k in range(len(kinds))]
    used = np.array([any(m >> b & 1 for m in masks) for b in range(256)])

    # sets of states are whole numbers; those without a way on but by `free` ones are left out unless they accept
    free = nfa.closures()
    matter = sum(1 << s for s in range(len(free)) if nfa.edges[s] or s in nfa.accept)
    moves = [[(k, free[t] & matter) for m, t in edges for k, b in enumerate(member) if m >> b & 1] for edges in nfa.edges]
    first = free[start] & matter
    again = first if search else 0
    ids, todo, rows = {first: 0}, [first], []
    for now in todo:
        row = [again] * len(member)
        while now:
            low = now & -now
            for k, to in moves[low.bit_length() - 1]:
                row[k] |= to
            now ^= low
        for then in row:
            if then not in ids:
                ids[then] = len(ids)
                todo.append(then)
        rows.append([ids[then] for then in row])
    table = np.array(rows)
    labels = np.zeros(len(ids), dtype=np.int64)
    for s, r in nfa.accept.items():
        labels |= np.array([states >> s & 1 for states in ids], dtype=np.int64) << r

    part = np.unique(labels, return_inverse=True)[1]
    while True:  # split what the classes of successors tell apart, a column at a time
        refined = part
        for column in table.T:
            refined = np.unique(refined * (int(part.max()) + 1) + part[column], return_inverse=True)[1]
        if refined.max() == part.max():
            break
        part = refined
    order = np.argsort(labels[np.unique(part, return_index=True)[1]] > 0, kind="stable")  # accepting states get the highest numbers
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    part = rank[part]
    one = np.unique(part, return_index=True)[1]
    small = part[table[one]][:, byte_class].astype(np.int32)
    labels = labels[one]
    loops = (small == np.arange(len(one))[:, None]).all(axis=1) & (labels == 0)
    return Dfa(small, labels, int(part[0]), -1 if search else int(np.flatnonzero(loops)[0]) if loops.any() else -1, used)
