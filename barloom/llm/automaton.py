"""Regular expressions over bytes compiled to minimal transition arrays.

Supported: literals, escapes, ``.``, classes, groups, ``|``, ``? * + {m} {m,} {m,n}``. Matching is
leftmost-longest, which for patterns without competing alternatives is what backtracking engines return.
"""

from __future__ import annotations

from dataclasses import dataclass, field

ALL = frozenset(range(256))
_NAMED = {"d": frozenset(b"0123456789"), "w": frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"), "s": frozenset(b" \t\n\r\f\v")}
_CONTROL = {"n": 10, "r": 13, "t": 9, "f": 12, "v": 11}


def _fold(chars: frozenset[int]) -> frozenset[int]:
    upper, lower = range(65, 91), range(97, 123)
    return chars | {c + 32 for c in chars if c in upper} | {c - 32 for c in chars if c in lower}


class _Parser:
    """Recursive descent to nested tuples: ("set", chars), ("cat", parts), ("alt", parts), ("rep", part, low, high)."""

    def __init__(self, pattern: str, ignore_case: bool):
        self.text, self.at, self.ignore_case = pattern, 0, ignore_case

    def parse(self):
        tree = self.alternatives()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} in {self.text!r}")
        return tree

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"pattern ends early: {self.text!r}")
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, item):
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                item = ("rep", item, int(low), int(high) if high else None if comma else int(low))
            else:
                item = ("rep", item, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        return item

    def atom(self):
        c = self.take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            tree = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            return tree
        if c == ".":
            return ("set", ALL - {10})
        chars = self.bracket() if c == "[" else self.escape() if c == "\\" else frozenset(c.encode())
        if len(chars) > 1 and c not in "[\\":
            return ("cat", [("set", frozenset({b})) for b in c.encode()])
        return ("set", _fold(chars) if self.ignore_case else chars)

    def escape(self) -> frozenset[int]:
        c = self.take()
        if c == "x":
            self.at += 2
            return frozenset({int(self.text[self.at - 2 : self.at], 16)})
        if c in _NAMED:
            return _NAMED[c]
        return frozenset({_CONTROL[c]}) if c in _CONTROL else frozenset(c.encode())

    def bracket(self) -> frozenset[int]:
        negate = self.peek() == "^"
        if negate:
            self.take()
        chars: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            one = self.escape() if c == "\\" else frozenset(c.encode("latin-1"))
            if len(one) == 1 and self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.take()
                d = self.take()
                last = self.escape() if d == "\\" else frozenset(d.encode("latin-1"))
                chars.update(range(min(one), max(last) + 1))
            else:
                chars |= one
        self.take()
        return ALL - chars if negate else frozenset(chars)


def parse(pattern: str, ignore_case: bool = False):
    return _Parser(pattern, ignore_case).parse()


def reverse(tree):
    """The tree of the mirrored language."""
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", reverse(tree[1]), tree[2], tree[3])
    parts = [reverse(x) for x in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


@dataclass
class _Nfa:
    """Position sets with epsilon moves; one accepting state for each rule."""

    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int) -> int:
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                mid = self.state()
                self.empty[start].append(mid)
                self.empty[self.add(part, mid)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.add(part, start)
        end = self.state()
        self.empty[start].append(end)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            after = self.add(part, loop)
            self.empty[after].append(loop)
            self.empty[after].append(end)
        else:
            for _ in range(high - low):
                start = self.add(part, start)
                self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``next[state + class]`` is the next state; states are offsets of rows. From ``accept`` on, states accept.

    ``classes`` maps a byte to its class (for bytes.translate). ``rules[state // width]`` is the bit mask of the
    rules that accept. ``dead`` is the row no match can leave, or -1.
    """

    classes: bytes
    width: int
    start: int
    accept: int
    dead: int
    next: list[int]
    rules: list[int]


def compile_rules(trees: list, search: bool) -> Automaton:
    """Subset construction over all rules at once, then minimisation.

    search: a match may begin anywhere, so the start states join every step.
    """
    nfa = _Nfa()
    root = nfa.state()
    accepting = {}
    for rule, tree in enumerate(trees):
        begin = nfa.state()
        nfa.empty[root].append(begin)
        accepting[nfa.add(tree, begin)] = rule
    # bytes that no transition tells apart share a class
    kinds = {chars for moves in nfa.moves for chars, _ in moves}
    signature = [tuple(b in k for k in kinds) for b in range(256)]
    order = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    classes, width = bytes(order[s] for s in signature), len(order)
    sample = [signature.index(s) for s in order]

    first = nfa.closure([root])
    number, rows, todo = {first: 0}, [], [first]
    while todo:
        now = todo.pop(0)
        row = []
        for b in sample:
            reached = {to for x in now for chars, to in nfa.moves[x] if b in chars}
            then = nfa.closure(reached | {root} if search else reached)
            if then not in number:
                number[then] = len(number)
                todo.append(then)
            row.append(number[then])
        rows.append(row)
    masks = [sum(1 << accepting[x] for x in set(s) & accepting.keys()) for s in number]
    return _minimised(classes, width, rows, masks)


def _minimised(classes: bytes, width: int, rows: list[list[int]], masks: list[int]) -> Automaton:
    """Splits states by what they accept, then by where they lead, until nothing splits."""
    block = masks
    while True:
        seen: dict[tuple, int] = {}
        split = [seen.setdefault((block[i], *(block[j] for j in row)), len(seen)) for i, row in enumerate(rows)]
        if len(seen) == len(set(block)):
            break
        block = split
    keep: dict[int, int] = {}
    for i, b in enumerate(split):
        keep.setdefault(b, i)
    # accepting rows last: one comparison then tells them
    place = {b: at for at, b in enumerate(sorted(keep, key=lambda b: (masks[keep[b]] != 0, keep[b])))}
    ordered = sorted(place, key=place.get)
    table = [width * place[split[j]] for b in ordered for j in rows[keep[b]]]
    rules = [masks[keep[b]] for b in ordered]
    accept = width * next((i for i, m in enumerate(rules) if m), len(rules))
    dead = next((width * place[b] for b in ordered if not masks[keep[b]] and all(split[j] == b for j in rows[keep[b]])), -1)
    return Automaton(classes, width, width * place[split[0]], accept, dead, table, rules)
