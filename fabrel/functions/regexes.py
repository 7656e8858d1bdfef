"""Texts of a regular expression: the n-th text as a column expression, and an automaton that counts the texts."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ParseError
from .rng import Draw

#: How often `*`, `+` and `{n,}` repeat at most, beyond their least number.
MORE = 8
#: Languages of more texts than this are drawn part by part; a draw has 52 bits.
LARGE = 1 << 52
#: States of an automaton, at most; a pattern of more is drawn, but not spread.
STATES = 5000
#: What `.` and negated classes stand for: printable ASCII.
PRINTABLE = "".join(map(chr, range(33, 127))) + " "
CLASSES = {op.CATEGORY_DIGIT: "0123456789", op.CATEGORY_SPACE: " ", op.CATEGORY_WORD: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"}
NOT = {op.CATEGORY_NOT_DIGIT: op.CATEGORY_DIGIT, op.CATEGORY_NOT_SPACE: op.CATEGORY_SPACE, op.CATEGORY_NOT_WORD: op.CATEGORY_WORD}


def is_regex(pattern: str) -> bool:
    """Whether a pattern is a regular expression rather than a template or a plain text."""
    from .patterns import is_template

    return not is_template(pattern) and re.search(r"[\[\]()\\^$+*?|]|\{\d+(,\d*)?\}", pattern) is not None


@dataclass(frozen=True)
class Chars:
    """One of some characters."""

    chars: str

    @property
    def count(self) -> int:
        return len(self.chars)

    def text(self, n: Column) -> Column:
        return F.lit(self.chars) if len(self.chars) == 1 else F.substring(F.lit(self.chars), (n + 1).cast("int"), F.lit(1))

    def drawn(self, d: Draw, place: str) -> Column:
        return self.text(d.h(place) % self.count)


@dataclass(frozen=True)
class Sequence:
    """Parts one behind the other: n has a digit for each, in mixed base."""

    parts: tuple

    @property
    def count(self) -> int:
        out = 1
        for p in self.parts:
            out *= p.count
        return out

    def text(self, n: Column) -> Column:
        out, left = [], n
        for p in reversed(self.parts):
            out.append(p.text(left % F.lit(p.count) if p.count > 1 else F.lit(0)))
            left = F.call_function("div", left, F.lit(p.count)) if p.count > 1 else left
        return F.concat(F.lit(""), *reversed(out))

    def drawn(self, d: Draw, place: str) -> Column:
        return F.concat(F.lit(""), *[p.drawn(d, f"{place}.{k}") for k, p in enumerate(self.parts)])


@dataclass(frozen=True)
class Choice:
    """One of some alternatives: n falls into the range of one of them."""

    parts: tuple

    @property
    def count(self) -> int:
        return sum(p.count for p in self.parts)

    def text(self, n: Column) -> Column:
        out, begin = None, 0
        for p in self.parts:
            end = begin + p.count
            v = p.text(n - F.lit(begin))
            out = F.when(n < F.lit(end), v) if out is None else out.when(n < F.lit(end), v)
            begin = end
        return out

    def drawn(self, d: Draw, place: str) -> Column:
        if self.count <= LARGE:
            return self.text(d.h(place) % F.lit(self.count))
        return F.element_at(F.array(*[p.drawn(d, f"{place}.{k}") for k, p in enumerate(self.parts)]), (d.h(place) % len(self.parts) + 1).cast("int"))


def _class(items: list) -> str:
    out, negated = [], False
    for kind, value in items:
        if kind is op.NEGATE:
            negated = True
        elif kind is op.LITERAL:
            out.append(chr(value))
        elif kind is op.RANGE:
            out += map(chr, range(value[0], value[1] + 1))
        elif kind is op.CATEGORY and value in CLASSES:
            out += CLASSES[value]
        elif kind is op.CATEGORY and value in NOT:
            out += [c for c in PRINTABLE if c not in CLASSES[NOT[value]]]
        else:
            raise ParseError(f"not supported in a pattern: {kind}")
    found = dict.fromkeys(out)
    return "".join(c for c in PRINTABLE if c not in found) if negated else "".join(found)


def _built(items) -> Sequence:
    parts = []
    for kind, value in items:
        if kind is op.LITERAL:
            parts.append(Chars(chr(value)))
        elif kind is op.ANY:
            parts.append(Chars(PRINTABLE))
        elif kind is op.NOT_LITERAL:
            parts.append(Chars(PRINTABLE.replace(chr(value), "")))
        elif kind is op.IN:
            parts.append(Chars(_class(value)))
        elif kind is op.BRANCH:
            parts.append(Choice(tuple(_built(x) for x in value[1])))
        elif kind is op.SUBPATTERN:
            parts.append(_built(value[-1]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = value
            one = _built(inner)
            most = low + MORE if high is op.MAXREPEAT else high
            parts.append(Sequence((one,) * low) if low == most else Choice(tuple(Sequence((one,) * k) for k in range(low, most + 1))))
        elif kind is op.AT and value in (op.AT_BEGINNING, op.AT_BEGINNING_STRING, op.AT_END, op.AT_END_STRING):
            continue  # a text is the whole match
        else:
            raise ParseError(f"not supported in a pattern: {kind}")
    return Sequence(tuple(parts))


class _Nfa:
    """States with steps (characters, state) and free steps."""

    def __init__(self) -> None:
        self.steps, self.free = [], []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        if len(self.steps) > STATES:
            raise OverflowError
        return len(self.steps) - 1

    def add(self, node, at: int) -> int:
        """The state behind node from the state `at`."""
        if isinstance(node, Chars):
            end = self.state()
            self.steps[at].append((frozenset(node.chars), end))
            return end
        if isinstance(node, Sequence):
            for p in node.parts:
                at = self.add(p, at)
            return at
        end = self.state()
        for p in node.parts:
            begin = self.state()
            self.free[at].append(begin)
            self.free[self.add(p, begin)].append(end)
        return end


def languages_size(node) -> int | None:
    """How many texts a pattern has: paths of the automaton that is in all states at once, from the last one back. None if it
    has too many states."""
    nfa = _Nfa()
    try:
        start = nfa.state()
        final = nfa.add(node, start)
    except OverflowError:
        return None

    def closed(states: frozenset) -> frozenset:
        todo, out = list(states), set(states)
        while todo:
            for s in nfa.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    counts: dict[frozenset, int] = {}
    # Patterns have no loops once repeats are bounded, so depth is the length of the longest text.
    stack = [closed(frozenset([start]))]
    begin = stack[0]
    while stack:
        now = stack[-1]
        steps = [x for s in now for x in nfa.steps[s]]
        groups: dict[frozenset, int] = {}
        for c in {c for chars, _ in steps for c in chars}:
            to = frozenset(s for chars, s in steps if c in chars)
            groups[to] = groups.get(to, 0) + 1
        after = {closed(to): n for to, n in groups.items()}
        if missing := [x for x in after if x not in counts]:
            stack += missing
            if len(counts) + len(stack) > STATES:
                return None
            continue
        counts[now] = sum(groups[to] * counts[closed(to)] for to in groups) + (final in now)
        stack.pop()
    return counts[begin]


@lru_cache(maxsize=256)
class Regex:
    """A pattern of literals, classes, groups, alternatives and repeats. `count`: how many ways it has to make a text; `spread`:
    how many texts, if each is made in one way and they can be counted with a draw."""

    def __init__(self, pattern: str) -> None:
        try:
            self.node = _built(parser.parse(pattern))
        except re.error as e:
            raise ParseError(f"not a pattern: {pattern}") from e
        self.count = self.node.count
        self.spread = self.count if 0 < self.count <= LARGE and languages_size(self.node) == self.count else None
        if not self.count:
            raise ParseError(f"a pattern without texts: {pattern}")

    def text(self, n: Column) -> Column:
        """The n-th text."""
        return self.node.text(n)

    def drawn(self, d: Draw) -> Column:
        return self.node.text(d.h("regex") % F.lit(self.count)) if self.count <= LARGE else self.node.drawn(d, "regex")
