"""Expression trees and the query language.

    query   = [either]
    either  = both ("|" both)*
    both    = close+                      side by side
    close   = single ("~" single)*        near each other
    single  = '"' word+ '"' | word | "(" either ")"
    word    = letters, digits and "-"

Blanks and tabs separate; nothing else does. A query that doesn't follow the grammar to its end, has more than DEPTH
parentheses within each other, or holds a word that the index doesn't have, has no expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

DISTANCE = 4
DEPTH = 200  # parentheses within each other that a query may have


@dataclass(frozen=True)
class Expr:
    children: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Term(Expr):
    term: str = ""

    def __init__(self, term: str) -> None:
        object.__setattr__(self, "term", term)
        object.__setattr__(self, "children", ())


class _Many(Expr):
    def __init__(self, *children: Expr) -> None:
        if not children:
            raise ValueError("an operator needs an operand")
        object.__setattr__(self, "children", tuple(children))


@dataclass(frozen=True, init=False)
class And(_Many):
    """All operands; the hits of all."""


@dataclass(frozen=True, init=False)
class Or(_Many):
    """Any operand; the hits of those that match."""


@dataclass(frozen=True, init=False)
class Adjacent(_Many):
    """Operands at consecutive positions; one hit as long as there are operands."""


@dataclass(frozen=True, init=False)
class Near(_Many):
    """Operands with at most ``distance`` between one's end and the next one's start."""

    distance: int = DISTANCE

    def __init__(self, *children: Expr, distance: int = DISTANCE) -> None:
        super().__init__(*children)
        object.__setattr__(self, "distance", distance)


@dataclass(frozen=True, init=False)
class Not(Expr):
    """Documents and hits of ``keep`` where ``drop`` doesn't match; not part of the query language."""

    def __init__(self, keep: Expr, drop: Expr) -> None:
        object.__setattr__(self, "children", (keep, drop))


def leaves(expr: Expr) -> Iterator[str]:
    """Terms of a tree, depth first, as often as they stand in it."""
    if isinstance(expr, Term):
        yield expr.term
    for child in expr.children:
        yield from leaves(child)


def required(expr: Expr) -> set[str]:
    """Terms that every document that matches has."""
    if isinstance(expr, Term):
        return {expr.term}
    parts = [required(c) for c in expr.children]
    if isinstance(expr, Not):
        return parts[0]
    return set.intersection(*parts) if isinstance(expr, Or) else set.union(*parts)


class _Wrong(Exception):
    pass


_TOKEN = re.compile(r'[ \t]*([a-zA-Z0-9-]+|["|~()])')


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    end = len(text.rstrip(" \t"))
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise _Wrong
        out.append(m[1])
        at = m.end()
    return out


def parse_syntax(text: str, normalize: Callable[[str], str] = str.lower) -> Expr | None:
    """The expression of a query by the grammar alone; None if there is none."""
    try:
        tokens = _tokens(text)
    except _Wrong:
        return None
    if not tokens:
        return None
    many = lambda kind, found: found[0] if len(found) == 1 else kind(*found)
    signs = {'"', "|", "~", "(", ")"}

    class Level:
        """What stands open between parentheses: sides of "|", words side by side, words near each other."""

        def __init__(self) -> None:
            self.sides, self.both, self.near, self.waits = [], [], [], True

        def add(self, expr: Expr) -> None:
            if self.near and not self.waits:
                self.beside()
            self.near.append(expr)
            self.waits = False

        def beside(self) -> None:
            self.both.append(many(Near, self.near))
            self.near = []

        def side(self) -> None:
            if self.waits:
                raise _Wrong
            self.beside()
            self.sides.append(many(And, self.both))
            self.both, self.waits = [], True

        def end(self) -> Expr:
            self.side()
            return many(Or, self.sides)

    levels, at = [Level()], 0
    try:
        while at < len(tokens):
            token, at = tokens[at], at + 1
            if token == "(":
                levels.append(Level())
                if len(levels) > DEPTH:
                    raise _Wrong
            elif token == ")":
                if len(levels) == 1:
                    raise _Wrong
                inner = levels.pop().end()
                levels[-1].add(inner)
            elif token == "|":
                levels[-1].side()
            elif token == "~":
                if levels[-1].waits:
                    raise _Wrong
                levels[-1].waits = True
            elif token == '"':
                end = next((k for k in range(at, len(tokens)) if tokens[k] in signs), len(tokens))
                if end == at or end == len(tokens) or tokens[end] != '"':
                    raise _Wrong
                levels[-1].add(many(Adjacent, [Term(normalize(w)) for w in tokens[at:end]]))
                at = end + 1
            else:
                levels[-1].add(Term(normalize(token)))
        if len(levels) > 1:
            raise _Wrong
        return levels[0].end()
    except _Wrong:
        return None


def parse_query(index, text: str) -> Expr | None:
    """The expression of a query over an index; None if it breaks the grammar or holds a word that the index lacks.

    All words are looked up in one job.
    """
    expr = parse_syntax(text, index.analyzer.normalize_word)
    if expr is None:
        return None
    words = set(leaves(expr))
    return expr if index.existing(words) == words else None
