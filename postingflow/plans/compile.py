"""An expression tree as columns over a document's map from term to positions.

Every node is an ARRAY<STRUCT<pos, len>>, in the order in which its hits come; null means that the document doesn't
match. Postings are shuffled once, by document, whatever the tree's depth.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import batches
from .query import Adjacent, And, Expr, Near, Not, Or, Term

HITS = "array<struct<pos:bigint,len:bigint>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hit(pos: Column, length: Column) -> Column:
    return F.struct(pos.cast("long").alias("pos"), length.cast("long").alias("len"))


def in_order(expr: Expr) -> bool:
    """Whether a node's hits are ascending for sure; rounds of a proximity match can step back."""
    return not isinstance(expr, Near) and all(in_order(c) for c in expr.children)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _largest_so_far(hits: pa.Array) -> pa.Array:
    """Of each hit, the largest position up to it."""
    return batches.largest_so_far(hits)


def _merge(parts: list[Column], sorted_: list[bool]) -> Column:
    """Merges lists by their heads, ties to the first list.

    A list that isn't ascending holds back what follows a larger element, so an element's place is that of the largest
    one up to it.
    """

    def keyed(part: Column, slot: int, ascending: bool) -> Column:
        own = lambda key, h, i: F.struct(key.alias("key"), F.lit(slot).alias("slot"), i.alias("i"), h["pos"].alias("pos"), h["len"].alias("len"))
        if ascending:
            return F.transform(part, lambda h, i: own(h["pos"], h, i))
        return F.transform(F.arrays_zip(part.alias("h"), _largest_so_far(part).alias("key")), lambda z, i: own(z["key"], z["h"], i))

    every = F.concat(*[keyed(p, k, s) for k, (p, s) in enumerate(zip(parts, sorted_))])
    return F.transform(F.array_sort(every), lambda h: F.struct(h["pos"].alias("pos"), h["len"].alias("len")))


def _or_null(hits: Column) -> Column:
    return _let(hits, lambda h: F.when(F.size(h) > 0, h))


def walk(lists: Sequence[tuple[list[int], list[int]]], distance: int) -> tuple[list[int], list[int]]:
    """The greedy walk over (positions, lengths) per operand: one cursor for each; a round takes the hits under the cursors
    in order of position if each begins at most ``distance`` behind the end of the one before, and else moves the first."""
    pos, length = [x[0] for x in lists], [x[1] for x in lists]
    at, ends = [0] * len(lists), [len(p) for p in pos]
    out: tuple[list[int], list[int]] = ([], [])
    if not all(ends):
        return out
    while True:
        # of operands at one position only the last takes part
        heads = {pos[s][k]: s for s, k in enumerate(at)}
        order = sorted(heads)
        moved = [heads[p] for p in order]
        for a, b in zip(order, order[1:]):
            s = heads[a]
            if not 0 <= b - (a + length[s][at[s]] - 1) <= distance:
                moved = moved[:1]
                break
        else:
            out[0].extend(order)
            out[1].extend([length[s][at[s]] for s in moved])
        for s in moved:
            at[s] += 1
            if at[s] == ends[s]:
                return out


def follow(lists: Sequence[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
    """Hits of the first operand behind which every other one has a hit at its place."""
    starts = [set(p) for p, _ in lists]
    found = [p for p in lists[0][0] if all(p + k in s for k, s in enumerate(starts))]
    return found, [len(lists)] * len(found)


def _by_document(f: Callable[[Sequence[tuple[list[int], list[int]]]], tuple[list[int], list[int]]], parts: list[Column]) -> Column:
    """``f`` of each document's lists, in time in proportion to their length; null where a list or the result is missing."""

    def run(columns: pa.Array) -> pa.Array:
        return batches.by_document(f, columns)

    return F.arrow_udf(run, HITS)(F.struct(*[p.alias(f"p{k}") for k, p in enumerate(parts)]))


def _node(expr: Expr, parts: list[Column], positions: Column) -> Column:
    """The hits of one node, from those of its children."""
    if isinstance(expr, Term):
        return F.transform(F.try_element_at(positions, F.lit(expr.term)), lambda p: _hit(p, F.lit(1)))
    ascending = [in_order(c) for c in expr.children]
    every = parts[0].isNotNull()
    for p in parts[1:]:
        every = every & p.isNotNull()
    if isinstance(expr, And):
        return F.when(every, _merge(parts, ascending))
    if isinstance(expr, Or):
        return _or_null(_merge([F.coalesce(p, F.array().cast(HITS)) for p in parts], ascending))
    if isinstance(expr, Adjacent):
        if not all(isinstance(c, Term) for c in expr.children):
            return _by_document(follow, parts)
        # positions of terms are ascending and each only once
        starts = F.transform(parts[0], lambda h: h["pos"])
        back = lambda k: lambda h: h["pos"] - k
        for k, part in enumerate(parts[1:], 1):
            starts = F.array_intersect(starts, F.transform(part, back(k)))
        return F.when(every, _or_null(F.transform(starts, lambda p: _hit(p, F.lit(len(parts))))))
    if isinstance(expr, Near):
        return _by_document(lambda lists: walk(lists, expr.distance), parts)
    if isinstance(expr, Not):
        return F.when(parts[1].isNull(), parts[0])
    raise TypeError(expr)


def evaluate(docs: DataFrame, expr: Expr, positions: str) -> DataFrame:
    """``docs`` with ``hits``: its column ``positions`` is MAP<term, ARRAY<position>>.

    Nodes become columns level by level, from the leaves up, equal ones once; a node's children are columns that are
    there, so none is computed twice and no expression is deeper than one node.
    """
    height: dict[Expr, int] = {}

    def visit(e: Expr) -> int:
        if e not in height:
            height[e] = 1 + max((visit(c) for c in e.children), default=-1)
        return height[e]

    visit(expr)
    name = {e: f"__n{k}" for k, e in enumerate(height)}
    kept = docs.columns
    for level in range(height[expr] + 1):
        new = [_node(e, [F.col(name[c]) for c in e.children], F.col(positions)).alias(name[e]) for e, h in height.items() if h == level]
        docs = docs.select("*", *new)
    return docs.select(*kept, F.col(name[expr]).alias("hits"))
