"""A small model of search in plain Python, to compare the engine with."""

import re

from postingflow.plans.query import Adjacent, And, Near, Not, Or, Term

WORDS = re.compile(r"[^\W\d_]+")


def positions(text):
    out = {}
    for k, w in enumerate(WORDS.findall(text)):
        out.setdefault(w.lower(), []).append(k)
    return out


def merge(lists):
    """Takes the smallest head, the first list's of equals, until nothing is left."""
    at, out = [0] * len(lists), []
    while True:
        heads = [(xs[i][0], s) for s, (xs, i) in enumerate(zip(lists, at)) if i < len(xs)]
        if not heads:
            return out
        s = min(heads)[1]
        out.append(lists[s][at[s]])
        at[s] += 1


def near(lists, distance):
    at, out = [0] * len(lists), []
    while True:
        heads = {}
        for s, xs in enumerate(lists):
            heads[xs[at[s]][0]] = s
        order = sorted(heads)
        close = True
        for a, b in zip(order, order[1:]):
            gap = b - (a + lists[heads[a]][at[heads[a]]][1] - 1)
            close &= 0 <= gap <= distance
        if close:
            out += [lists[heads[p]][at[heads[p]]] for p in order]
        moved = [heads[p] for p in (order if close else order[:1])]
        for s in moved:
            at[s] += 1
        if any(at[s] == len(lists[s]) for s in moved):
            return out


def evaluate(expr, doc):
    """Hits of a document's positions, or None."""
    if isinstance(expr, Term):
        found = [(p, 1) for p in doc.get(expr.term, [])]
        return found or None
    parts = [evaluate(c, doc) for c in expr.children]
    if isinstance(expr, Or):
        some = [p for p in parts if p]
        return merge(some) if some else None
    if isinstance(expr, Not):
        return None if parts[1] else parts[0]
    if not all(parts):
        return None
    if isinstance(expr, And):
        return merge(parts)
    if isinstance(expr, Near):
        return near(parts, expr.distance) or None
    assert isinstance(expr, Adjacent)
    starts = [{p for p, _ in part} for part in parts]
    return [(p, len(parts)) for p, _ in parts[0] if all(p + k in s for k, s in enumerate(starts))] or None
