"""What is done to Arrow batches of documents, in slices of few tokens.

A batch has as many rows as the session allows, whatever their length; by slices the arrays made of it stay small and as
large for any input. Tasks import this module, so it needs no Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 17  # elements of lists that are worked on at once


def offsets(lists: pa.ListArray) -> np.ndarray:
    return lists.offsets.to_numpy().astype(np.int64)


def slices(at: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows, from the offsets of their lists: each has at most so many elements, or is one row."""
    begin, rows = 0, len(at) - 1
    while begin < rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield begin, end
        begin = end


def byte_ranges(tokens: pa.ListArray, gaps: pa.ListArray) -> pa.StructArray:
    """Where tokens start and how long they are, from the lengths of each row's tokens and of the gaps around them."""
    t_at, g_at = offsets(tokens), offsets(gaps)
    t_at, g_at = t_at - t_at[0], g_at - g_at[0]
    t, g = (a.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for a in (tokens, gaps))
    rows = np.repeat(np.arange(len(tokens)), np.diff(t_at))
    before = g[np.arange(len(t)) - t_at[rows] + g_at[rows]]
    ends = np.cumsum(t + before)
    base = np.concatenate([[0], ends])[t_at[:-1]]
    starts = ends - t - base[rows]
    lists = [pa.ListArray.from_arrays(pa.array(t_at.astype(np.int32)), pa.array(x)) for x in (starts, t)]
    return pa.StructArray.from_arrays(lists, ["starts", "lengths"])


def by_term(terms: pa.ListArray) -> pa.ListArray:
    """Each row's different terms with their ascending positions: one stable sort of the rows' term numbers."""
    at = offsets(terms)
    words = pc.dictionary_encode(terms.flatten())
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = at - at[0]
    rows = np.repeat(np.arange(len(terms)), np.diff(at))
    key = rows * max(1, len(words.dictionary)) + codes
    order = np.argsort(key, kind="stable")
    begins = np.flatnonzero(np.diff(key[order], prepend=-1))
    positions = pa.ListArray.from_arrays(pa.array(np.append(begins, len(key)).astype(np.int32)), pa.array((np.arange(len(key)) - at[rows])[order].astype(np.int32)))
    entries = pa.StructArray.from_arrays([words.dictionary.take(pa.array(codes[order][begins])), positions], ["term", "positions"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[order][begins], np.arange(len(terms) + 1)).astype(np.int32)), entries)


def largest_so_far(hits: pa.ListArray) -> pa.ListArray:
    """Of each hit, the largest position up to it."""
    at = offsets(hits)
    pos, found = hits.flatten().field("pos").to_numpy(zero_copy_only=False), []
    at = at - at[0]
    for begin, end in slices(at):
        own = pos[at[begin] : at[end]].astype(np.int64)
        rows = np.repeat(np.arange(end - begin), np.diff(at[begin : end + 1]))
        # positions of later rows are lifted above those before, so that one pass does for all
        lift = int(own.max(initial=0)) + 1
        found.append(np.maximum.accumulate(own + rows * lift) - rows * lift if len(own) else own)
    null = hits.is_null()
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *found])), mask=null if null.true_count else None)


Hits = tuple[list[int], list[int]]  # positions, lengths


def by_document(f: Callable[[Sequence[Hits]], Hits], columns: pa.StructArray) -> pa.ListArray:
    """``f`` of the lists that each row has in the fields; null where a list or the result is missing."""
    slots = [columns.field(k) for k in range(columns.type.num_fields)]
    there = np.ones(len(columns), bool)
    for c in slots:
        there &= c.is_valid().to_numpy(zero_copy_only=False)
    split = [(offsets(c), c.values.field("pos").to_numpy(zero_copy_only=False), c.values.field("len").to_numpy(zero_copy_only=False)) for c in slots]
    sizes, found = np.zeros(len(columns) + 1, np.int64), []
    for begin, end in slices(sum(at for at, _, _ in split)):
        pos, length = [], []
        for k in (begin + np.flatnonzero(there[begin:end])).tolist():
            p, n = f([(x[at[k] : at[k + 1]].tolist(), y[at[k] : at[k + 1]].tolist()) for at, x, y in split])
            pos += p
            length += n
            sizes[k + 1] = len(p)
        found.append((np.array(pos, np.int64), np.array(length, np.int64)))
    values = [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (zip(*found) if found else ([], []))]
    hits = pa.StructArray.from_arrays(values, ["pos", "len"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), hits, mask=pa.array(sizes[1:] == 0))
