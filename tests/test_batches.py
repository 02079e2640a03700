"""What goes to Python of a search and of an index, and how much of it is worked on at once."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postingflow.functions import analysis
from postingflow.operators import index as i
from postingflow.operators import score
from postingflow.operators import search as s
from postingflow.plans import compile as c
from postingflow.plans.query import Adjacent, And, Not, Or, Term, parse_query

TEXTS = ["the a the b", "b b of the", "", None, "of the of the A", "c d"]


@pytest.fixture(scope="module")
def index(spark):
    return i.build_index(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_searches_send_no_text_to_python(spark, tmp_path, index):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    read = i.build_index(spark.read.parquet(f"{tmp_path}/docs"), check=False)
    expr = parse_query(read, "the b")
    result = s.perform_search(read, expr)
    a, b = Term("of"), Term("the")
    for df in (result, score.tf_idf_score(read, expr, result), s.hits(s.search(read, "the")), *(s.perform_search(read, e) for e in (And(a, a), Or(a, b), Not(b, a), Adjacent(a, b), And(Or(Adjacent(a, b), a), b)))):
        assert "Python" not in plan(df)
    assert "Python" not in plan(read.terms_of(["the"])) and "Python" not in plan(read.postings_of(["the", "zzz"]))
    assert {r.doc_id for r in result.collect()} == {0, 1}


@pytest.mark.parametrize("words", [[], ["the"], ["zzz"], ["the", "zzz", "of", "a", "b"], ["The", ""], ["b", "the", *(f"w{k}" for k in range(i.IN_ROW))]])
def test_postings_of_some_terms(index, words):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(index.postings_of(words)) == rows(index.postings.where(F.col("term").isin(words)))
    assert rows(index.terms_of(words)) == rows(index.terms.where(F.col("term").isin(words)))


def peak(f):
    """Result, and bytes that were in use beyond what was there, at most."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


ROWS, LENGTH = 10_000, 300


def lists(values):
    return pa.ListArray.from_arrays(pa.array(np.arange(0, ROWS * LENGTH + 1, LENGTH, dtype=np.int32)), values)


def test_ranges_of_a_large_batch():
    ones = lists(pa.array(np.ones(ROWS * LENGTH, np.int32)))
    parts, most = peak(lambda: [len(x) for x in analysis._byte_ranges.func(iter([(ones, ones)]))])
    assert sum(parts) == ROWS and most < 32 << 20
    first = next(analysis._byte_ranges.func(iter([(ones, ones)])))
    assert first[3].as_py() == {"starts": list(range(1, 2 * LENGTH, 2)), "lengths": [1] * LENGTH}


def test_terms_of_a_large_batch():
    words = lists(pa.array([f"w{k % 7}" for k in range(LENGTH)] * ROWS))
    parts, most = peak(lambda: [len(x) for x in analysis.by_term.func(iter([words]))])
    assert sum(parts) == ROWS and most < 32 << 20
    first = next(analysis.by_term.func(iter([words])))
    assert {e["term"]: e["positions"] for e in first[1].as_py()} == {f"w{k}": list(range(k, LENGTH, 7)) for k in range(7)}


def test_walks_of_a_large_batch(spark, monkeypatch):
    """What is kept of the walks is two numbers a hit, no Python objects."""
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: lambda column: f)
    run = c._by_document(lambda x: c.walk(x, 4), [F.lit(0), F.lit(1)])
    monkeypatch.undo()
    at = lambda k: lists(pa.StructArray.from_arrays([pa.array(np.tile(np.arange(1000 + k, 1000 + 2 * LENGTH, 2), ROWS)), pa.array(np.ones(ROWS * LENGTH, np.int64))], ["pos", "len"]))
    columns = pa.StructArray.from_arrays([at(0), at(1)], ["p0", "p1"])
    few = columns[:700]
    hits, most = peak(lambda: run(few))
    assert hits[5].as_py() == [{"pos": 1000 + k, "len": 1} for k in range(2 * LENGTH)] and len(hits) == 700
    assert most < 2.6 * 700 * 2 * LENGTH * 16


def test_lists_over_slices(spark):
    """Rows that are null, empty, or longer than a slice."""
    from postingflow.functions import batches

    rows = [None, [], [5, 1, 7], [], [2] * 9, None, [3, 1]]
    hits = pa.array([None if r is None else [{"pos": p, "len": 1} for p in r] for r in rows], pa.list_(pa.struct([("pos", pa.int64()), ("len", pa.int64())])))
    for most in (1, 4, 100):
        assert [e - b for b, e in batches.slices(np.array([0, 0, 3, 3, 12, 12, 14]), most)] == {1: [1, 1, 1, 1, 1, 1], 4: [3, 1, 2], 100: [6]}[most]
    assert list(batches.slices(np.array([0]))) == []
    assert batches.largest_so_far(hits).to_pylist() == [None, [], [5, 5, 7], [], [2] * 9, None, [3, 3]]
    assert batches.largest_so_far(hits[2:]).to_pylist() == [[5, 5, 7], [], [2] * 9, None, [3, 3]]
    assert batches.largest_so_far(hits[:0]).to_pylist() == []
