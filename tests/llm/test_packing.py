import random
import re
from collections import Counter

from pyspark.sql import functions as F

from postingflow.llm import packing as op

SF = "/root/testdata/sf0.01"


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a piece at a time; the space left in each bin."""
    spaces = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, s in enumerate(spaces) if s >= n]
        if fits:
            k = min(fits, key=lambda k: spaces[k])
            spaces[k] -= n
        else:
            spaces.append(capacity - n)
    return sorted(spaces)


def loads(rows, capacity):
    """Checks that nothing overlaps; the space left in each bin."""
    by = {}
    for b, o, n in rows:
        by.setdefault(b, []).append((o, n))
    out = []
    for b, ps in by.items():
        end = 0
        for o, n in sorted(ps):
            assert o == end, (b, ps)
            end = o + n
        assert end <= capacity
        out.append(capacity - end)
    assert set(by) == set(range(len(by)))
    return sorted(out)


def test_plan_equals_one_by_one():
    rng = random.Random(4)
    for _ in range(400):
        capacity = rng.choice([1, 2, 7, 10, 64, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(0, 200))]
        runs, bins = op.plan(Counter(lengths), capacity)
        rows = [(r.bin + k // r.each, r.offset + k % r.each * r.length, r.length) for r in runs for k in range(r.count)]
        assert sorted(x[2] for x in rows) == sorted(lengths)
        want = one_by_one(lengths, capacity)
        assert loads(rows, capacity) == want and bins == len(want)
        assert len(runs) <= 4 * capacity + 4


def test_query_equals_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = {r.doc_id: len(re.findall(r"\S+", r.text)) + 1 for r in docs.collect()}
    got = op.query(spark, SF).collect()
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, []).append((r.start, r.length, r.piece))
    for i, ps in spans.items():
        ps.sort()
        assert [p[2] for p in ps] == list(range(len(ps))) and sum(p[1] for p in ps) == n[i] and all(a[0] + a[1] == b[0] for a, b in zip(ps, ps[1:]))
    assert set(spans) == set(n)
    pieces = [x for v in n.values() for x in [op.CAPACITY] * (v // op.CAPACITY) + [v % op.CAPACITY] if x]
    assert loads([(r.bin, r.offset, r.length) for r in got], op.CAPACITY) == one_by_one(pieces, op.CAPACITY)


def test_edges(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, "  \n "), (None, "x"), (None, "x"), (5, "w " * 25), (6, "q " * 9), (7, "q " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("rest", F.lit(1)).withColumn("shard", F.lit(1)).withColumn("rank", F.lit(1))
    for per in (1, 1000):
        got = op.pack(df, capacity=10, rows_per_shard=per).collect()
        assert sorted((str(r.doc_id), r.length) for r in got) == sorted([("1", 4), ("1", 4), ("2", 0), ("3", 0), ("4", 0), ("None", 2), ("None", 2), ("5", 10), ("5", 10), ("5", 6), ("6", 10), ("7", 10)])
        assert loads([(r.bin, r.offset, r.length) for r in got if r.length], 10) == one_by_one([4, 4, 2, 2, 10, 10, 6, 10, 10], 10)
        assert all(r.bin is None for r in got if not r.length)
    assert op.pack(df.limit(0)).count() == 0
    assert op.pack(df, F.lit(None).cast("int")).where("bin is null").count() == len(rows)


def test_one_id_is_many_shards(spark):
    """Rows without an id, all of one length, are ranked side by side."""
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit(1).alias("row"))
    got = op.pack(df, capacity=10, rows_per_shard=200).collect()
    assert len(got) == 3000 and len({(r.bin, r.offset) for r in got}) == 3000 and max(r.bin for r in got) == 1499
