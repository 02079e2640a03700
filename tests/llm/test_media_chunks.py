import random

import numpy as np
from pyspark.sql import functions as F

from postingflow.llm import media_chunks as op

SF = "/root/testdata/sf0.01"


def scalar_cuts(data):
    """Byte by byte, as a rolling gear hash is defined."""
    ends, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(op._GEAR[b])) & 0xFFFFFFFF
        size = i + 1 - start
        if size >= op.MIN and h >> (32 - op.AVERAGE_BITS) == 0 or size == op.MAX:
            ends.append(i + 1)
            start = i + 1
    return ends + ([len(data)] if start < len(data) else [])


def test_cuts_equal_rolling_hash():
    rng = random.Random(6)
    rows = [rng.randbytes(n) for n in (0, 1, 31, 255, 256, 257, 5000, 60000)] + [b"\0" * 30000, b"ab" * 9000]
    data = np.frombuffer(b"".join(rows), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = [[e - a for e in ends] for ends, a in zip(op.cuts(data, offs), offs)]
    assert got == [scalar_cuts(r) for r in rows]


def test_insertion_moves_few_cuts():
    rng = random.Random(7)
    a = rng.randbytes(200000)
    b = a[:70000] + b"inserted" + a[70000:]
    pieces = [{x[s:e] for s, e in zip([0, *c], c)} for x in (a, b) for c in [scalar_cuts(x)]]
    assert len(pieces[0] & pieces[1]) > 0.95 * len(pieces[0])


def test_round_trip(spark):
    text = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op.query(spark, SF).cache()
    rows = got.collect()
    assert len(rows) == len(text) and all(r.verified and r.n_bytes == len(text[r.doc_id]) for r in rows)
    assert all([c.length for c in r.chunks] == list(np.diff([0, *scalar_cuts(text[r.doc_id])])) for r in rows[:50])
    owned = [c.digest for r in rows for c in r.chunks if c.owned]
    every = {bytes(c.digest) for r in rows for c in r.chunks}
    assert len(owned) == len(every) == op.store(got).count()
    assert sum(len(r.frames) for r in rows) == len(owned)
    back = op.reconstruct(got, op.store(got)).collect()
    assert {r.doc_id: bytes(r.payload) for r in back} == text and all(r.verified for r in back)
    got.unpersist()


def test_edges(spark):
    big = random.Random(1).randbytes(3_000_000)
    rows = [(1, b"x" * 1000), (1, b"x" * 1000), (1, b"other"), (2, None), (3, b""), (None, b"no id" * 300), (None, b"no id two"), (4, big), (5, big[:1_500_000] + b"?" + big[1_500_000:])]
    df = spark.createDataFrame(rows, "doc_id long, text binary").withColumn("chunks", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("mark", F.lit(None).cast("int"))
    got = op.chunk_media(df).cache()
    assert got.count() == 8 and got.where("verified").count() == 8
    back = {(r.doc_id, bytes(r.payload)) for r in op.reconstruct(got, op.store(got)).where("verified").collect()}
    assert back == {r for r in rows if r[1] is not None}
    five = got.where("doc_id = 5").first()
    assert sum(c.owned for c in five.chunks) < 6
    lost = op.reconstruct(got, op.store(got).limit(0)).where("not verified").count()
    assert lost == 6
    assert op.chunk_media(df.limit(0)).count() == 0
    got.unpersist()
