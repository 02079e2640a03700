import random

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from postingflow.llm import training_order as op
from postingflow.llm._spark import filesystem, shared_folder

SF = "/root/testdata/sf0.01"


def test_permutation():
    for n in (1, 2, 3, 4, 5, 16, 17, 1000, 65536, 100003):
        got = op.feistel(np.arange(n), n)
        assert sorted(got) == list(range(n))
        assert (op.feistel(np.arange(n)[::-1], n)[::-1] == got).all()
    a, b = op.feistel(np.arange(10000), 10000, 1), op.feistel(np.arange(10000), 10000, 2)
    assert (a == b).mean() < 0.01
    assert abs(np.corrcoef(a, np.arange(10000))[0, 1]) < 0.05
    assert len(op.feistel(np.arange(0), 0)) == 0


def test_query_and_resume(spark):
    ranks = op.load_ranks()
    enc = tiktoken.Encoding("own", pat_str=op.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    folder = shared_folder(spark, "test-order")
    index = op.materialise(docs, ranks, folder, stride=256, per_shard=700).collect()
    n = len(index)
    assert sorted(r.slot for r in index) == list(range(n))
    assert all(r.shard == r.slot // 700 and r.offset == r.slot % 700 * 512 for r in index)
    data = list(op.read_slots(folder, 0, n + 5, stride=256, per_shard=700))
    assert len(data) == n
    tail = list(op.read_slots(folder, 690, 720, stride=256, per_shard=700))
    assert len(tail) == 30 and all((x == y).all() for x, y in zip(tail, data[690:720]))
    got = {}
    for r in index:
        assert (data[r.slot][r.n_tokens :] == op.END).all() and sum(d.length for d in r.docs) == r.n_tokens
        for d in r.docs:
            got.setdefault(d.doc_id, []).append((d.start, data[r.slot][d.at : d.at + d.length].tolist()))
    whole = {i: [x for _, part in sorted(parts) for x in part] for i, parts in got.items()}
    assert whole == {i: enc.encode_ordinary(t) + [op.END] for i, t in text.items()}
    assert sum(r.n_tokens < 256 for r in index) <= docs.rdd.getNumPartitions()
    rows = op.query(spark, SF).collect()
    assert sum(r.n_tokens for r in rows) == sum(map(len, whole.values()))


def test_words_equal_whole_texts():
    rng = random.Random(12)
    tokens = op.Tokens(op.load_ranks())
    alphabet = ["a", "The", "ing", "é", "1", "23", "'s", ".", ",", " ", " ", " ", "\n", "\t", "\r", "\x0b", "\u00a0", "\u3000", "\u2028", "\x1c", "🎉", "梦", "—", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25))) for _ in range(6000)]
    ids, offs = tokens.batch(pa.array([*texts, None]))
    for k, t in enumerate(texts):
        assert ids[offs[k] : offs[k + 1]].tolist() == tokens.encoding.encode_ordinary(t), repr(t)


def test_edges(spark):
    ranks = op.load_ranks()
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, None), (3, ""), (4, "w " * 5000), (5, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash")).withColumn("part", F.lit(1))
    folder = shared_folder(spark, "test-order")
    got = op.materialise(df, ranks, folder, stride=64, per_shard=10).collect()
    n = len(got)
    assert sorted(r.slot for r in got) == list(range(n))
    docs = [d.doc_id for r in got for d in r.docs if d.start == 0]
    assert sorted(docs, key=str) == [1, 1, 4, 5, None]
    assert len(list(op.read_slots(folder, 0, n, stride=64, per_shard=10))) == n
    empty = shared_folder(spark, "test-order")
    assert op.materialise(df.limit(0), ranks, empty).count() == 0
    assert list(op.read_slots(empty, 0, 5)) == []


def test_counts_equal_cuts():
    tokens = op.Tokens(op.load_ranks())
    texts = pa.array(["", None, " ", "a b", "a  b", "\n a", "a \n", " ".join(["w"] * 3000), "x" * 50000, "a\u3000 b c"])
    ids, offs = tokens.batch(texts)
    assert tokens.batch(texts, count=True)[1].tolist() == offs.tolist() and offs[-1] == len(ids)
    assert tokens.batch(texts.slice(0, 0))[1].tolist() == [0]


def test_attempts_leave_each_other_alone(spark):
    """A second attempt of a task writes other files; readers follow the manifest."""
    df = spark.createDataFrame([(k, f"some words of text {k}") for k in range(200)], "doc_id long, text string")
    folder = shared_folder(spark, "test-order")
    index = op.materialise(df, op.load_ranks(), folder, stride=64, per_shard=5)
    names = op.manifest(folder)
    assert {r.shard: r.file for r in index.collect()} == names and len(names) > 1
    files, base = filesystem(folder)
    before = list(op.read_slots(folder, 0, 1000, stride=64, per_shard=5))
    for name in names.values():
        with files.open_output_stream(f"{base}/{name.rsplit('-', 1)[0]}-99999.bin") as f:
            f.write(b"half of a shard")
    after = list(op.read_slots(folder, 0, 1000, stride=64, per_shard=5))
    assert len(before) == index.count() and all((x == y).all() for x, y in zip(before, after))
