import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from postingflow.llm import pieces as op

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return op.Pieces.load()


@pytest.fixture(scope="module")
def truth():
    return sentencepiece.SentencePieceProcessor(model_file=op.MODEL)


def test_random_texts(model, truth):
    rng = random.Random(8)
    e = op.Encoder(model)
    alphabet = ["a", "b", "e", "n", "th", "ing", "er", " ", " ", "  ", "\n", "é", "ß", "Ö", "1", "23", "...", "梦", "☃", "🎉", "́", "\t", "#", "zzz", "The"]
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30)))
        assert e.text(t).tolist() == truth.encode(t), t
    for n in (1, 2, 15, 16, 17, 33, 100):
        for t in (" " * n, "a" * n, "=" * n, "ab" * n, " " * n + "x", "x" + " " * n):
            assert e.text(t).tolist() == truth.encode(t), t


def test_query(spark, truth):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op.query(spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert r.piece_ids == truth.encode(text[r.doc_id]) and r.decodes


def test_edges(spark, model, truth):
    texts = [None, "", " ", "hello  world ", "a b", "a b", "x" * 100000, "word " * 30000, "▁", "nül\u0000l", "퟿\U0010ffff"]
    df = spark.createDataFrame([(None if k == 4 else k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("piece_ids", F.lit("clash")).withColumn("same", F.lit(1))
    for c in ("__new", "new", "row", "a.b", "DECODES"):
        df = df.withColumn(c, F.lit("mine"))
    got = op.encode(df, model)
    assert got.columns == ["doc_id", "text", "ids", "same", "__new", "new", "row", "a.b", "piece_ids", "decodes"]
    assert got.where("`a.b` = 'mine' and new = 'mine' and row = 'mine'").count() == len(texts)
    for r in op.decode(got, model).collect():
        if r.text is None:
            assert r.piece_ids == [] and r.decodes is None and r.decoded == ""
        else:
            assert r.piece_ids == truth.encode(r.text)
            assert r.decodes == (op.MARK not in r.text) and (r.decoded == r.text) == r.decodes
    assert op.encode(df.limit(0), model).count() == 0
    lists = spark.createDataFrame([([1, 2],), ([],), (None,), ([99999],), ([None],)], "piece_ids array<int>")
    assert [r.decoded for r in op.decode(lists, model).collect()] == ["", "", None, None, None]
