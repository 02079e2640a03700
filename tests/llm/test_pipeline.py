import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from postingflow.llm import packing, toxicity

from .test_jaccard_join import brute as near_pairs
from .test_jaccard_join import closed
from .test_line_dedup import brute as lines
from .test_packing import loads, one_by_one


def documents():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    line = lambda: " ".join(word() for _ in range(12)) + "."
    shared = [line() for _ in range(3)]
    rows = []
    for i in range(60):
        ls = [line() for _ in range(rng.randrange(1, 9))]
        if i % 10 == 3:
            ls += shared
        if i % 12 == 5:
            ls.insert(0, "you are an idiot and a worthless moron.")
        rows.append((i, "\n".join(ls)))
    for i in range(60, 80):
        ws = rows[rng.randrange(60)][1].replace("\n", " ").split(" ")
        ws[rng.randrange(len(ws))] = word()
        rows.append((i, " ".join(ws)))
    rows += [(80, rows[0][1]), (81, rows[14][1]), (82, None), (83, ""), (None, "alone and without an id"), (84, "w " * 5000)]
    return rows


def test_against_brute_force(spark, tmp_path):
    rows = documents()
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    score = toxicity.Scorer()
    left = [(i, t) for i, t in rows if score(t)[0] < toxicity.THRESHOLD]
    assert len(rows) - 9 < len(left) < len(rows)
    cleaned = lines(left)
    left = [(i, cleaned[i][0] if i in cleaned else t) for i, t in left if not (i in cleaned and cleaned[i][1] and not cleaned[i][0])]
    group = closed(near_pairs(left))
    left = [(i, t) for i, t in left if group.get(i, i) == i]
    docs = df
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) == sorted(left, key=repr)
    got = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in left}
    n = [len(t.split()) + 1 for _, t in left if t]
    pieces = [x for v in n for x in [packing.CAPACITY] * (v // packing.CAPACITY) + [v % packing.CAPACITY] if x]
    assert loads([(r.bin, r.offset, r.length) for r in got if r.length], packing.CAPACITY) == one_by_one(pieces, packing.CAPACITY)


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, empty.withColumn("label", F.lit(1)), str(tmp_path)).count() == 0


def test_rows_that_repeat(spark, tmp_path):
    """Another text with the id of a copy stays, of repeated rows one stays, and columns of any name come through."""
    near = "one two three four five six seven eight nine ten"
    rows = [(2, near), (3, near + " eleven"), (3, "something else entirely that stands alone here"), (1, "said twice by the same id"), (1, "said twice by the same id"), (None, near), (4, None), (4, None), (5, ""), (5, ""), (6, "..."), (6, "...")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("row", "r1", "kept", "a.b", "toxic", "lines_removed"):
        df = df.withColumn(c, F.lit("mine"))
    got = cp.drop_near_copies(spark, df, str(tmp_path))
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(2, near), rows[2], rows[3], *rows[6:]], key=repr)
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (cp.drop_toxic, cp.drop_repeated_lines):
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and out.where("`a.b` = 'mine' and toxic = 'mine' and lines_removed = 'mine'").count() == len(rows)
