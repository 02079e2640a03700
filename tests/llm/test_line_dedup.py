import time

from pyspark.sql import functions as F

from postingflow.llm import line_dedup as op


def brute(rows):
    """(id, text) with unique ids -> (text, removed)."""
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0])):
        ls = t.split("\n")
        cover = set()
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            cover |= {p, p + 1, p + 2} if w in seen else set()
            seen.add(w)
        out[i] = ("\n".join(x for k, x in enumerate(ls) if k not in cover), len(cover))
    return out


def test_edges(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb\nc"), (4, "a\na\na\na\na"), (5, None), (6, ""), (7, "a\nb"), (8, "\n\n\n\n"), (9, "b\nc\nd\nq"), (None, "n\nb\nc\nd"), (11, "\n".join(f"l{i}" for i in range(20000))), (12, "\n".join(f"l{i}" for i in range(19990, 20000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("pos", F.lit("x")).withColumn("lines_removed", F.lit("clash"))
    got = {r.doc_id: (r.text, r.lines_removed) for r in op.line_dedup(df).collect()}
    assert got == brute(rows) | {5: (None, 0)}
    assert op.line_dedup(df).columns == ["doc_id", "text", "h", "pos", "lines_removed"]
    assert op.line_dedup(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a\nb\nc")] * 2, "doc_id long, text string")
    assert [r.lines_removed for r in op.line_dedup(twice).collect()] == [0, 0]


def test_any_column_names(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc\nd")], "doc_id long, text string")
    names = ["__doc", "__sum", "__cover", "doc", "sum", "row", "left", "a.b", "x`y", "doc2"]
    for c in names:
        df = df.withColumn(c, F.lit("keep " + c))
    df = df.withColumn("LINES_REMOVED", F.lit(7))
    got = {r.doc_id: r for r in op.line_dedup(df).collect()}
    assert op.line_dedup(df).columns == ["doc_id", "text", *names, "lines_removed"]
    assert [got[2][c] for c in names] == ["keep " + c for c in names] and (got[2].text, got[2].lines_removed) == ("d", 3)


def test_very_long_text(spark):
    """Two copies of 200,000 lines, one with a line of its own in the middle."""
    lines = [f"line {k}" for k in range(200_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join([*lines[:90_000], "own", *lines[90_000:]]))]
    begin = time.time()
    got = {r.doc_id: (r.text, r.lines_removed) for r in op.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and got[2] == ("own", 200_000) and time.time() - begin < 60


def test_sql(same):
    same(op.query, op.SQL)
