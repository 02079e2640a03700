import random
import re

from pyspark.sql import functions as F

from postingflow.llm import jaccard_join as op
from postingflow.llm._graph import components

SF = "/root/testdata/sf0.01"


def gram_set(text, n=op.N):
    ws = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())
    return {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} or ({tuple(ws)} if ws else set())


def brute(rows, threshold=op.THRESHOLD):
    sets = [(i, gram_set(t)) for i, t in rows if t is not None and i is not None]
    out = {}
    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if i != j and a and b and min(len(a), len(b)) >= threshold * max(len(a), len(b)):
                s = len(a & b) / len(a | b)
                if s >= threshold:
                    out[min(i, j), max(i, j)] = s
    return out


def closed(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in up}


def words(text):
    return tuple(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower()))


def brute_classes(rows, pairs):
    """(id, class, copies, links, best) of rows with unique ids, from all pairs of ids."""
    label, text = closed(pairs), {i: words(t) for i, t in rows}
    out = []
    for i, w in text.items():
        partners = {}
        for (a, b), j in pairs.items():
            if i in (a, b) and text[a] != text[b]:
                partners[text[b if i == a else a]] = j
        out.append((i, label.get(i, i), sum(w == v for v in text.values()) if w else 1, len(partners), max(partners.values(), default=None)))
    return sorted(out, key=repr)


def test_plan():
    for t in (0.3, 0.5, 0.7, 0.9):
        for texts in (1, 10**4, 10**6):
            b, r = op.plan(t, 0.95, texts)
            assert 1 - (1 - t**r) ** b >= 0.95
    assert op.plan(0.5, 0.95, 10**6)[1] > op.plan(0.5, 0.95, 10**4)[1] == 4


def edge_rows():
    long = " ".join(f"w{k}" for k in range(60000))
    return [(1, "a b c d e"), (2, "A, b c; d e!"), (3, "a b c d e f"), (4, None), (5, ""), (6, "..."), (7, "a b"), (8, "A b"), (9, "b a"), (None, "a b c d e"), (10, long), (11, long + " x"), (3, "a b c d e f"), (3, "q r s t u v"), (12, "q r s t u v w")]


def clashing(df):
    for name in ("label", "k", "r1", "a.b", "CELL", "doc_id_a"):
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("id", F.lit(0)).withColumn("jaccard", F.lit(None).cast("int"))


def test_edges(spark):
    rows = edge_rows()
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in op.jaccard_join(df).collect()}
    want = brute(rows)
    # 2 is a copy of 1 and stands for nothing else
    assert got == {k: v for k, v in want.items() if 2 not in k or k == (1, 2)}
    assert op.jaccard_join(df.limit(0)).count() == 0 == op.near_classes(df.limit(0)).count()


def test_classes_of_edges(spark):
    got = op.near_classes(clashing(spark.createDataFrame(edge_rows(), "doc_id long, text string"))).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.class_id, r.copies, r.links, r.kept))
    assert by[1] == [(1, 3, 1, True)] and by[2] == by[None] == [(1, 3, 1, False)]
    assert sorted(by[3]) == [(1, 2, 1, False)] * 2 + [(3, 1, 1, True)] and by[12] == [(3, 1, 1, False)]
    assert by[4] == [(4, 1, 0, True)] and by[5] == [(5, 1, 0, True)] and by[6] == [(6, 1, 0, True)]
    assert by[7] == [(7, 2, 0, True)] and by[8] == [(7, 2, 0, False)] and by[9] == [(9, 1, 0, True)]
    assert by[10] == [(10, 1, 1, True)] and by[11] == [(10, 1, 1, False)]
    assert sum(map(len, by.values())) == len(edge_rows())


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    full = brute_classes(rows, want)
    got = sorted((tuple(r) for r in op.query(spark, SF).collect()), key=repr)
    assert [r[0] for r in got] == [r[0] for r in full] and [r[2] for r in got] == [r[2] for r in full]
    assert sum(a[1] == b[1] for a, b in zip(got, full)) / len(full) > 0.99
    assert all(a[3] <= b[3] for a, b in zip(got, full)) and sum(r[3] for r in got) >= 0.95 * sum(r[3] for r in full) > 0
    pairs = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in op.jaccard_join(docs).collect()}
    assert all(abs(want[k] - v) < 1e-12 for k, v in pairs.items())
    # pairs of classes, and membership: with these, no pair is left out
    rep = {}
    for i, t in sorted(rows):
        rep.setdefault(words(t), i)
    need = [(a, b) for a, b in want if words(dict(rows)[a]) == words(dict(rows)[b]) and rep[words(dict(rows)[a])] == a or {rep[words(dict(rows)[a])], rep[words(dict(rows)[b])]} == {a, b}]
    assert set(pairs) <= set(need) and len(pairs) / len(need) >= 0.95


def test_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randrange(400)}" for _ in range(80)]
    rows = [(k, " ".join(rng.choice(base) if rng.random() < 0.06 else w for w in base)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, classes = sorted(op.jaccard_join(df).collect()), sorted(op.near_classes(df).collect())
    assert {(r.doc_id_a, r.doc_id_b) for r in one} == set(brute(rows)) and len(one) > 300
    assert [(r.doc_id, r.class_id, r.copies, r.links, r.best) for r in classes] == sorted(brute_classes(rows, brute(rows)))
    monkeypatch.setattr(op, "CELL_BYTES", 2000)
    monkeypatch.setattr(op, "CELL_ROWS", 13)
    monkeypatch.setattr(op, "BUCKET_ROWS", 7)
    monkeypatch.setattr(op, "GRAMS_AT_ONCE", 500)
    assert sorted(op.jaccard_join(df).collect()) == one and sorted(op.near_classes(df).collect()) == classes


def test_chance_meetings_tie_nothing(spark):
    """Texts of one template, a quarter alike, meet in bands all the time; cells hold true groups nevertheless."""
    rng = random.Random(4)
    shared = [f"s{k}" for k in range(40)]
    rows = [(k, " ".join([*shared, *(f"x{rng.randrange(10**9)}" for _ in range(55))])) for k in range(400)]
    rows += [(1000 + k, rows[k][1] + " end") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    join = op.Join(df, "doc_id", "text", op.N, op.THRESHOLD, op.RECALL)
    cells = [r["count"] for r in join.linked.groupBy("cell").count().collect()]
    assert max(cells) <= 8 and sum(cells) < 150, sorted(cells)
    assert {(r.doc_id_a, r.doc_id_b) for r in op.jaccard_join(df).collect()} == {(k, 1000 + k) for k in range(20)}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(0, 200)] + [(rng.randrange(1000, 3000), rng.randrange(1000, 3000)) for _ in range(900)]
    df = spark.createDataFrame([*pairs, (None, 3), (7, 7), (5000, 5000)], "a long, b long")
    got = {r.node: r.label for r in components(df).collect()}
    want = {k: v for k, v in closed(pairs).items() if k in got}
    assert got == want and len(got) > 1000
