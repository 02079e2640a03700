import random
import re

from pyspark.sql import functions as F

from postingflow.llm import toxicity as op

SF1 = "/root/testdata/sf0.1"


def naive(classes, weights=None):
    """(score, weight of plain unaimed insults) of a clause by looking back from every insult and threat, without machines."""
    n, near = len(classes), op.NEAR
    weights = weights or [1.0] * n

    def factors(k):
        negated = any(classes[j] in (op.NEGATION, op.NOT_ARE) for j in range(max(0, k - near), k))
        return (0.5 if op.REPORT in classes[:k] else 1.0) * (0.3 if negated else 1.0)

    said, threats, pending = [op.COPULA if c == op.NOT_ARE else c for c in classes], {}, None
    for k, c in enumerate(classes):
        if c == op.THREAT:
            pending, said[k] = k, op.OTHER
        elif c in (op.TARGET, op.YOU) and pending is not None and k - pending <= near:
            threats[k], pending, said[k] = 2.0 * factors(pending), None, op.THREAT
    people = (op.TARGET, op.YOU, op.YOU_ARE, op.THREAT)

    def aimed(k):
        for j in range(k - 1, max(-1, k - op.VOCATIVE - 1), -1):
            if said[j] == op.YOU:
                return True
            if said[j] in (*people, op.COPULA, op.PREPOSITION):
                break
        for j in range(k - 1, max(-1, k - near - 1), -1):
            if said[j] == op.PREPOSITION:
                return False
            if said[j] == op.YOU_ARE or said[j] == op.COPULA and any(said[i] in people for i in range(max(0, j - near), j)):
                return True
        return False

    total = sum(x * weights[k] for k, x in threats.items())
    plain = 0.0
    for k, c in enumerate(classes):
        if c in (op.INSULT, op.LOOSE):
            base = 1.5 if aimed(k) else op.UNAIMED if c == op.INSULT else 0.0
            total += base * factors(k) * weights[k]
            plain += weights[k] if base == op.UNAIMED and factors(k) == 1 else 0.0
    return total, plain


def naive_text(text, words, stems):
    """Score of a text: its highest clause, or the density of plain insults where two clauses hold them."""
    best = loose = holding = whole = 0
    for clause in re.split(r"[.!?;\n]", (text or "").lower().replace("\u2019", "'")):
        whole += bool(clause.strip())
        known = []
        for w in re.findall(r"[\w']+|[\"\u201c\u201d\u00ab\u00bb]", clause):
            w = w.strip("'")
            c = op.CLASSES.get(w, op.OTHER)
            if w in words and c in (op.OTHER, op.LOOSE):
                c = op.INSULT, words[w]
            elif c == op.OTHER and (stem := next((w[:n] for n in op.STEM if w[:n] in stems), None)) and w not in op.CLASSES:
                c = op.INSULT, stems[stem]
            else:
                c = c, 1.0
            if w:
                known.append(c)
        score, plain = naive([c for c, _ in known], [x for _, x in known])
        best, loose, holding = max(best, score), loose + plain, holding + (plain > 0)
    if holding > 1:
        best = max(best, loose / op.ENOUGH * min(1.0, loose / (op.DENSITY * whole)))
    return best


def test_composition_equals_naive_scan():
    rng = random.Random(5)
    kinds = [op.OTHER, op.INSULT, op.THREAT, op.TARGET, op.NEGATION, op.REPORT, op.LOOSE, op.YOU, op.COPULA, op.YOU_ARE, op.PREPOSITION, op.NOT_ARE]
    for _ in range(20000):
        classes = rng.choices(kinds, [6, 2, 2, 2, 1, 1, 2, 2, 2, 1, 1, 1], k=rng.randrange(0, 14))
        got, want = op.clause_score(classes), naive(classes)
        assert abs(got[0] - want[0]) < 1e-9 and abs(got[1] - want[1]) < 1e-9, classes


def test_query_equals_naive_scores(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    words, stems = op.learned_words(docs, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.tox_score, r.toxic) for r in op.query(spark, sf).collect()}
    assert got.keys() == text.keys() and sum(t for _, t in got.values()) > 20
    for i, t in text.items():
        want = naive_text(t, words, stems)
        assert abs(got[i][0] - want) < 1e-5 and got[i][1] == (round(want, 6) >= op.THRESHOLD), i


def test_clauses():
    s = op.Scorer({"zorg": 1.0}, {"blar": 0.5})
    assert s("You are an idiot.")[0] == s("He is an 'idiot'")[0] == s("you moron")[0] == 1.5
    assert s("You are not an idiot.")[0] == s("You aren\u2019t an idiot.")[0] == 0.45
    assert s("He said: you idiot.")[0] == 0.75
    assert s("I will kill you.") == (2.0, 1, "threat")
    assert s("kill the process.")[0] == 0.0
    assert s("idiotic trashcan, morons_x")[0] == 0.0
    assert s("ZORG and a zorg.")[0] >= 1 > s("A zorg.")[0] > 0
    assert s("a blarnik. xblar")[:2] == (op.UNAIMED / 2, 1)
    assert s(None) == s("") == (0.0, 0, "")
    assert s("fine words. " * 20000 + "you idiot")[0] == 1.5


def test_benign_texts():
    s = op.Scorer()
    for text in ("The garbage truck collects trash on Monday.", "He kept the trash in the clown car", "She isn\u2019t stupid. They aren\u2019t stupid. It isn\u2019t trash. We aren\u2019t losers.", "What an idiot.", "They were in the garbage truck.", "A stupid mistake. A pathetic excuse. Dumb luck.", "The clown is here. The trash is out.", "fine words. " * 200 + "An idiot. " + "fine words. " * 200 + "A moron.", "He said: you idiot. She said: you moron. They said: you coward."):
        assert s(text)[0] < op.THRESHOLD, text
    for text in ("You are trash.", "these people are vermin", "du Idiot", "vous \u00eates un idiot", "you're a clown", "tu es minable", "An idiot. A moron. A loser.", "you stupid, worthless idiot"):
        assert s(text)[0] >= op.THRESHOLD, text


def test_edges(spark):
    rows = [(1, "you idiot"), (2, None), (3, ""), (None, "a moron and a moron"), (5, "hello"), (5, "hello")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("TOXIC", F.lit("clash")).withColumn("word", F.lit(1))
    for c in ("__tox", "tox", "row", "a.b"):
        df = df.withColumn(c, F.lit("mine"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, None), (5, 0)], "doc_id long, toxic int")
    out = op.toxicity(df, labels)
    assert out.columns == ["doc_id", "text", "word", "__tox", "tox", "row", "a.b", "tox_score", "tox_clauses", "tox_kinds", "toxic"]
    assert out.where("`a.b` = 'mine' and __tox = 'mine' and tox = 'mine' and row = 'mine'").count() == 6
    got = sorted((str(r.doc_id), r.toxic) for r in out.collect())
    assert got == [("1", True), ("2", False), ("3", False), ("5", False), ("5", False), ("None", True)]
    assert op.toxicity(df.limit(0), labels.limit(0)).count() == 0
    assert op.toxicity(df, None).count() == 6


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    half = F.xxhash64("doc_id") % 2 == 0
    got = op.toxicity(docs.select("doc_id", "text"), labels.where(half)).select("doc_id", F.col("toxic").alias("said"))
    n = {(r.toxic, r.said): r["count"] for r in labels.where(~half).join(got, "doc_id").groupBy("toxic", "said").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.85, n
    assert n.get((0, True), 0) / (n[0, False] + n.get((0, True), 0)) < 0.01, n


def test_threats_of_each_language():
    s = op.Scorer()
    for text in ("I will kill you", "ich werde dich töten", "ich will euch alle umbringen", "ich werde sie töten", "je vais te tuer", "je vais vous tuer", "il faut les tuer", "je vais t'égorger", "voy a matarte", "te voy a matar", "os voy a golpear", "voy a golpearlos"):
        assert s(text) == (2.0, 1, "threat"), text
    assert s("no voy a matarte")[0] == 0.6 and s("dijo: te voy a matar")[0] == 1.0
    for text in ("you can kill the process", "tuer le temps", "les jours passent sans tuer", "voy a matar el tiempo", "vous allez tuer le temps", "der Plan will Zeit töten"):
        assert s(text)[0] == 0.0, text
