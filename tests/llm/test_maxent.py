import math
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postingflow.llm import maxent as op

SF = "/root/testdata/sf0.01"


def model_of(rng, scale, own=None):
    """A model of random weights over random own words."""
    outcomes = op.CLASSES * op.GROUPS * op.PLACES
    known = rng.integers(0, 2**63, outcomes * 3 // 4, dtype=np.uint64)
    m = op.Model(known, rng.integers(0, 50, outcomes))
    for w in m.weights:
        w[:] = rng.normal(size=w.shape) * scale
    return m, known


def test_probabilities_sum_to_one():
    m, _ = model_of(np.random.default_rng(1), 1)
    f = m.features(np.array([5, 9, 700], np.uint64), np.zeros(3, np.int64))[2:]
    y = np.arange(op.CLASSES * op.GROUPS * op.PLACES)
    p = np.ones(len(y))
    for part, (at, row, column) in enumerate(m.parts(np.repeat(f, len(y), 0), y)):
        p *= m.softmax(m.weights[part], m.base[part], at, row)[y, column]
    assert abs(p.sum() - 1) < 1e-4


def test_untrained_model_is_the_unigram():
    rng = np.random.default_rng(6)
    m, known = model_of(rng, 0)
    count = np.concatenate([np.arange(len(known), 0, -1) * 10**6, np.full(m.buckets, 10**6)])
    m = op.Model(known, count)
    got = m.score(known[:300], np.zeros(300, np.int64))
    assert np.abs(got - np.log(count[:300] / count.sum())).max() < 1e-3


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    m, known = model_of(rng, 0.3)
    h = known[rng.integers(0, 40, 300)]
    rows = np.repeat(np.arange(3), 100)
    g = m.zeros()
    m.gradient(h, rows, g)
    for w, d in zip(m.weights, g):
        r, c = np.unravel_index(np.argsort(-np.abs(d).ravel())[:5], d.shape)
        for i, j in zip(r, c):
            old = w[i, j]
            w[i, j] = old + 0.02
            high = m.score(h, rows).sum()
            w[i, j] = old - 0.02
            low = m.score(h, rows).sum()
            w[i, j] = old
            assert abs((high - low) / 0.04 - d[i, j]) < 0.02 * max(1, abs(d[i, j]))


def test_gradient_takes_less_time_than_columns_one_by_one():
    """The same sums as counts of weighted rows in double precision, column by column, in less CPU time."""
    rng = np.random.default_rng(8)
    m, known = model_of(rng, 0.1)
    h = known[rng.zipf(1.3, 120_000) % len(known)]
    rows = np.repeat(np.arange(300), 400)

    def columns():
        y, f = m.outcome(h), m.features(h, rows)
        sums = [np.zeros(w.shape[::-1]).T for w in m.weights]
        for a in range(0, len(h), 1 << 15):
            for part, (at, row, column) in enumerate(m.parts(f[a : a + (1 << 15)], y[a : a + (1 << 15)])):
                d = -m.softmax(m.weights[part], m.base[part], at, row).T.astype(float)
                d[column, np.arange(len(column))] += 1
                at = np.ravel(at if len(at) == op.FEATURES else at.T)
                for k, values in enumerate(d):
                    sums[part][:, k] += np.bincount(at, np.tile(values, op.FEATURES), len(sums[part]))
        return sums

    def rows_at_once():
        sums = m.zeros()
        m.gradient(h, rows, sums)
        return sums

    def best(f):
        took = []
        for _ in range(3):
            begin = time.thread_time()
            out = f()
            took.append(time.thread_time() - begin)
        return out, min(took)

    (want, slow), (got, quick) = best(columns), best(rows_at_once)
    for g, w in zip(got, want):
        assert np.abs(g - w).max() < 1e-4 * np.abs(w).max()
    assert quick < 0.85 * slow, (quick, slow)


def test_sums_of_many_chunks(spark, monkeypatch):
    """A task's sums are the same however many of them are put together."""
    words = op.Words(op.lowered(spark.read.parquet(f"{SF}/documents.parquet")))
    batch = pa.RecordBatch.from_pydict({"text": [r.text for r in op.lowered(spark.read.parquet(f"{SF}/documents.parquet")).limit(60).collect()]})
    spread = type("", (), {"value": op.Model(words.known, words.count)})
    sums = lambda: {(b["part"][0].as_py(), b["block"][0].as_py()): np.frombuffer(b["g"][0].as_py(), np.float32) for b in op._gradients(spread)(iter([batch] * 3))}
    whole = sums()
    monkeypatch.setattr(op, "CHUNK", 1)
    monkeypatch.setattr(op, "SLICE", 1 << 12)
    parts = sums()
    assert whole.keys() == parts.keys() and len(whole)
    assert all(np.abs(g - parts[k]).max() < 1e-4 * max(1, np.abs(g).max()) for k, g in whole.items())


def test_places():
    """As a binary search finds them: no key, one, many, and keys that share their leading bits or repeat the ends."""
    rng = np.random.default_rng(4)
    any_ = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    low, ends = np.arange(0, 30_000, 3, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)
    for keys in (any_[:0], any_[:1], np.sort(any_[:3000]), low, np.sort(np.concatenate([low, any_[:50]])), ends):
        h = np.concatenate([any_, low, low + np.uint64(1), ends])
        at, hit = op.Places(keys).find(h)
        assert (hit == np.isin(h, keys)).all() and (keys[at[hit]] == h[hit]).all()
    assert op.Places(low).probes > op.PROBES


def plain_features(words, k):
    """Hashed features of a position, in whole numbers of any size."""
    a, b, c = (words[k - d] if k >= d else 1 for d in (1, 2, 3))
    wrap = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & wrap
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & wrap
        return x ^ x >> 31

    parts = [a + (1 << 20), a * 0x9FB21C651E98DF25 + b + (1 << 40), b + (2 << 20), c + (3 << 20)]
    return [mix(p * 0x9E3779B97F4A7C15 & wrap) for p in parts], mix, wrap


def test_query_equals_a_plain_model(spark, tmp_path, monkeypatch):
    """Counts, training and scores of a small table again, word by word with dictionaries of weights."""
    monkeypatch.setattr(op, "CLASSES", 2)
    monkeypatch.setattr(op, "HEAD", 0)
    rng = np.random.default_rng(5)
    vocabulary = [f"v{k}" for k in range(3000)]
    share = 1 / np.arange(80, 3080)
    rows = [(k, " ".join(rng.choice(vocabulary, 40, p=share / share.sum()))) for k in range(60)] + [(60, None), (61, ""), (62, "v1 V2 v3")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.lm_words, r.lm_logprob) for r in op.query(spark, str(tmp_path)).collect()}

    texts = {i: (t or "").lower().split() for i, t in rows}
    count = Counter(w for ws in texts.values() for w in ws)
    h = dict(zip(count, next(op._words(pa.array([" ".join(count)])))[2].tolist()))
    outcomes = 2 * op.GROUPS * op.PLACES
    own, buckets = outcomes * 3 // 4, outcomes // 4
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    known = sorted(count, key=lambda w: (-count[w], signed(h[w])))[:own]
    y = {w: own + h[w] % buckets for w in count} | {w: k for k, w in enumerate(known)}
    total = Counter()
    for w in count:
        total[y[w]] += count[w]
    log_base = lambda some, all_: math.log((sum(total[o] for o in some) + 1) / (sum(total[o] for o in all_[0]) + all_[1]))
    group = lambda g: range(g * op.PLACES, (g + 1) * op.PLACES)
    klass = lambda c: range(c * op.GROUPS * op.PLACES, (c + 1) * op.GROUPS * op.PLACES)
    base0 = [log_base(klass(c), (range(outcomes), 2)) for c in range(2)]
    base1 = [[log_base(group(c * op.GROUPS + j), (klass(c), op.GROUPS)) for j in range(op.GROUPS)] for c in range(2)]
    base2 = [[log_base([o], (group(j), op.PLACES)) for o in group(j)] for j in range(outcomes // op.PLACES)]
    weights, squares = [defaultdict(float) for _ in range(3)], [defaultdict(float) for _ in range(3)]

    def position(words, k):
        """(part, its weight rows, its probabilities, true column) of one word."""
        f, mix, wrap = plain_features([h[w] for w in words], k)
        o = y[words[k]]
        g, c = o // op.PLACES, o // op.PLACES // op.GROUPS
        salt = lambda chosen, odd: (chosen * 2 + odd + 1) * 0xD6E8FEB86659FD93
        at = [[x >> 20 & op.ROWS - 1 for x in f], [mix(x + salt(c, 0) & wrap) & op.ROWS - 1 for x in f], [mix(x + salt(g, 1) & wrap) & op.ROWS - 1 for x in f]]
        for part, (base, column) in enumerate(((base0, c), (base1[c], g % op.GROUPS), (base2[g], o % op.PLACES))):
            s = [math.exp(b + sum(weights[part][r, j] for r in at[part])) for j, b in enumerate(base)]
            yield part, at[part], [x / sum(s) for x in s], column

    part_of = {r.doc_id: r.k for r in df.select("doc_id", F.pmod(F.xxhash64(F.lower("text")), F.lit(op.ROUNDS)).alias("k")).collect()}
    for k in range(op.ROUNDS):
        sums = [defaultdict(float) for _ in range(3)]
        for i, words in texts.items():
            for n in range(len(words)) if part_of[i] == k else ():
                for part, at, p, column in position(words, n):
                    for r in at:
                        for j, x in enumerate(p):
                            sums[part][r, j] += (j == column) - x
        for part in range(3):
            for place, g in sums[part].items():
                squares[part][place] += g * g
                weights[part][place] += op.RATE * g / math.sqrt(squares[part][place] + op.DAMP)
    for i, words in texts.items():
        want = sum(math.log(p[column]) for n in range(len(words)) for _, _, p, column in position(words, n))
        want += sum(math.log(count[w] / (total[y[w]] + 1)) for w in words if y[w] >= own)
        assert got[i][0] == len(words) and abs(got[i][1] - want) < 0.02, i
    assert sum(y[w] >= own for w in count) > 50


def test_counts_are_of_all_words(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select(F.lower("text").alias("text"))
    got = op.Words(texts)
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"([a-z0-9\x{80}-\x{10ffff}]+)"), F.lit(1))).alias("w"))
    top = [r.w for r in words.groupBy("w").count().orderBy(F.desc("count")).limit(20).collect()]
    own = next(op._words(pa.array([" ".join(top)])))[2]
    assert set(own[:15].tolist()) <= set(got.known[:20].tolist())
    assert got.count.sum() == words.count() and got.size == words.distinct().count()


def test_learns_held_out_text(spark):
    """At least 0.2 nats a word better than the words' own frequencies."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    half = F.pmod(F.xxhash64("text"), F.lit(4)) > 0
    words = op.Words(op.lowered(docs.where(half)))
    model = op.train(docs.where(half), words)
    mean = lambda m: (lambda r: r.l / r.n)(op.score(docs.where(~half), m, words).agg(F.sum("lm_logprob").alias("l"), F.sum("lm_words").alias("n")).first())
    trained, unigram = mean(model), mean(op.Model(words.known, words.count))
    assert trained > unigram + 0.2, (trained, unigram)


def test_order_matters(spark):
    """Texts in which each word follows from the two before it: n-grams and skips find what unigrams can't."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(40)]
    follow = rng.integers(0, 40, (40, 40))

    def text():
        a, b, out = *rng.integers(0, 40, 2), []
        for _ in range(400):
            a, b = b, follow[a, b] if rng.random() < 0.9 else rng.integers(0, 40)
            out.append(vocabulary[b])
        return " ".join(out)

    df = spark.createDataFrame([(k, text()) for k in range(800)], "doc_id long, text string")
    words = op.Words(op.lowered(df))
    model = op.train(df.where("doc_id < 700"), words)
    r = op.score(df.where("doc_id >= 700"), model, words).agg((F.sum("lm_logprob") / F.sum("lm_words")).alias("l")).first()
    assert r.l > -np.log(40) + 0.8, r.l


def test_edges(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "A b c"), (2, None), (3, ""), (4, "..."), (5, "long " * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("LM_words", F.lit("clash"))
    for c in ("__lm", "lm", "row", "key", "rare", "a.b"):
        df = df.withColumn(c, F.lit("mine"))
    words = op.Words(op.lowered(df))
    model = op.train(df, words)
    out = op.score(df, model, words)
    assert out.columns == ["doc_id", "text", "n", "__lm", "lm", "row", "key", "rare", "a.b", "lm_words", "lm_logprob", "lm_perplexity"]
    assert out.where("`a.b` = 'mine' and key = 'mine' and lm = 'mine'").count() == len(rows)
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append((r.lm_words, r.lm_logprob, r.lm_perplexity))
    assert by[2] == by[3] == by[4] == [(0, 0.0, None)]
    assert by[1][0] == by[1][1] == by[None][0] and by[1][0][0] == 3 and by[1][0][1] < 0
    assert by[5][0][0] == 100000
    none = op.Words(op.lowered(df.limit(0)))
    assert op.score(df.limit(0), op.train(df.limit(0), none), none).count() == 0
    assert op.score(df, op.train(df.limit(0), none), none).where("lm_words = 3").count() == 3


def test_size_follows_the_words():
    assert op.rows_for(1000) == op.ROWS and op.rows_for(4 * op.PER_ROW) == 2 * op.ROWS and op.rows_for(5 * op.PER_ROW) == 4 * op.ROWS
    assert op.classes_for(1000) == op.CLASSES and op.classes_for(op.PER_CLASS * op.CLASSES * 4) == 2 * op.CLASSES
    m, _ = model_of(np.random.default_rng(7), 0)
    a, b = np.uint64(1 << 40), np.uint64((1 << 40) + m.buckets)  # two words of one bucket
    assert m.outcome(np.array([a]))[0] == m.outcome(np.array([b]))[0]
    f = [op.Model.features(np.array([w, 1], np.uint64), np.zeros(2, np.int64))[1] for w in (a, b)]
    assert f[0][0] != f[1][0]
