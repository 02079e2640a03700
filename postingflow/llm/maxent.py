"""Hashed maximum-entropy language model: n-gram and skip features, class-factored softmax, distributed gradients.

Outcomes are the most frequent words of the whole corpus and hash buckets for all others, in classes, groups of a class and
places of a group by rank. A position's features are the previous word, the previous two, and two skips, all by the words
themselves; P(outcome) = P(class | features) * P(group | class, features) * P(place | group, features), each a softmax over the
logarithm of its share in the corpus and a sum of hashed weight rows, so a position costs three short rows per feature
instead of a row per outcome. Classes, own words, buckets and weight rows grow with the vocabulary.

A word in a bucket is scored as P(bucket | features) * P(word | bucket), the latter from the counts of all words of the
corpus (``Words``). Those of the HEAD most frequent are known to every task; all others meet their counts by a join, so
the vocabulary has no bound.

Training passes over all documents once, in ROUNDS parts by hash of the text. In each round every task adds up its
gradients by weight row; the sums are shuffled by blocks of rows, added, and move the weights by AdaGrad on the driver.
Weights and sums are of the model's size. Scoring is a map over batches and the join of rarer words with their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import WORD, flat, mix, slices, span_hashes, spans
from ._spark import of_row, packed, quoted, table, unpacked, written

CLASSES, GROUPS, PLACES = 16, 16, 32  # classes at least
PER_CLASS = 1 << 18  # different words for each class, which from there on grow as the square root of their number
HEAD = 1 << 16  # words whose counts every task knows, at least
ROWS = 1 << 14  # weight rows per part of the model, at least
PER_ROW = 1 << 18  # different words from which on the rows grow, as the square root of their number
BLOCK = 1 << 10  # rows that one reducer adds at a time
ROUNDS = 4
RATE = 0.3
DAMP = 30.0  # squared gradient of a weight that has no evidence yet: rare features move little
FEATURES = 4
STEP, CHUNK = 1 << 12, 1 << 20  # positions in one numpy step, and those whose gradients are added up before they join the others
PROBES = 8  # keys that may share a cell before a binary search takes less time
SLICE = 1 << 19


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By slices: first row, number of rows, word hashes, row of each."""
    data, offs = flat(column)
    for i, j in slices(offs, SLICE):
        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        s, e, r = spans(d, o, WORD)
        yield i, j - i, span_hashes(d, s, e), r


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's words; the tail is sent on whenever it fills a table, so none is lost."""
    keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []
    held = 0

    def merged():
        k, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (keys[:0], sums[:0])
        both, inverse = np.unique(np.concatenate([keys, k]), return_inverse=True)
        return both, np.bincount(inverse, np.concatenate([sums, n]), len(both)).astype(np.int64)

    for batch in batches:
        for _, _, h, _ in _words(batch.column(0)):
            waiting.append(h)
            held += len(h)
            if held > 1 << 20:
                keys, sums = merged()
                waiting, held = [], 0
                if len(keys) > 1 << 21:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], ["h", "n"])
                    keys, sums = keys[:0], sums[:0]
    keys, sums = merged()
    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], ["h", "n"])


def counted(texts: DataFrame) -> DataFrame:
    """(h, n): hash and count of every word of the corpus."""
    return texts.mapInArrow(_count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def rows_for(words: int) -> int:
    """Weight rows for a vocabulary: a power of two, twice as many for four times the words."""
    rows = ROWS
    while words > PER_ROW * (rows // ROWS) ** 2:
        rows *= 2
    return rows


def classes_for(words: int) -> int:
    """Classes for a vocabulary: a power of two, twice as many for four times the words."""
    classes = CLASSES
    while words > PER_CLASS * CLASSES * (classes // CLASSES) ** 2:
        classes *= 2
    return classes


class Places:
    """Where hashes stand among sorted ``keys``: a table by their leading bits says where to look, at few keys each."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = len(keys).bit_length() + 2
        self.keys, self.shift = keys, np.uint64(64 - bits)
        cells = keys >> self.shift
        self.first = np.searchsorted(cells, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
        self.probes = int(np.bincount(cells.astype(np.int64)).max()) if len(keys) else 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether the key of that place is the hash)."""
        last = len(self.keys) - 1
        if last < 0:
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        if self.probes > PROBES:
            at = np.minimum(np.searchsorted(self.keys, h), last)
        else:
            at = np.minimum(self.first.take((h >> self.shift).view(np.int64)), last).astype(np.int64)
            for _ in range(self.probes - 1):
                at += self.keys.take(at) < h
                np.minimum(at, last, out=at)
        return at, self.keys.take(at) == h


class Words:
    """Counts of all words of a corpus, which give P(word | bucket) = n(word) / (n(bucket) + 1).

    The rest of a bucket's probability is that of words that the corpus lacks, taken together. ``table`` is (h, n) of all
    words; ``head`` and ``n`` are the most frequent ones by hash, ``known`` the model's own by frequency (ties by hash).
    Three quarters of the outcomes are own words, the rest buckets. ``count`` is how often each outcome occurs.
    """

    def __init__(self, texts: DataFrame) -> None:
        self.table = written(counted(texts), "word-counts")
        self.size = self.table.count()
        outcomes = classes_for(self.size) * GROUPS * PLACES
        own, buckets = outcomes * 3 // 4, outcomes // 4
        top = self.table.orderBy(F.desc("n"), "h").limit(max(HEAD, own)).toArrow()
        h, n = top["h"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64)
        self.known = h[:own]
        order = np.argsort(h)
        self.head, self.n = h[order], n[order]
        self.bucket = np.zeros(buckets, np.int64)
        for r in self.table.groupBy(F.col("h").bitwiseAND(buckets - 1).alias("b")).agg(F.sum("n").alias("n")).collect():
            self.bucket[r.b] = r.n
        np.subtract.at(self.bucket, (self.known % np.uint64(buckets)).astype(np.int64), n[:own])
        self.count = np.concatenate([n[:own], np.zeros(own - len(self.known), np.int64), self.bucket])

    def tasks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.head, self.n, self.bucket


class Model:
    """``weights`` of the three parts, classes, groups and places: one row per hashed feature; and ``base``, the logarithms
    of the outcomes' shares in the corpus. ``known`` are the own words by frequency, ``count`` how often outcomes occur."""

    def __init__(self, known: np.ndarray, count: np.ndarray, rows: int = ROWS) -> None:
        order = np.argsort(known)
        self.places, self.rank = Places(known[order]), order.astype(np.int32)
        self.own, self.buckets = len(count) * 3 // 4, len(count) // 4
        tree = count.reshape(-1, GROUPS, PLACES).astype(np.float64)
        log = lambda n: np.log((n + 1) / (n.sum(-1, keepdims=True) + n.shape[-1])).astype(np.float32)
        self.base = [log(tree.sum((1, 2)))[None], log(tree.sum(2)), log(tree).reshape(-1, PLACES)]
        self.weights = [np.zeros((rows, b.shape[1]), np.float32) for b in self.base]

    def outcome(self, h: np.ndarray) -> np.ndarray:
        """Number of each word's outcome."""
        out = (self.own + (h % np.uint64(self.buckets)).astype(np.int32)).astype(np.int32)
        at, hit = self.places.find(h)
        out[hit] = self.rank[at[hit]]
        return out

    @staticmethod
    def features(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Hashes (n, FEATURES): w-1, (w-2, w-1), skip w-2, skip w-3 by word hashes; a text begins with marks."""
        n = len(h)
        before = []
        for k in (1, 2, 3):
            p = np.full(n, 1, np.uint64)
            if n > k:
                same = rows[k:] == rows[:-k]
                p[k:][same] = h[:-k][same]
            before.append(p)
        a, b, c = before
        with np.errstate(over="ignore"):
            parts = [a + np.uint64(1 << 20), a * np.uint64(0x9FB21C651E98DF25) + b + np.uint64(1 << 40), b + np.uint64(2 << 20), c + np.uint64(3 << 20)]
            return mix(np.stack(parts) * np.uint64(0x9E3779B97F4A7C15)).T

    def parts(self, f: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each part: weight rows (FEATURES, n), which depend on what was chosen before; row of the base; true column."""
        last = np.uint64(len(self.weights[0]) - 1)
        group = y // PLACES
        f = f.T
        yield ((f >> np.uint64(20)) & last).view(np.int64), np.zeros(len(y), np.int64), group // GROUPS
        for chosen, column in ((group // GROUPS, group % GROUPS), (group, y % PLACES)):
            with np.errstate(over="ignore"):
                salt = (chosen.astype(np.uint64) * np.uint64(2) + np.uint64(chosen is group) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
                at = mix(f + salt) & last
            yield at.view(np.int64), chosen, column

    @staticmethod
    def logits(weights: np.ndarray, base: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        s = base.take(row, 0)
        more = np.empty_like(s)
        for rows in at:
            s += weights.take(rows, 0, more, "clip")  # no row is out of range, and only so nothing is copied twice
        return s

    @classmethod
    def softmax(cls, *place) -> np.ndarray:
        """A weight moves by RATE a round at most, so exponentials need no shift."""
        s = cls.logits(*place)
        np.exp(s, out=s)
        s *= np.reciprocal(np.einsum("ij->i", s))[:, None]
        return s

    def steps(self, h: np.ndarray, rows: np.ndarray, y: np.ndarray) -> Iterator[tuple]:
        """(first position, part, (weights, base, weight rows, base rows), places of the true columns in the flattened logits),
        a step of positions at a time."""
        for a in range(0, len(y), STEP):
            early = min(a, FEATURES - 1)  # the words before
            f = self.features(h[a - early : a + STEP], rows[a - early : a + STEP])[early:]
            for part, (at, row, column) in enumerate(self.parts(f, y[a : a + STEP])):
                width = self.base[part].shape[1]
                yield a, part, (self.weights[part], self.base[part], at, row), np.arange(0, len(column) * width, width) + column

    def score(self, h: np.ndarray, rows: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each word's outcome ``y``."""
        out = np.zeros(len(h), np.float64)
        for a, _, place, true in self.steps(h, rows, self.outcome(h) if y is None else y):
            s = self.logits(*place)
            chosen = s.ravel().take(true)
            np.exp(s, out=s)
            out[a : a + len(s)] += chosen - np.log(np.einsum("ij->i", s))
        return out

    def gradient(self, h: np.ndarray, rows: np.ndarray, sums: list[np.ndarray]) -> None:
        """Adds the gradient of the log likelihood to the sums of each part.

        Two columns are one complex number, so that one indexed addition serves both, and a weight row's sums lie together.
        """
        for _, part, place, true in self.steps(h, rows, self.outcome(h)):
            p = self.softmax(*place)
            np.negative(p, out=p)
            p.ravel()[true] += 1
            g, d = sums[part].view(np.complex64), p.view(np.complex64)
            for at in place[2]:
                for k in range(d.shape[1]):
                    np.add.at(g[:, k], at, d[:, k])

    def zeros(self) -> list[np.ndarray]:
        return [np.zeros(w.shape, np.float32) for w in self.weights]

    def move(self, part: int, block: int, g: np.ndarray, squares: list[np.ndarray], rate: float) -> None:
        """An AdaGrad step of some rows by their gradient sums over the corpus."""
        rows = slice(block * BLOCK, (block + 1) * BLOCK)
        squares[part][rows] += g * g
        self.weights[part][rows] += rate * g / np.sqrt(squares[part][rows] + DAMP)


def settle(sums: list[np.ndarray], near: list[np.ndarray]) -> None:
    """Moves ``near`` into ``sums``."""
    for g, d in zip(sums, near):
        g += d
        d[:] = 0


def _gradients(spread):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = spread.value
        sums, near = model.zeros(), model.zeros()  # of all, and of up to CHUNK words and a slice: no sum outgrows what is added to it
        n = held = 0
        for batch in batches:
            for _, _, h, rows in _words(batch.column(0)):
                model.gradient(h, rows, near)
                n, held = n + len(h), held + len(h)
                if held > CHUNK:
                    settle(sums, near)
                    held = 0
        if not n:
            return
        settle(sums, near)
        for part, g in enumerate(sums):
            for block in range(len(g) // BLOCK):
                some = g[block * BLOCK : (block + 1) * BLOCK]
                at = np.flatnonzero(some.any(1))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([at.astype(np.uint16).tobytes()]), pa.array([some[at].tobytes()])], ["part", "block", "at", "g"])

    return run


def _add(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, block = (k.as_py() for k in key)
    total = None
    for batch in groups:
        for at, g in zip(batch.column("at").to_pylist(), batch.column("g").to_pylist()):
            rows, g = np.frombuffer(at, np.uint16), np.frombuffer(g, np.float32)
            if len(rows):
                total = np.zeros((BLOCK, len(g) // len(rows))) if total is None else total
                total[rows] += g.reshape(len(rows), -1)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([total.astype(np.float32).tobytes()])], ["part", "block", "g"])


def lowered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select(F.lower(quoted(text_col)).alias("text")).where("text is not null")


def train(docs: DataFrame, words: Words, *, text_col: str = "text", rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """A model of all texts: every text gives its gradient once. ``words`` are their counts, and the model's size follows
    their number. Null, empty and wordless texts give nothing; without any word all outcomes stay equally likely."""
    spark = docs.sparkSession
    texts = lowered(docs, text_col)
    model = Model(words.known, words.count, rows_for(words.size))
    squares = [np.zeros_like(w) for w in model.weights]
    for k in range(rounds):
        spread = spark.sparkContext.broadcast(model)
        part = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k)
        part = part.coalesce(2 * spark.sparkContext.defaultParallelism)  # every task sends sums of the model's size
        sums = part.mapInArrow(_gradients(spread), "part int, block int, at binary, g binary").groupBy("part", "block").applyInArrow(_add, "part int, block int, g binary")
        for r in sums.collect():  # of the model's size
            model.move(r.part, r.block, np.frombuffer(r.g, np.float32).reshape(BLOCK, -1), squares, rate)
        spread.destroy()
    return model


def score(docs: DataFrame, model: Model, words: Words, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lm_words`` (bigint), ``lm_logprob`` (sum of natural logs) and ``lm_perplexity``; they replace
    columns so named, and columns of any other name stay.

    Null, empty and wordless texts have 0 words, log probability 0 and null perplexity. Rows are scored one by one, whole
    texts of any length at a time, so ties, repeated rows and null ids change nothing; an empty table gives an empty table.
    """
    spread = docs.sparkSession.sparkContext.broadcast((model, words.tasks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (head, counts, bucket) = spread.value
        head = Places(head)
        for batch in batches:
            for i, n, h, rows in _words(batch.column(1)):
                y = model.outcome(h)
                known, rare = within(model, (head, counts, bucket), h, y)
                logs = model.score(h, rows, y) + known
                # words outside the head, each once for its text with how often it stands there
                row, word = rows[rare].astype(np.int64), h[rare]
                _, at, times = np.unique(word ^ mix(row.astype(np.uint64)), return_index=True, return_counts=True)
                order = np.argsort(row[at], kind="stable")
                at, times = at[order], times[order]
                entries = pa.StructArray.from_arrays([pa.array(word[at].view(np.int64)), pa.array(times.astype(np.int32))], ["h", "times"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(n + 1)).astype(np.int32)), entries)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(np.bincount(rows, minlength=n).astype(np.int64)), pa.array(np.bincount(rows, logs, n).astype(np.float64)), lists], ["key", "n", "logprob", "rare"])

    low = F.lower(of_row(text_col))
    rows = packed(docs).select("row", low.alias("text"), F.xxhash64(low).alias("key"))
    # copies of a text have one key and the same score
    scored = written(rows.where("text is not null").select("key", "text").mapInArrow(run, "key bigint, n bigint, logprob double, rare array<struct<h: bigint, times: int>>"), "scores")
    by_text = scored.groupBy("key").agg(F.first("n").alias("n"), F.first("logprob").alias("logprob")).join(rare_words(scored, words), "key", "left")
    met = rows.select("row", "key").join(by_text, "key", "left")
    n, logprob = F.coalesce("n", F.lit(0).cast("long")), F.coalesce(F.col("logprob") + F.coalesce("rare", F.lit(0.0)), F.lit(0.0))
    perplexity = F.when(n > 0, F.round(F.exp(F.least(-logprob / n, F.lit(700.0))), 3))
    return unpacked(met, docs.columns, {"lm_words": n, "lm_logprob": F.round(logprob, 3), "lm_perplexity": perplexity})


def within(model: Model, counts: tuple[Places, np.ndarray, np.ndarray], h: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log P(word | bucket), as far as it is known here, and the places of words that are in buckets ``y`` but not in the
    head; of these only the bucket's part is in the sum, and the logarithm of their count is missing."""
    head, n, bucket = counts
    out = np.zeros(len(h))
    inside = np.flatnonzero(y >= model.own)
    logs = -np.log(bucket[y[inside] - model.own] + 1.0)
    at, hit = head.find(h[inside])
    logs[hit] += np.log(n[at[hit]])
    out[inside] = logs
    return out, inside[~hit]


def rare_words(scored: DataFrame, words: Words) -> DataFrame:
    """(key, rare): sum of the log counts of a text's words outside the head, by the text's hash.

    A word that the corpus lacks counts as one. Copies of a text have the same key; each of them states its words, and
    its part of ``copies``.
    """
    said = scored.select("key", F.posexplode("rare").alias("place", "w")).select("key", (F.col("place") == 0).cast("int").alias("copies"), "w.h", "w.times")
    # words that occur once in the corpus have log count 0, as have those that it lacks
    met = said.join(words.table.where("n > 1").withColumnRenamed("n", "count"), "h", "left")
    by_text = met.groupBy("key").agg(F.sum(F.col("times") * F.log(F.coalesce("count", F.lit(1)).cast("double"))).alias("s"), F.sum("copies").alias("copies"))
    return by_text.select("key", (F.col("s") / F.col("copies")).alias("rare"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = Words(lowered(docs))
    return score(docs, train(docs, words), words).drop("text")
