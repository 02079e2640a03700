"""Near-duplicate join: Jaccard similarity of word n-gram sets, found by MinHash banding and verified exactly.

1. Texts with the same words in the same order are one class, however many rows have it; all that follows is by class.
2. Every class is sketched: minima of independent hashes over its n-grams, grouped in bands. Bands and rows are chosen so
   that a pair at the threshold meets in some band with the wanted probability, and so that few texts meet by chance,
   however many there are.
3. (band hash, class) pairs are shuffled to find buckets; of buckets with the same members one is kept. Within a bucket
   classes are linked whose whole sketches agree about as much as the threshold asks for, so that a chance meeting ties
   nothing together. A bucket states a spanning forest of its links, not its pairs; a large one is cut into blocks.
4. Linked texts meet in the cell of their connected component, where each pair whose sketches are alike is verified on the
   full n-gram sets. A component too large for a task is cut into blocks and every pair of blocks is a cell. Cells state
   either their pairs or, per class, its number of partners and the smallest class of its group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import WORD, flat, mix, slices, span_hashes, spans, windows
from ._graph import components
from ._spark import quoted, table, written

N = 3
THRESHOLD = 0.5
RECALL = 0.95
UNRELATED = 20  # texts that have nothing to do with each other are at most threshold / UNRELATED alike
MEETINGS = 8  # of those, that a text may meet in any band
DOUBT = 3.5  # standard deviations by which a sketch may understate a similarity
BUCKET_ROWS = 1 << 14  # classes that one cell of a bucket holds
CELL_BYTES, CELL_ROWS = 4 << 20, 1 << 12  # text bytes and texts of a component that one block holds
GRAMS_AT_ONCE = 1 << 22  # grams that are compared in one step


def plan(threshold: float = THRESHOLD, recall: float = RECALL, texts: int = 1) -> tuple[int, int]:
    """(bands, rows): the fewest rows, and then bands for ``recall`` at ``threshold``, by which a text meets at most MEETINGS unrelated ones."""
    for rows in range(4, 17):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))) if threshold < 1 else 1
        if texts * bands * (threshold / UNRELATED) ** rows <= MEETINGS:
            break
    return bands, rows


def least_agreement(threshold: float, minima: int) -> float:
    """Share of equal minima below which a pair is hardly at the threshold (but for 2 in 10,000)."""
    return threshold - DOUBT * math.sqrt(threshold * (1 - threshold) / minima)


def grams(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By slices of a column: first row, number of rows, gram hashes, where each row's begin, and each row's sequence key.

    A text of fewer than n words has one gram, all its words; a text without words has none.
    """
    data, offs = flat(column)
    for i, j in slices(offs):
        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, rows = spans(d, o, WORD)
        words = span_hashes(d, starts, ends)
        at = np.searchsorted(rows, np.arange(j - i + 1))
        g, grows = windows(words, rows, n)
        count = np.diff(at)
        with np.errstate(over="ignore"):
            place = (np.arange(len(words)) - at[rows]).astype(np.uint64)
            keyed = mix(words + place * np.uint64(0x9E3779B97F4A7C15))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(keyed)])
            seq = mix(total[at[1:]] - total[at[:-1]] + count.astype(np.uint64))
        few = np.flatnonzero((count > 0) & (count < n))
        if len(few):
            grows = np.concatenate([grows, few])
            g = np.concatenate([g, seq[few]])
            order = np.argsort(grows, kind="stable")
            g, grows = g[order], grows[order]
        yield i, j - i, g, np.searchsorted(grows, np.arange(j - i + 1)), seq


def sketch(g: np.ndarray, at: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the rows that have grams, their band hashes, and a byte of each of their minima."""
    some = np.flatnonzero(np.diff(at) > 0)
    out, sig = np.zeros((len(some), bands), np.uint64), np.zeros((len(some), bands * rows), np.uint8)
    if not len(some):
        return some, out, sig
    begin = at[some]
    rng = np.random.default_rng(20240611)
    low = (g >> np.uint64(32)).astype(np.uint32)
    x = np.empty_like(low)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(some), b + 1, np.uint64)
            for r in range(rows):
                a, c = rng.integers(0, 2**31, 2, dtype=np.uint32)
                np.multiply(low, a * np.uint32(2) + np.uint32(1), out=x)
                x ^= c
                least = np.minimum.reduceat(x, begin)
                h = mix(h ^ least)
                sig[:, b * rows + r] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
            out[:, b] = h
    return some, out, sig


def _sketcher(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, k, g, at, seq in grams(batch.column(3), n):
                some, h, sig = sketch(g, at, bands, rows)
                place = np.full(k, -1)
                place[some] = np.arange(len(some))
                place = pa.array(place, mask=place < 0)
                lists = pa.ListArray.from_arrays(np.arange(0, h.size + 1, bands, dtype=np.int32), pa.array(h.ravel().view(np.int64)))
                cols = [pa.array(seq[some].view(np.int64)), lists, pa.array(np.diff(at)[some].astype(np.int64)), _bytes(sig)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, k) for c in range(3)), *(c.take(place) for c in cols)], ["id", "r1", "r2", "k", "bands", "size", "sig"])

    return run


def _bytes(rows: np.ndarray) -> pa.Array:
    n, m = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * m + 1, max(m, 1), dtype=np.int32)[: n + 1].tobytes()), pa.py_buffer(rows.tobytes())])


CELL = ("cell", "low", "high")


def _by_cell(work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]):
    """Hands rows that come sorted by cell to ``work`` in whole cells, with where each begins (and the last ends)."""

    def begins(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in CELL:
            new[1:] |= np.diff(t[c].to_numpy()) != 0
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = begins(pa.Table.from_batches([batch]))[-1]
            if not last and held and any(held[-1].column(c)[0].as_py() != batch.column(c)[0].as_py() for c in CELL):
                whole, held = held, [batch]
            elif last:
                whole, held = [*held, batch.slice(0, last)], [batch.slice(last)]
            else:
                whole = []
                held.append(batch)
            if whole:
                t = pa.Table.from_batches(whole)
                yield from work(t, np.append(begins(t), t.num_rows))
        if held:
            t = pa.Table.from_batches(held)
            yield from work(t, np.append(begins(t), t.num_rows))

    return run


def _linker(minima: int, least: float):
    """Spanning forests of the links within buckets."""

    def work(t: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        k = t["k"].to_numpy()
        sig = flat(t["sig"])[0].reshape(-1, minima)
        pair = at[:-1][np.diff(at) == 2]
        alike = pair[(sig[pair] == sig[pair + 1]).mean(1) >= least]
        a, b = [k[alike]], [k[alike + 1]]
        for begin, end in zip(at[:-1], at[1:]):
            if end - begin < 3:
                continue
            rest = np.arange(begin, end)  # not reached yet
            while len(rest):
                todo, rest = [rest[0]], rest[1:]
                while todo and len(rest):
                    one = todo.pop()
                    near = (sig[rest] == sig[one]).mean(1) >= least
                    if near.any():
                        found, rest = rest[near], rest[~near]
                        a.append(np.full(len(found), k[one]))
                        b.append(k[found])
                        todo += found.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return _by_cell(work)


def _verified(texts: pa.Array, sig: np.ndarray, at: np.ndarray, block: np.ndarray, across: np.ndarray, n: int, threshold: float, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, its partners behind it in its cell, similarities). A cell of two blocks pairs only across them."""
    g_at, flat_g = [np.zeros(1, np.int64)], []
    for i, k, g, begin, _ in grams(texts, n):
        rows = np.repeat(np.arange(k), np.diff(begin))
        order = np.lexsort((g, rows))
        g, rows = g[order], rows[order]
        new = np.ones(len(g), bool)
        new[1:] = (np.diff(rows) != 0) | (g[1:] != g[:-1])
        flat_g.append(g[new])
        g_at.append(g_at[-1][-1] + np.cumsum(np.bincount(rows[new], minlength=k)))
    g, upto = np.concatenate(flat_g), np.concatenate(g_at)
    size = np.diff(upto)
    for begin, end in zip(at[:-1], at[1:]):
        if end - begin < 2:
            continue
        words, number = np.unique(g[upto[begin] : upto[end]], return_inverse=True)
        own = np.zeros(len(words), np.int64)
        base = upto[begin]
        for x in range(begin, end - 1):
            y = np.arange(x + 1, end)
            good = np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y])
            if across[x]:
                good &= block[y] != block[x]
            y = y[good]
            y = y[(sig[y] == sig[x]).mean(1) >= least]
            if not len(y):
                continue
            mine = number[upto[x] - base : upto[x + 1] - base]
            own[mine] = 1
            found, alike = [], []
            step = np.searchsorted(np.cumsum(size[y]), np.arange(0, int(size[y].sum()), GRAMS_AT_ONCE))
            for p, q in zip(step, [*step[1:], len(y)]):
                some = y[p:q]
                if not len(some):
                    continue
                s = size[some]
                first = np.cumsum(s) - s
                place = np.repeat(upto[some] - base - first, s) + np.arange(int(s.sum()))
                common = np.add.reduceat(own[number[place]], first)
                j = common / (size[x] + s - common)
                ok = j >= threshold
                found.append(some[ok])
                alike.append(j[ok])
            own[mine] = 0
            if found and sum(map(len, found)):
                yield x, np.concatenate(found), np.concatenate(alike)


def _verifier(n: int, minima: int, threshold: float, least: float, pairs: bool):
    """Of each cell the verified ``pairs`` (a, b, jaccard), or by class (k, links, best, root, split)."""

    def work(t: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        k, split = t["k"].to_numpy(), t["split"].to_numpy()
        found = _verified(t["text"].combine_chunks(), flat(t["sig"])[0].reshape(-1, minima), at, t["block"].to_numpy(), t["low"].to_numpy() != t["high"].to_numpy(), n, threshold, least)
        if pairs:
            for x, y, j in found:
                a = np.full(len(y), k[x])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(k[y]), pa.array(j)], ["a", "b", "jaccard"])
            return
        links, best, root = np.zeros(len(k), np.int64), np.zeros(len(k)), np.arange(len(k))
        end = np.repeat(at[1:], np.diff(at))
        begin = np.repeat(at[:-1], np.diff(at))
        for x, y, j in found:
            links[x] += len(y)
            links[y] += 1
            best[x] = max(best[x], j.max())
            best[y] = np.maximum(best[y], j)
            old = np.unique(np.append(root[y], root[x]))
            if len(old) > 1:
                part = root[begin[x] : end[x]]
                part[np.isin(part, old[1:])] = old[0]
        low = np.full(len(k), np.iinfo(np.int64).max)
        np.minimum.at(low, root, k)
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (k, links, best, low[root], split)], ["k", "links", "best", "root", "split"])

    return _by_cell(work)


def row_keys(id_: Column, text: Column) -> list[Column]:
    """Two hashes of a row's id and text, by which it is known."""
    return [F.xxhash64(id_, text).alias("r1"), F.hash(text, id_).alias("r2")]


class Join:
    """What is computed of a table once: its sketches, and the cells in which linked texts are verified."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float) -> None:
        self.n, self.threshold = n, threshold
        bands, rows = plan(threshold, recall, docs.count())
        self.minima = bands * rows
        self.least = least_agreement(threshold, self.minima)
        base = docs.select(quoted(id_col).cast("long").alias("id"), *row_keys(quoted(id_col), quoted(text_col)), F.lower(quoted(text_col)).alias("text"))
        self.rows = written(base.mapInArrow(_sketcher(n, bands, rows), "id bigint, r1 bigint, r2 int, k bigint, bands array<bigint>, size bigint, sig binary"), "sketches")
        some = self.rows.where("k is not null")
        # a text of each class, by the row that stands for it
        own = F.struct(F.col("id").isNull().alias("none"), "id", "r1", "r2")
        self.classes = written(some.groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.min(own).alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
        placed = self.classes.select("k", F.explode("bands").alias("h"))
        buckets = placed.groupBy("h").agg(F.count(F.lit(1)).alias("s"), F.bit_xor(F.xxhash64("k")).alias("of")).where("s > 1")
        buckets = buckets.groupBy("s", "of").agg(F.min("h").alias("h"))  # those with the same members find the same
        entries = placed.join(buckets.withColumn("blocks", F.ceil(F.col("s") / F.lit(BUCKET_ROWS)).cast("int")).select("h", "blocks"), "h")
        cells = _blocks(entries.join(self.classes.select("k", "sig"), "k"), "h").select(*CELL, "k", "sig")
        links = cells.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(_linker(self.minima, self.least), "a bigint, b bigint")
        labels = components(links).select(F.col("node").alias("k"), F.col("label").alias("cell"))
        reps = labels.join(self.classes.select("k", "rep.r1", "rep.r2", "sig"), "k")
        # repeated rows have the text more than once
        texts = base.join(reps.withColumnsRenamed({"r1": "q1", "r2": "q2"}), (F.col("r1") == F.col("q1")) & (F.col("r2") == F.col("q2")))
        self.linked = written(texts.groupBy("k").agg(F.first("cell").alias("cell"), F.first("sig").alias("sig"), F.first("text").alias("text")).withColumn("bytes", F.octet_length("text").cast("long")), "linked")

    def verified(self, pairs: bool) -> DataFrame:
        sizes = self.linked.groupBy("cell").agg(F.greatest(F.ceil(F.sum("bytes") / F.lit(CELL_BYTES)), F.ceil(F.count(F.lit(1)) / F.lit(CELL_ROWS))).cast("int").alias("blocks")).where("blocks > 1")
        cells = _blocks(self.linked.join(sizes, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), "cell")
        kind = "a bigint, b bigint, jaccard double" if pairs else "k bigint, links bigint, best double, root bigint, split boolean"
        rows = cells.select(*CELL, "block", "k", "sig", "text", (F.col("blocks") > 1).alias("split")).repartition(*CELL).sortWithinPartitions(*CELL)
        return rows.mapInArrow(_verifier(self.n, self.minima, self.threshold, self.least, pairs), kind)


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """Rows cut in ``blocks``; each block meets itself and every other one in a cell."""
    cut = rows.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "cell": F.col(key)})


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``(doc_id_a, doc_id_b, jaccard)`` with a < b: pairs of rows whose n-gram sets are at least ``threshold`` alike.

    Words are runs of letters and digits, in lower case. Rows with the same words in the same order are a class: they are
    stated as pairs of the smallest id with each other id (similarity 1), and take part in other pairs by the smallest id;
    no pair of different texts is left out for it. Approximate: a pair at the threshold is found with probability
    ``recall``, more alike ones with more; a stated similarity is exact. Rows with a null id, null text or without words
    have no partner; rows that repeat an id are never a pair with themselves. Texts are taken whole, however long. Other
    columns are ignored, whatever their names; an empty table gives no pair.
    """
    known = docs.where(quoted(id_col).isNotNull())
    join = Join(known, id_col, text_col, n, threshold, recall)
    rep = lambda end: join.classes.select(F.col("k").alias(end), F.col("rep.id").alias(f"id_{end}"))
    met = join.verified(pairs=True).join(rep("a"), "a").join(rep("b"), "b").select("id_a", "id_b", "jaccard")
    copies = join.rows.select("k", "id").join(join.classes.select("k", F.col("rep.id").alias("id_a")), "k").select("id_a", F.col("id").alias("id_b"), F.lit(1.0).alias("jaccard"))
    both = met.unionByName(copies).where("id_a <> id_b").groupBy(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b"))
    return both.agg(F.max("jaccard").alias("jaccard"))


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: ``(doc_id, r1, r2, class_id, copies, links, best, kept)``.

    ``class_id`` is the smallest id of the row's group of texts connected by verified pairs (null ids last), ``copies``
    the number of rows with the same words in the same order, ``links`` the number of different texts that are verified
    to be at least ``threshold`` alike, ``best`` the similarity of the nearest of them. ``kept`` is true for the rows
    that stand for their group; rows that repeat both id and text are alike, and (r1, r2) know a row by those. Null texts
    and texts without words are alone: class_id is their own id, copies 1, links 0, kept true. Recall, long texts, other
    columns and empty tables as in ``jaccard_join``.
    """
    join = Join(docs, id_col, text_col, n, threshold, recall)
    found = written(join.verified(pairs=False), "verified")
    groups = found.where("not split").select("k", F.col("root").alias("g")).unionByName(components(found.where("split"), "k", "root").select(F.col("node").alias("k"), F.col("label").alias("g")))
    links = found.groupBy("k").agg(F.sum("links").alias("links"), F.max("best").alias("best")).join(groups, "k", "left")
    known = join.classes.select("k", "copies", "rep").join(links, "k", "left").withColumn("g", F.coalesce("g", "k"))
    firsts = known.groupBy("g").agg(F.min("rep").alias("first"))
    by_class = known.join(firsts, "g").select("k", "first", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"), "best")
    rows = join.rows.where("k is not null").select("id", "r1", "r2", "k").join(by_class, "k")
    stands = (F.col("r1") == F.col("first.r1")) & (F.col("r2") == F.col("first.r2"))
    out = rows.select(F.col("id").alias("doc_id"), "r1", "r2", F.col("first.id").alias("class_id"), "copies", "links", "best", stands.alias("kept"))
    alone = join.rows.where("k is null").select(F.col("id").alias("doc_id"), "r1", "r2", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"), F.lit(None).cast("double").alias("best"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, class_id, copies, links, best)`` of every document."""
    return near_classes(table(spark, sf_dir, "documents")).drop("r1", "r2", "kept")
