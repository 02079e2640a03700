"""Exact dedup of new batches against immutable snapshots, screened by static binary-fuse filters.

A batch that has been taken in becomes a snapshot: its different digests with their first ids, and one filter per shard of
them, are saved once and from then on only read. Of a new batch, the different digests meet the saved filters in their
shards; those that a filter reports meet the snapshots' digests, and the texts' bytes decide. Copies inside the new batch
are found by grouping its digests, which aggregates before it shuffles, so a text repeated without end is no large group.
Texts that neither way reports are never moved.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._bytes import mix
from ._spark import quoted, shared_folder, table, written

KEYS_PER_SHARD = 1 << 19
BATCHES = 4
_HEAD = 4  # header of a filter: seed, segment length, segments, reserved (uint64 each)


def _cells(keys: np.ndarray, seed: int, seg_len: int, segs: int) -> tuple[np.ndarray, np.ndarray]:
    """The three cells of each key, in consecutive segments, and its 8-bit fingerprint."""
    with np.errstate(over="ignore"):
        h = mix(keys + np.uint64(seed))
        g = mix(h ^ np.uint64(0xA0761D6478BD642F))
    first = ((h >> np.uint64(32)) * np.uint64(segs)) >> np.uint64(32)
    mask = np.uint64(seg_len - 1)
    cells = np.stack([(first + np.uint64(k)) * np.uint64(seg_len) + ((g >> np.uint64(20 * k)) & mask) for k in range(3)])
    return cells.astype(np.int64), (h & np.uint64(0xFF)).astype(np.uint8)


def fuse_build(keys: np.ndarray) -> bytes:
    """A 3-wise binary-fuse filter of 8-bit fingerprints over uint64 keys (repeats allowed, none allowed)."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    seg_len = min(1 << 18, 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segs = max(1, -(-int(n * factor) // seg_len) - 2)
    for attempt in range(200):
        seed = (attempt * 0x9E3779B97F4A7C15 + 0x51ED270B) & (2**64 - 1)
        if attempt % 20 == 19:
            segs += max(1, segs // 8)
        cells, prints = _cells(keys, seed, seg_len, segs)
        size = (segs + 2) * seg_len
        degree = np.bincount(cells.ravel(), minlength=size)
        index = np.arange(n, dtype=np.int64)
        held = np.zeros(size, np.int64)  # xor of the numbers of the keys in a cell
        for k in range(3):
            np.bitwise_xor.at(held, cells[k], index)
        ready = np.flatnonzero(degree == 1)
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        peeled = 0
        while len(ready):
            who, at = np.unique(held[ready], return_index=True)  # a key may be alone in several of its cells
            own = ready[at]
            rounds.append((who, own))
            peeled += len(who)
            touched = cells[:, who].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(held, touched, np.tile(who, 3))
            touched = np.unique(touched)
            ready = touched[degree[touched] == 1]
        if peeled == n:
            table_ = np.zeros(size, np.uint8)
            for who, own in reversed(rounds):
                c = cells[:, who]
                table_[own] = 0
                table_[own] = prints[who] ^ table_[c[0]] ^ table_[c[1]] ^ table_[c[2]]
            return np.array([seed, seg_len, segs, 0], np.uint64).tobytes() + table_.tobytes()
    raise RuntimeError("no seed gave a filter")


def fuse_contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key of the filter, and for about 1 in 256 of the others."""
    seed, seg_len, segs, _ = (int(x) for x in np.frombuffer(blob, np.uint64, _HEAD))
    cells, prints = _cells(keys.astype(np.uint64), seed, seg_len, segs)
    t = np.frombuffer(blob, np.uint8, offset=8 * _HEAD)
    return (t[cells[0]] ^ t[cells[1]] ^ t[cells[2]]) == prints


def _u64(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def _build(key: tuple, group: pa.Table) -> pa.Table:
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "filter": pa.array([fuse_build(_u64(group["h"]))], pa.binary())})


def _screen(digests: pa.Table, filters: pa.Table) -> pa.Table:
    h = _u64(digests["h"])
    hit = np.zeros(len(h), bool)
    for blob in filters["filter"].to_pylist():
        hit |= fuse_contains(blob, h)
    return pa.table({"h": pa.array(h[hit].view(np.int64))})


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftright("h", 7), F.lit(shards))


@dataclass(frozen=True)
class Snapshot:
    """An immutable batch: ``texts`` (id, text) as it came, ``digests`` (h, d, none, id) of its different texts with their
    first ids, ``filters`` (shard, shards, filter). Older snapshots have smaller numbers."""

    number: int
    texts: DataFrame
    digests: DataFrame
    filters: DataFrame


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, h, d): two digests, equal for equal bytes; null for null texts."""
    text = quoted(text_col)
    some = lambda h: F.when(text.isNotNull(), h)
    return docs.select(quoted(id_col).cast("long").alias("id"), text.alias("text"), some(F.xxhash64(text)).alias("h"), some(F.xxhash64(F.lit(1), text)).alias("d"))


def build_snapshot(batch: DataFrame, number: int, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
    """Saves a batch's digests and filters under ``path`` (default: the shared folder, until the application ends)."""
    spark = batch.sparkSession
    path = path or shared_folder(spark, "snapshot")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("o")
    some = _rows(batch, id_col, text_col).where("h is not null").groupBy("h", "d").agg(first).select("h", "d", "o.none", "o.id")
    some.write.parquet(f"{path}/digests")
    digests = spark.read.parquet(f"{path}/digests")
    shards = max(1, math.ceil(digests.count() / KEYS_PER_SHARD))
    filters = digests.select("h").distinct().withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(_build, "shard bigint, filter binary")
    filters.withColumn("shards", F.lit(shards)).write.parquet(f"{path}/filters")
    return load_snapshot(batch, number, path, id_col=id_col, text_col=text_col)


def load_snapshot(batch: DataFrame, number: int, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
    """A snapshot that was saved; ``batch`` is its table, for the bytes of texts that a filter reports."""
    read = batch.sparkSession.read.parquet
    return Snapshot(number, batch.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text")), read(f"{path}/digests"), read(f"{path}/filters"))


def dedup(new: DataFrame, number: int, snapshots: list[Snapshot], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of a new batch: ``(doc_id, batch, keep_id, is_duplicate)``; nothing is built or saved for later.

    A text that a snapshot has is a duplicate of its first row by (snapshot, id); of others the first row by id stays (null
    ids last), and of rows that repeat id and text one. ``keep_id`` is the id of the row that stays. A null text is never
    a duplicate and has its own id as keep_id; an empty text is a text like others, a very long one too. Other columns
    are ignored; an empty batch gives none.
    """
    rows = _rows(new, id_col, text_col)
    digests = written(rows.select("id", "h", "d").withColumn("n", F.monotonically_increasing_id()), "digests")
    known = digests.where("h is not null")
    different = written(known.groupBy("h").agg(F.count(F.lit(1)).alias("times")), "different-digests")
    size = different.count()
    found = different.where("times > 1").select("h")
    for s in snapshots:
        shards = s.filters.agg(F.max("shards")).first()[0] or 1
        # a batch much larger than the snapshot meets each filter in more than one task
        parts = max(1, math.ceil(size / (shards * KEYS_PER_SHARD)))
        mine = different.select("h", _shard(shards).alias("shard"), F.pmod(F.xxhash64("h"), F.lit(parts)).alias("part"))
        filters = s.filters.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "filter")
        found = found.unionByName(mine.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInArrow(_screen, "h bigint"))
    suspects = written(found.distinct(), "suspects")
    order = lambda n, batch: F.struct(F.lit(batch).alias("batch"), *(("none", "id") if batch < number else (F.col("id").isNull().alias("none"), "id")), n.alias("n"))
    nobody = F.lit(None).cast("long")
    owners = known.join(suspects, "h", "left_semi").select("h", "d", order(F.col("n"), number).alias("o"))
    for s in snapshots:
        owners = owners.unionByName(s.digests.join(suspects, "h", "left_semi").select("h", "d", order(nobody, s.number).alias("o")))
    owners = written(owners.groupBy("h", "d").agg(F.min("o").alias("o")), "owners")
    # exact buckets: the bytes decide whether the texts of equal digests are equal
    texts = rows.join(suspects, "h", "left_semi").select("h", "d", "text")
    for s in snapshots:
        texts = texts.unionByName(_rows(s.texts, "id", "text").join(suspects, "h", "left_semi").select("h", "d", "text"))
    mixed = written(texts.groupBy("h", "d").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("h", "d"), "mixed")
    whole = digests.join(owners, ["h", "d"], "left")
    told = lambda id_, keep, again: (id_.alias("doc_id"), F.lit(number).alias("batch"), keep.alias("keep_id"), again.alias("is_duplicate"))
    has = F.col("o").isNotNull()
    again = has & ((F.col("o.batch") < number) | (F.col("o.n") != F.col("n")))
    keep = F.when(has, F.col("o.id")).otherwise(F.col("id"))
    if not mixed.limit(1).count():
        return whole.select(*told(F.col("id"), keep, again))
    # digests that different texts share: by the texts themselves
    both = rows.join(mixed, ["h", "d"]).select(F.lit(number).alias("batch"), "id", "text")
    for s in snapshots:
        both = both.unionByName(_rows(s.texts, "id", "text").join(mixed, ["h", "d"]).select(F.lit(s.number).alias("batch"), "id", "text"))
    by_text = W.partitionBy("text").orderBy("batch", F.col("id").asc_nulls_last())
    exact = both.select("batch", "id", F.first("id").over(by_text).alias("keep"), (F.row_number().over(by_text) > 1).alias("again")).where(F.col("batch") == number)
    return whole.join(mixed, ["h", "d"], "left_anti").select(*told(F.col("id"), keep, again)).unionByName(exact.select(*told(F.col("id"), F.col("keep"), F.col("again"))))


def dedup_in_order(batches: list[tuple[int, DataFrame]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``dedup`` of batch after batch, by ascending numbers; each becomes a snapshot, once, for those after it, the newest none."""
    out, snapshots = None, []
    for number, new in batches:
        found = dedup(new, number, snapshots, id_col=id_col, text_col=text_col)
        out = found if out is None else out.unionByName(found)
        if number != batches[-1][0]:
            snapshots.append(build_snapshot(new, number, id_col=id_col, text_col=text_col))
    return out


def exact_dedup(docs: DataFrame, batch: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``(doc_id, batch, keep_id, is_duplicate)``, batch after batch, as ``dedup`` has them.

    ``batch`` numbers the batches in order of arrival (int, not null). Empty tables give none.
    """
    numbers = sorted(r.b for r in docs.select(batch.cast("int").alias("b")).distinct().collect())
    return dedup_in_order([(b, docs.where(batch.cast("int") == b)) for b in numbers] or [(0, docs.limit(0))], id_col=id_col, text_col=text_col)


def arrival(docs: DataFrame, batches: int = BATCHES) -> list[tuple[int, DataFrame]]:
    """Batches by equal ranges of doc_id, oldest first; rows without id come last."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return [(batches - 1, docs)]
    cut = [low + -(-b * (high - low + 1) // batches) for b in range(batches + 1)]
    last = lambda b: F.col("doc_id").isNull() if b == batches - 1 else F.lit(False)
    return [(b, docs.where((F.col("doc_id") >= cut[b]) & (F.col("doc_id") < cut[b + 1]) | last(b))) for b in range(batches)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_in_order(arrival(table(spark, sf_dir, "documents")))


SQL = f"""
with d as (select doc_id, text, cast(((doc_id - min(doc_id) over ()) * {BATCHES}) // (max(doc_id) over () - min(doc_id) over () + 1) as integer) as batch from documents)
select doc_id, batch, first_value(doc_id) over w as keep_id, row_number() over w > 1 as is_duplicate
from d window w as (partition by text order by batch, doc_id)
"""
