"""Content-defined chunking of payloads: gear-hash cuts, digests deduplicated by joins, ordered lists that rebuild them.

1. A rolling gear hash over the last 32 bytes cuts where its low bits are zero, so equal content is cut alike wherever
   it stands. The hash of every position comes from five doubling steps over the whole batch.
2. Chunk digests (128 bits) are grouped; the first occurrence by (id, payload hash, position) owns a chunk. Only digests
   and positions move for that.
3. Payloads move once, compressed, to meet their ordered lists, and every item keeps the frames of the chunks it owns:
   the result is the manifest and the chunk store in one table.
4. Frames that other items refer to are fetched from their owners by joins on the digest, and every payload is rebuilt, in
   the order of its list, from the frames it owns and those it fetched, and compared with its bytes.
   ``store`` and ``reconstruct`` do the same with nothing but the result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import flat, slices
from ._spark import quoted, table, written

MIN, AVERAGE_BITS, MAX = 256, 10, 8192  # bytes; a chunk has 256 + 1024 on average
WINDOW = 32
LEVEL = 9  # of payloads on their way to their lists, and of frames
_GEAR = np.random.default_rng(20240611).integers(0, 2**32, 256, dtype=np.uint32)
CHUNK = "digest: binary, length: int"
LIST = "array<struct<pos: int, digest: binary, length: int, owned: boolean, owner: bigint>>"
FETCHED = "array<struct<pos: int, frame: binary>>"


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the 32 bytes that end at each position: h[i] = sum of G[byte i-k] << k, as rolled byte by byte."""
    h = _GEAR[data]
    m = 1
    while m < WINDOW:
        grown = h.copy()
        grown[m:] += h[:-m] << np.uint32(m)
        h, m = grown, 2 * m
    return h


def cuts(data: np.ndarray, offs: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each row: the first cut at least MIN bytes after the last one, at most MAX after it."""
    # the low bits of a gear hash know only the last few bytes; the high ones know the whole window
    marks = np.flatnonzero(gear(data) >> np.uint32(32 - AVERAGE_BITS) == 0) + 1
    out = []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        ends, at = [], a
        while b - at > MIN:
            k = int(np.searchsorted(marks, at + MIN))
            end = min(int(marks[k]) if k < len(marks) else b, at + MAX, b)
            ends.append(end)
            at = end
        if b > at:
            ends.append(b)
        out.append(ends)
    return out


def _mark(payload: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(payload, digest_size=8).digest(), "little", signed=True)


def _chunker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = flat(batch.column(1))
        null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        for i, j in slices(offs):
            d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            ends = cuts(d, o)
            count = np.array([len(e) for e in ends], np.int64)
            stop = np.array([x for e in ends for x in e], np.int64)
            first = np.concatenate([[0], np.cumsum(count)])
            start = np.concatenate([[0], stop[:-1]]).astype(np.int64) if len(stop) else stop
            start[first[:-1][count > 0]] = o[:-1][count > 0]
            raw = d.tobytes()
            digest = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), stop.tolist())]
            chunks = pa.StructArray.from_arrays([pa.array(digest, pa.binary()), pa.array((stop - start).astype(np.int32))], ["digest", "length"])
            keep = np.flatnonzero(~null[i:j])
            lists = pa.ListArray.from_arrays(first.astype(np.int32), chunks).take(pa.array(keep))
            marks = [_mark(raw[o[k] : o[k + 1]]) for k in keep.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(keep)), pa.array(marks, pa.int64()), pa.array(np.diff(o)[keep]), lists], ["id", "mark", "n_bytes", "chunks"])


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            ids, marks, frames = batch.column(0).slice(at, 512), [], []
            for x in batch.column(1).slice(at, 512).to_pylist():
                marks.append(None if x is None else _mark(x))
                frames.append(None if x is None else pack.compress(x))
            yield pa.RecordBatch.from_arrays([ids, pa.array(marks, pa.int64()), pa.array(frames, pa.binary())], ["id", "mark", "frame"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames of the chunks that other items refer to."""
    pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            out: tuple[list, list, list] = ([], [], [])
            for frame, lengths, shared in zip(*(part.column(c).to_pylist() for c in ("frame", "lengths", "shared"))):
                payload, upto = unpack.decompress(frame), [0, *itertools.accumulate(lengths)]
                for c in shared:
                    piece = payload[upto[c["pos"]] : upto[c["pos"]] + c["length"]]
                    for x, value in zip(out, (c["digest"], c["length"], pack.compress(piece))):
                        x.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["digest", "length", "frame"])


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts payloads at their lists' lengths, keeps the frames of owned chunks, and rebuilds payloads from frames."""
    pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            verified, frames = [], []
            for frame, n, chunks, fetched in zip(*(part.column(c).to_pylist() for c in ("frame", "n_bytes", "chunks", "fetched"))):
                payload, begin, own, rebuilt = unpack.decompress(frame), 0, [], []
                there = {f["pos"]: f["frame"] for f in fetched or []}
                for c in chunks or []:
                    end = begin + c["length"]
                    if c["owned"]:
                        own.append(stored := pack.compress(payload[begin:end]))
                    else:
                        stored = there.get(c["pos"])
                    rebuilt.append(unpack.decompress(stored) if stored is not None else b"")
                    begin = end
                verified.append(len(payload) == n and b"".join(rebuilt) == payload)
                frames.append(own)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), part.column("n_bytes"), part.column("chunks"), pa.array(frames, pa.list_(pa.binary())), pa.array(verified, pa.bool_())], ["id", "mark", "n_bytes", "chunks", "frames", "verified"])


def chunk_media(media: DataFrame, *, id_col: str = "doc_id", payload_col: str = "text") -> DataFrame:
    """``(doc_id, payload_mark, n_bytes, chunks, frames, verified)``: each item's ordered chunks and the frames it owns.

    ``payload_col`` is binary or a string (its UTF-8 bytes). ``chunks`` has (pos, digest, length, owned, owner); a chunk
    that this item doesn't own is in the frames of item ``owner``, the smallest by (id, null first; payload; position), so
    ties have one owner. ``verified`` says that the payload was rebuilt from frames byte by byte. Null payloads are no
    media and have no row; an empty payload has no chunks; a very long one is cut and rebuilt whole. Rows that repeat id
    and payload are alike, and each holds the frames; with null ids the payload's mark tells items apart. Other columns
    are ignored; an empty table gives no row.
    """
    base = media.select(quoted(id_col).cast("long").alias("id"), quoted(payload_col).cast("binary").alias("payload"))
    items = written(base.mapInArrow(_chunker, f"id bigint, mark bigint, n_bytes bigint, chunks array<struct<{CHUNK}>>"), "chunk-lists")
    one = items.dropDuplicates(["id", "mark"])
    refs = one.select("id", "mark", F.posexplode("chunks").alias("pos", "c")).select("id", "mark", "pos", "c.digest", "c.length")
    owners = refs.groupBy("digest", "length").agg(F.min(F.struct("id", "mark", "pos")).alias("o"), (F.count(F.lit(1)) > 1).alias("shared"))
    owned = F.col("id").eqNullSafe(F.col("o.id")) & (F.col("mark") == F.col("o.mark")) & (F.col("pos") == F.col("o.pos"))
    entry = F.struct("pos", "digest", "length", owned.alias("owned"), F.col("o.id").alias("owner"), "shared")
    lists = refs.join(owners, ["digest", "length"]).groupBy("id", "mark").agg(F.sort_array(F.collect_list(entry)).alias("chunks"))
    known = written(_keyed(one.select("id", "mark", "n_bytes")).join(_keyed(lists).drop("id"), KEY, "left").withColumn("chunks", F.coalesce("chunks", F.array())), "owned-lists")
    payloads = _keyed(base.where("payload is not null").mapInArrow(_packer, "id bigint, mark bigint, frame binary")).drop("id")
    met = known.join(payloads, KEY)

    # frames of shared chunks go from their owners to the items that refer to them; the payloads' exchange is used again
    give = known.select(*KEY, F.transform("chunks", lambda c: c["length"]).alias("lengths"), F.filter("chunks", lambda c: c["owned"] & c["shared"]).alias("shared"))
    frames = give.where(F.size("shared") > 0).join(payloads, KEY).select("frame", "lengths", "shared").mapInArrow(_shared, "digest binary, length int, frame binary").groupBy("digest", "length").agg(F.first("frame").alias("frame"))
    wanted = known.select(*KEY, F.explode(F.filter("chunks", lambda c: ~c["owned"])).alias("c")).select(*KEY, "c.pos", "c.digest", "c.length")
    fetched = wanted.join(frames, ["digest", "length"]).groupBy(*KEY).agg(F.collect_list(F.struct("pos", "frame")).alias("fetched"))

    met = met.join(fetched, KEY, "left").select("id", "mark", "frame", "n_bytes", F.col("chunks").cast(_WITH_SHARED).alias("all"), F.coalesce("fetched", F.array().cast(FETCHED)).alias("fetched"))
    met = met.withColumn("chunks", F.transform("all", lambda c: F.struct(*[c[x].alias(x) for x in ("pos", "digest", "length", "owned", "owner")]))).drop("all")
    out = met.mapInArrow(_owned, f"id bigint, mark bigint, n_bytes bigint, chunks {LIST}, frames array<binary>, verified boolean")
    return out.withColumnsRenamed({"id": "doc_id", "mark": "payload_mark"})


KEY = ["none", "nid", "mark"]  # an item: its id, null or not, and the hash of its payload
_WITH_SHARED = LIST.replace("owner: bigint", "owner: bigint, shared: boolean")


def _keyed(items: DataFrame) -> DataFrame:
    return items.withColumns({"none": F.col("id").isNull(), "nid": F.coalesce("id", F.lit(0).cast("long"))})


def store(chunked: DataFrame) -> DataFrame:
    """(digest, length, frame): every different chunk once."""
    own = chunked.select(F.explode(F.arrays_zip(F.filter("chunks", lambda c: c["owned"]).alias("c"), F.col("frames").alias("frame"))).alias("x"))
    return own.select("x.c.digest", "x.c.length", "x.frame").dropDuplicates(["digest", "length"])


def _joiner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        payloads = [b"".join(unpack.decompress(p["frame"]) for p in parts or []) for parts in batch.column("parts").to_pylist()]
        good = [_mark(x) == m and len(x) == n for x, m, n in zip(payloads, batch.column("mark").to_pylist(), batch.column("n").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(payloads, pa.binary()), pa.array(good, pa.bool_())], ["doc_id", "payload", "verified"])


def reconstruct(chunked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, payload, verified): payloads rebuilt from their ordered lists and the store, and checked against their marks. Items that repeat id and payload are rebuilt once."""
    items = chunked.select(F.col("doc_id").alias("id"), F.col("payload_mark").alias("mark"), F.col("n_bytes").alias("n"), "chunks").dropDuplicates(["id", "mark"])
    refs = items.select("id", "mark", "n", F.explode_outer("chunks").alias("c")).select("id", "mark", "n", "c.pos", "c.digest", "c.length")
    found = refs.join(chunks, ["digest", "length"], "left").groupBy("id", "mark", "n")
    parts = found.agg(F.sort_array(F.collect_list(F.when(F.col("frame").isNotNull(), F.struct("pos", "frame")))).alias("parts"))
    return parts.mapInArrow(_joiner, "doc_id bigint, payload binary, verified boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_media(table(spark, sf_dir, "documents"))
