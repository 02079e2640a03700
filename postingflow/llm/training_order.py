"""Token sequences in training order: fixed-stride shards whose order is a keyed permutation of all sequences.

1. Documents become token ids, each followed by the end id; a task's documents are one stream, cut into sequences of
   ``stride`` ids, so that only a task's last sequence is padded. Sequences are numbered by task and place in it. One
   pass over the texts counts them and a second one cuts them, which stores no tokens between the two; within a batch
   every different word is encoded once.
2. A Feistel network over the next even power of two, keyed by the seed, maps numbers to slots; a number that falls
   outside goes round again (cycle walking), so slots are a permutation of 0..n-1 without a table or a sort of it.
3. Slots are divided in shards of ``per_shard`` sequences. One range partition holds whole shards, sorted by slot, and
   writes each as one file of ``per_shard * stride`` ids. Slot s is at byte ``(s % per_shard) * stride * 2`` of shard
   ``s // per_shard``, so a reader resumes at any step with one seek.

The content of a file depends on nothing but the input and the seed. Every attempt of a task writes files of its own names,
and the manifest, which Spark commits, names those of the attempt that counts; nothing is renamed or written twice.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import flat, mix, slices
from ._spark import filesystem, quoted, shared_folder, table, written
from .pieces import _gather

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256  # the id after each document, and of the padding; free in this vocabulary
STRIDE = 1024
PER_SHARD = 1 << 14
SEED = 20240611
ROUNDS = 6
BYTES = 2  # of an id
SLICE = 8 << 20
RANGE_BYTES = 64 << 20  # of ids that one range partition writes, at least a shard
#: White space, also that which Arrow's regular expressions don't take for such.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DOCS = "array<struct<doc_id: bigint, start: bigint, at: int, length: int>>"
INDEX = f"slot bigint, shard bigint, file string, offset bigint, n_tokens int, docs {DOCS}"


def feistel(numbers: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The slots of numbers 0..n-1: a permutation of 0..n-1 by ``seed``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    with np.errstate(over="ignore"):
        keys = mix(np.uint64(seed & (2**64 - 1)) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return (left << np.uint64(half)) | right

    out = once(numbers.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(n))):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Tokens:
    """Encodes batches of texts; every different word of a batch is encoded once, and ids are gathered by numpy."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.blank = np.zeros(max(ranks.values(), default=0) + 1, bool)
        self.blank[[i for t, i in ranks.items() if t.startswith(b" ")]] = True

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint16)

    def batch(self, texts: pa.Array, count: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all rows; to ``count``, offsets alone.

        A blank between two other characters that aren't white space begins a token whatever stands before, so texts are
        cut there and every different segment is encoded once. Most segments are words; other blanks hold words together.
        """
        texts = texts.fill_null("").cast(pa.large_string())
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        words = pc.dictionary_encode(lists.flatten())
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        left, right = (pc.match_substring_regex(words.dictionary, r).to_numpy(zero_copy_only=False) for r in (f"^(?:{WHITE}|$)", f"(?:^|{WHITE})$"))
        own = words.dictionary
        # segments: begin with their row or behind a blank that begins a token
        begins = np.ones(len(codes), bool)
        begins[1:] = ~(right[codes[:-1]] | left[codes[1:]])
        first = np.zeros(len(codes), bool)
        first[at[:-1]] = True  # split gives every row a word at least
        begins |= first
        seg = np.flatnonzero(begins)
        size = np.diff(np.append(seg, len(codes)))
        code, head = codes[seg], first[seg]
        rows = np.searchsorted(seg, at)
        # words without white space at their ends and with a blank before: one call for all, cut where a token begins with a blank
        plain = np.flatnonzero(~(left | right))
        row = pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), own.take(pa.array(plain)).cast(pa.string()))
        ids = self.encode(" " + pc.binary_join(row, " ")[0].as_py()) if len(plain) else np.zeros(0, np.uint16)
        begin = np.flatnonzero(self.blank[ids])
        if len(begin) != len(plain):
            raise RuntimeError("a token spans words")
        number = np.full(len(own), -1)
        number[plain] = np.arange(len(plain))
        number = np.where((size == 1) & ~head, number[code], -1)
        # the rest: a row's first word has no blank before it, and segments of more than one word
        single: dict[str, int] = {}
        other = np.flatnonzero(number < 0)
        taken = np.unique(codes[np.repeat(number < 0, size)])
        text_of = dict(zip(taken.tolist(), own.take(pa.array(taken)).to_pylist()))
        for k, w, n, h in zip(other.tolist(), seg[other].tolist(), size[other].tolist(), head[other].tolist()):
            text = " ".join([text_of[c] for c in codes[w : w + n].tolist()])
            number[k] = len(plain) + single.setdefault(text if h else " " + text, len(single))
        parts = [self.encode(t) for t in single]
        begin = np.concatenate([begin, len(ids) + np.cumsum([0, *map(len, parts)])]).astype(np.int64)
        if count:
            return ids[:0], np.concatenate([[0], np.cumsum(np.diff(begin)[number])]).astype(np.int64)[rows]
        ids, upto = _gather(np.concatenate([ids, *parts]), begin, number)
        return ids, upto[rows]


def _streams(batches: Iterator[pa.RecordBatch], tokens: Tokens, end: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """By slices: ids of documents that have text, their tokens with an end after each, and where each ends."""
    for batch in batches:
        texts = batch.column(1)
        _, size = flat(texts)
        for i, j in slices(size, SLICE):
            ids, offs = tokens.batch(texts.slice(i, j - i))
            some = np.flatnonzero(np.diff(offs) > 0)
            ends = offs[1:][some]
            yield batch.column(0).slice(i, j - i).take(pa.array(some)), np.insert(ids, ends, end), ends + np.arange(1, len(some) + 1)


def _counter(ranks: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, n = Tokens(ranks), 0
        for batch in batches:
            texts = batch.column(0)
            for i, j in slices(flat(texts)[1], SLICE):
                size = np.diff(tokens.batch(texts.slice(i, j - i), count=True)[1])
                n += int(size.sum()) + int((size > 0).sum())  # an end id for each
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], ["part", "n"])

    return run


def _cutter(ranks: dict[bytes, int], counts: dict[int, int], stride: int, per_shard: int, end: int, seed: int):
    first, total = {}, 0
    for part in sorted(counts):
        first[part], total = total, total - (-counts[part] // stride)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=3)
        number, seen = first.get(part, 0), 0
        # what is left of the stream, and the documents in it: id, where it begins (before the rest, if negative), ends
        rest, names, begin, stop = np.zeros(0, np.uint16), pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def cut(n: int) -> pa.RecordBatch:
            low = np.arange(n) * stride
            high = np.minimum(low + stride, len(rest))
            a, b = np.searchsorted(stop, low, side="right"), np.searchsorted(begin, high, side="left")
            at = np.concatenate([[0], np.cumsum(b - a)])
            doc = np.repeat(a - at[:-1], b - a) + np.arange(at[-1])
            lows, highs = np.repeat(low, b - a), np.repeat(high, b - a)
            start = np.maximum(begin[doc], lows)
            spans = pa.StructArray.from_arrays([names.take(pa.array(doc)), pa.array(start - begin[doc]), pa.array((start - lows).astype(np.int32)), pa.array((np.minimum(stop[doc], highs) - start).astype(np.int32))], ["doc_id", "start", "at", "length"])
            slot = feistel(np.arange(number, number + n), total, seed)
            data = [pack.compress(rest[x:y].tobytes()) for x, y in zip(low.tolist(), high.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // per_shard), pa.array((high - low).astype(np.int32)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans), pa.array(data, pa.binary())], ["slot", "shard", "n_tokens", "docs", "data"])

        for ids, tokens, ends in _streams(batches, Tokens(ranks), end):
            seen += len(tokens)
            names = pa.concat_arrays([names, ids])
            begin = np.concatenate([begin, len(rest) + np.concatenate([[0], ends[:-1]])[: len(ends)]]).astype(np.int64)
            stop = np.concatenate([stop, len(rest) + ends]).astype(np.int64)
            rest = np.concatenate([rest, tokens])
            if n := len(rest) // stride:
                yield cut(n)
                number, rest = number + n, rest[n * stride :]
                left = int(np.searchsorted(stop, n * stride, side="right"))
                names, begin, stop = names.slice(left), begin[left:] - n * stride, stop[left:] - n * stride
        if len(rest):
            yield cut(1)
        if seen != counts.get(part, 0):
            raise RuntimeError(f"task {part} read {seen} tokens and counted {counts.get(part, 0)}: write the input as a table first")

    return run


def _writer(folder: str, stride: int, per_shard: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        attempt, unpack = TaskContext.get().taskAttemptId(), zstandard.ZstdDecompressor()
        now, out, name = None, None, ""
        for batch in batches:
            names = []
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data").to_pylist()):
                if shard != now:
                    if out is not None:
                        out.close()
                    now, name = shard, f"shard-{shard:07d}-{attempt}.bin"
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                ids = unpack.decompress(data)
                out.write(ids + np.full(stride - len(ids) // BYTES, end, "<u2").tobytes())
                names.append(name)
            offset = pa.array((batch.column("slot").to_numpy() % per_shard) * (stride * BYTES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("slot", "shard")), pa.array(names, pa.string()), offset, *(batch.column(c) for c in ("n_tokens", "docs"))], ["slot", "shard", "file", "offset", "n_tokens", "docs"])
        if out is not None:
            out.close()

    return run


def materialise(docs: DataFrame, ranks: dict[bytes, int], folder: str, *, id_col: str = "doc_id", text_col: str = "text", stride: int = STRIDE, per_shard: int = PER_SHARD, seed: int = SEED, end: int = END) -> DataFrame:
    """Writes the shards and their manifest to ``folder`` (a URI that all executors reach) and returns their index as a
    written table.

    ``(slot, shard, file, offset, n_tokens, docs)``, one row per sequence; ``docs`` says which tokens of which documents it
    holds, in order: (doc_id, start in the document, at in the sequence, length). Every token of every text, and the end
    id after it, is in one sequence. Null and empty texts are in none; rows that repeat an id or a text are documents of
    their own, null ids too; ties have no order but that of the input. A text longer than a sequence, or than a batch, goes
    on in the next one. Other columns are ignored. An empty table writes no shard and gives an empty index.

    ``docs`` is read twice and has to give the same rows in the same partitions, as a table does; a task that finds
    anything else fails.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    counts = {r.part: r.n for r in rows.select("text").mapInArrow(_counter(ranks), "part int, n bigint").collect()}  # a row per task
    n = sum(-(-c // stride) for c in counts.values())
    shards = max(1, -(-n // per_shard))
    cut = rows.mapInArrow(_cutter(ranks, counts, stride, per_shard, end, seed), f"slot bigint, shard bigint, n_tokens int, docs {DOCS}, data binary")
    # shards are equal and their slots known, so the ranges need no sample
    ranges = min(shards, max(1, -(-n * stride * BYTES // RANGE_BYTES)))
    placed = cut.withColumn("range", F.floor(F.col("shard") * ranges / shards).cast("int"))
    index = written(placed.repartitionById(ranges, "range").sortWithinPartitions("slot").drop("range").mapInArrow(_writer(folder, stride, per_shard, end), INDEX), "shard-index")
    index.select("shard", "file").distinct().coalesce(1).write.parquet(f"{folder}/manifest")  # a row per shard
    return index


def manifest(folder: str) -> dict[int, str]:
    """The file of each shard."""
    files, base = filesystem(folder)
    t = ds.dataset(f"{base}/manifest", filesystem=files, format="parquet").to_table()
    return dict(zip(t["shard"].to_pylist(), t["file"].to_pylist()))


def read_slots(folder: str, begin: int, stop: int, *, stride: int = STRIDE, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """The sequences of slots begin..stop-1 in order: one seek, then sequential reads. Ends early behind the last slot."""
    files, base = filesystem(folder)
    size, names = stride * BYTES, manifest(folder)
    while begin < stop:
        if begin // per_shard not in names:
            return
        with files.open_input_file(f"{base}/{names[begin // per_shard]}") as f:
            f.seek(begin % per_shard * size)
            here = min(stop - begin, per_shard - begin % per_shard)
            for _ in range(here):
                raw = f.read(size)
                if len(raw) < size:
                    return
                yield np.frombuffer(raw, "<u2")
        begin += here


def _checker(folder: str, stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        now, f = None, None
        for batch in batches:
            digest = []
            for name, offset, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "n_tokens"))):
                if name != now:
                    now, f = name, files.open_input_file(f"{base}/{name}")
                f.seek(offset)
                ids = np.frombuffer(f.read(stride * BYTES), "<u2").astype(np.uint64)
                with np.errstate(over="ignore"):
                    digest.append(int(mix(ids[:n] + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digest, pa.int64())], [*batch.schema.names, "digest"])

    return run


def query(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The index of all documents' shards, with a digest of each sequence as it is read back from its place."""
    folder = shared_folder(spark, "order")
    index = materialise(table(spark, sf_dir, "documents"), load_ranks(vocabulary), folder)
    return index.mapInArrow(_checker(folder, STRIDE), INDEX + ", digest bigint").drop("file")
