"""Dictionary-compressed WARC files: one Zstandard frame per record, after a leading frame that holds their dictionary.

A task turns its rows into records and gathers them up to a file's size. The dictionary is built from the records of the
file, all of them; it is stored itself compressed in a skippable frame (magic 0x184D2A5D) at the start of the file, so
that a file is read without anything else. Every record is a frame of its own, so a record is read by one seek.

Every attempt of a task writes files of its own names, and the index, which Spark commits, names those of the attempt that
counts; nothing is renamed or written twice. A file that the index doesn't name is of an attempt that failed.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import filesystem, quoted, shared_folder, table, written

MAGIC = 0x184D2A5D
FILE_BYTES = 64 << 20  # of records before compression; what a task holds at a time
DICT_BYTES = 64 << 10
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"  # of records whose table has no date
INDEX = "page_id bigint, url string, file string, offset bigint, length bigint, record_bytes bigint, payload_sha1 string"


def record(url: str, payload: bytes, date: str = DATE, kind: str = "text/html") -> bytes:
    """A WARC 1.1 resource record. Its id comes from its content, so the same row always gives the same record."""
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = hashlib.sha256(url.encode() + b"\0" + payload).hexdigest()
    uid = f"{name[:8]}-{name[8:12]}-5{name[13:16]}-a{name[17:20]}-{name[20:32]}"
    clean = " ".join(url.split())  # a header is one line
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {clean}\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:uuid:{uid}>\r\nWARC-Payload-Digest: sha1:{sha1}\r\nWARC-Block-Digest: sha1:{sha1}\r\nContent-Type: {kind}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; raises ValueError if its length or digest is wrong."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(headers["Content-Length"])
    payload = rest[:n]
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n" or headers["WARC-Payload-Digest"] != f"sha1:{sha1}":
        raise ValueError("damaged record")
    return headers, payload


def build_dictionary(records: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary from all records; of too few or too small records, their own bytes (a raw dictionary), perhaps none."""
    if len(records) >= 8:
        try:
            return zstandard.train_dictionary(size, records, k=1024, d=8, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(records)[-size:]


def file_bytes(records: list[bytes], level: int = LEVEL) -> tuple[bytes, list[tuple[int, int]]]:
    """A whole file, and the place and size of each record's frame in it."""
    words = build_dictionary(records)
    packed = zstandard.ZstdCompressor(level=19).compress(words)
    out = [struct.pack("<II", MAGIC, len(packed)), packed]
    at, places = 8 + len(packed), []
    compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True, write_content_size=True)
    for r in records:
        frame = compressor.compress(r)
        places.append((at, len(frame)))
        out.append(frame)
        at += len(frame)
    return b"".join(out), places


def _writer(folder: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        context = TaskContext.get()
        rows, records, held, count = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, records, held, count
            name = f"part-{context.partitionId():07d}-{count:04d}-{context.taskAttemptId()}.warc.zst"
            data, places = file_bytes(records)
            with files.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(data)
            ids, urls, sha = zip(*rows)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array([name] * len(rows)), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64()), pa.array([len(r) for r in records], pa.int64()), pa.array(sha, pa.string())],
                ["page_id", "url", "file", "offset", "length", "record_bytes", "payload_sha1"],
            )
            rows, records, held, count = [], [], 0, count + 1
            return batch

        for batch in batches:
            for i, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if html is None:
                    continue
                payload = html.encode() if isinstance(html, str) else html
                raw = record(url or "", payload)
                rows.append((i, url, hashlib.sha1(payload).hexdigest()))
                records.append(raw)
                held += len(raw)
                if held >= size:
                    yield flush()
        if records:
            yield flush()

    return run


def write_warc(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", size: int = FILE_BYTES) -> DataFrame:
    """Writes ``folder`` (a URI that all executors reach) and returns the index, a row per record, as a written table.

    ``(page_id, url, file, offset, length, record_bytes, payload_sha1)``. A null payload is nothing to archive and has no
    record; an empty one has, and one of any length, whole. A null url is written as an empty one; white space in urls as single blanks. Rows that
    repeat are records of their own, null ids too. Other columns are ignored; an empty table writes no file.
    """
    rows = pages.select(quoted(id_col).cast("long").alias("page_id"), quoted(url_col).alias("url"), quoted(payload_col).alias("payload"))
    return written(rows.mapInArrow(_writer(folder, size), INDEX), "warc-index")


class Reader:
    """Reads one file: the dictionary once, then any record by its place."""

    def __init__(self, f) -> None:
        self.f = f
        f.seek(0)
        magic, n = struct.unpack("<II", f.read(8))
        if magic != MAGIC:
            raise ValueError("no dictionary frame")
        words = zstandard.ZstdDecompressor().decompress(f.read(n))
        self.decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))

    def record(self, offset: int, length: int) -> bytes:
        self.f.seek(offset)
        return self.decompressor.decompress(self.f.read(length))


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        now, reader = None, None
        for batch in batches:
            payload, uri = [], []
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if name != now:
                    now, reader = name, Reader(files.open_input_file(f"{base}/{name}"))
                headers, data = parse(reader.record(offset, length))
                payload.append(data)
                uri.append(headers["WARC-Target-URI"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(uri, pa.string()), pa.array(payload, pa.binary())], [*batch.schema.names, "target_uri", "payload"])

    return run


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """The index with ``target_uri`` and ``payload`` of each record; a damaged record fails the read."""
    return index.mapInArrow(_reader(folder), INDEX + ", target_uri string, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all pages, each read back: ``same`` says that the payload that was read has the digest of the page."""
    folder = shared_folder(spark, "warc")
    index = write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(index, folder).withColumn("same", F.sha1("payload") == F.col("payload_sha1")).drop("payload", "target_uri")
