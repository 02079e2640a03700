import io
import struct

import zstandard
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from postingflow.llm import warc as op
from postingflow.llm._spark import shared_folder

SF = "/root/testdata/sf0.01"


def walk(data):
    """Records of a file by reading it from its start, frame by frame, as a plain reader would."""
    magic, n = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    words = zstandard.ZstdDecompressor().decompress(data[8 : 8 + n])
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    rest = data[8 + n :]
    out = []
    while rest:
        x = d.decompressobj()
        out.append(x.decompress(rest))
        rest = x.unused_data
    return out


def test_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    folder = shared_folder(spark, "test-warc")
    index = op.write_warc(pages, folder, size=300_000)
    html = {r.page_id: (r.url, r.html) for r in pages.collect()}
    back = {r.page_id: (r.target_uri, bytes(r.payload).decode()) for r in op.read_warc(index, folder).collect()}
    assert back == html
    files, base = pafs.FileSystem.from_uri(folder)
    names = {r.file for r in index.collect()}
    assert len(names) > 2
    records = [x for n in names for x in walk(files.open_input_file(f"{base}/{n}").read())]
    assert sorted(op.parse(x)[1].decode() for x in records) == sorted(h for _, h in html.values())
    raw = sum(r.record_bytes for r in index.collect())
    plain = sum(len(zstandard.ZstdCompressor(level=op.LEVEL).compress(x)) for x in records)
    assert sum(r.length for r in index.collect()) < 0.8 * plain < plain < raw
    assert op.query(spark, SF).where("same").count() == len(html)


def test_damage():
    data, places = op.file_bytes([op.record("u", b"x" * 50) for _ in range(20)])
    r = op.Reader(io.BytesIO(data))
    assert op.parse(r.record(*places[3]))[1] == b"x" * 50
    raw = bytearray(r.record(*places[3]))
    raw[-10] ^= 1
    try:
        op.parse(bytes(raw))
        raise AssertionError
    except ValueError:
        pass


def test_edges(spark):
    rows = [(1, "http://a", "x"), (1, "http://a", "x"), (None, None, ""), (2, "b c\r\nd", None), (3, "b c\r\nd", "y" * 3_000_000), (4, "é", "ü\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1)).withColumn("offset", F.lit("clash"))
    folder = shared_folder(spark, "test-warc")
    got = sorted((r.page_id or 0, r.url, r.target_uri, bytes(r.payload).decode()) for r in op.read_warc(op.write_warc(df, folder), folder).collect() if r.url is not None)
    assert got == [(1, "http://a", "http://a", "x")] * 2 + [(3, "b c\r\nd", "b c d", "y" * 3_000_000), (4, "é", "é", "ü\r\n\r\nWARC/1.1")]
    assert op.write_warc(df, folder).count() == 5
    assert op.write_warc(df.limit(0), shared_folder(spark, "test-warc")).count() == 0
