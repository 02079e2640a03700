"""Where hits stand in the text: byte offset and byte length in UTF-8, and the text itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index

FEW = 1000  # documents whose ids go to the scan of the forward table


def text_ranges(index: Index, result: DataFrame) -> DataFrame:
    """(doc_id, hit_index, term_pos, term_len, position, length): from the first token's start to the last one's end.

    One join by document with the forward table; its arrays are looked up by position, no token becomes a row. Of a saved
    index and a result of at most FEW documents only the row groups that can hold them are read, and only their rows shuffled.
    """
    forward = index.forward.select("doc_id", "starts", "lengths")
    if index.saved:
        ids = [r.doc_id for r in result.select("doc_id").limit(FEW + 1).collect()]
        if len(ids) <= FEW:
            forward = forward.where(F.col("doc_id").isin(ids))
    joined = result.join(forward, "doc_id")
    one = joined.select("doc_id", "starts", "lengths", F.posexplode("hits").alias("hit_index", "h"))
    last = (F.col("h.pos") + F.col("h.len") - 1).cast("int")
    begin = F.get("starts", F.col("h.pos").cast("int"))
    end = F.get("starts", last) + F.get("lengths", last)
    return one.select("doc_id", F.col("hit_index").cast("long"), F.col("h.pos").alias("term_pos"), F.col("h.len").alias("term_len"), begin.alias("position"), (end - begin).alias("length"))


def snippets(ranges: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ranges with ``snippet``: the bytes of the text in each."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("__bytes"))
    cut = F.decode(F.substring(F.col("__bytes"), (F.col("position") + 1).cast("int"), F.col("length").cast("int")), "UTF-8")
    return ranges.join(texts, "doc_id").withColumn("snippet", cut).drop("__bytes")
