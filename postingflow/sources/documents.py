"""Tables of documents: (doc_id, text), from Parquet, tab-separated files, or parts of documents put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_parquet(spark: SparkSession, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return spark.read.parquet(path).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def from_tsv(spark: SparkSession, path: str, *, id_field: int = 0, text_field: int = 1) -> DataFrame:
    """Lines of tab-separated fields; quotes and backslashes are ordinary characters. A missing field is null."""
    fields = F.split("value", "\t", -1)
    pick = lambda k: F.when(F.size(fields) > k, fields[k])
    return spark.read.text(path).where(F.length("value") > 0).select(pick(id_field).try_cast("long").alias("doc_id"), pick(text_field).alias("text"))


def join_parts(parts: DataFrame, by: str | list[str], order: str, text_col: str = "text", separator: str = "\\n") -> DataFrame:
    """One text per group: its parts in order, with the separator (by default a backslash and an n) between them."""
    keys = [by] if isinstance(by, str) else by
    texts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text_col).alias("t")))), lambda x: x["t"])
    return parts.groupBy(*keys).agg(F.array_join(texts, separator).alias("text"))


def chapters(verses: DataFrame, *, book: str = "book", chapter: str = "chapter", verse: str = "verse", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the verses of each chapter put together, under the number book and chapter of two digits at least."""
    whole = join_parts(verses.select(F.col(book).alias("b"), F.col(chapter).alias("c"), verse, text_col), ["b", "c"], verse, text_col)
    return whole.select(F.format_string("%d%02d", F.col("b").cast("long"), F.col("c").cast("long")).cast("long").alias("doc_id"), "text")
