"""Corpus cleaning from documents to packed training bins: four stages, each written and read again.

Every stage takes all rows its predecessor kept. All but the last return the columns of what they get, of any name. An
empty table gives an empty table, and texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postingflow.llm import jaccard_join, line_dedup, packing, toxicity
from postingflow.llm._spark import of_row, packed, removed, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _beside(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): the stage's own columns can't clash with the caller's in ``row``."""
    return packed(docs).select("row", of_row("doc_id").alias("doc_id"), of_row("text").alias("text"))


def _with(rows: DataFrame, docs: DataFrame, **new) -> DataFrame:
    return rows.select(*[new.get(c, of_row(c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a toxic clause; the lexicon is learned from the table of labels.

    Rows are judged one by one, so ties and rows that repeat an id or everything all stay or all go. Null and empty texts
    and null ids stay.
    """
    out = toxicity.toxicity(_beside(docs), table(spark, sf_dir, "labels"))
    return _with(out.where(~F.col("toxic")), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated three-line windows; documents of which nothing is left go.

    The first occurrence by (id, null first; text hash; line) stays. Rows that repeat id and text are one document and are
    treated alike, whatever else differs; rows that repeat an id with another text are documents of their own. Null and
    empty texts stay. n_chars is that of the text that is left.
    """
    out = line_dedup.line_dedup(_beside(docs))
    changed = F.col("lines_removed") > 0
    left = out.where(~changed | (F.col("text") != ""))
    return _with(left, docs, text=F.col("text"), n_chars=F.when(changed, F.length("text").cast("long")).otherwise(of_row("n_chars")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of connected near copies, that of the smallest id; all others stay.

    A row is known by its id and text, so another text with the same id is no copy for that. Of rows that repeat both, one
    stays, whatever else differs. Rows with a null id are grouped like others and give way to those with one; ties go by
    hash. Rows with null texts or without words have no copies, and all stay.
    """
    known = written(jaccard_join.near_classes(docs).select("r1", "r2", "kept", "copies"), "near-classes")
    gone = known.where("not kept").select("r1", "r2").distinct()
    again = known.where("kept and copies > 1").groupBy("r1", "r2").count().where("count > 1").select("r1", "r2")
    rows = packed(docs).select("row", *jaccard_join.row_keys(of_row("doc_id"), of_row("text")))
    rows = rows.join(gone, ["r1", "r2"], "left_anti")
    if again.limit(1).count():
        one = rows.join(again, ["r1", "r2"]).groupBy("r1", "r2").agg(F.first("row").alias("row"))
        rows = rows.join(again, ["r1", "r2"], "left_anti").unionByName(one)
    return _with(rows, docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, bin, offset.

    Null and empty texts have a row with null bin. Rows that repeat an id, or everything, are packed each for itself, null
    ids too; ties of length are taken by hash of id and then id. Other columns are ignored.
    """
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("n-gram Jaccard join", drop_near_copies), ("best-fit packing", pack_bins)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if k:
            removed(before)
    return docs


ORACLE_SQL = None
