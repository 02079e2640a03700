"""An append-only stream of documents into the tables of an index.

Analysis keeps no state between rows, so each micro-batch is the index of its own documents, written beside the others'.
A batch that is written again after a failure replaces its own folder. An id that came in another batch is an error, as it
is within a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.analysis import LOWERCASE, Analyzer
from ..operators.index import TABLES, Index, build_index, dictionary
from ..storage import exists


def append_documents(stream: DataFrame, path: str, checkpoint: str, analyzer: Analyzer = LOWERCASE) -> StreamingQuery:
    """Starts a query that indexes what is there and ends; run it again for what has come since."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        index = build_index(batch, analyzer=analyzer)
        if number and exists(spark, f"{path}/doc_stats"):
            before = spark.read.parquet(f"{path}/doc_stats").where(F.col("batch") != number).select("doc_id")
            again = batch.select("doc_id").join(before, "doc_id", "left_semi").limit(1).collect()
            if again:
                raise ValueError(f"document id {again[0].doc_id} is repeated")
        index.save(path, f"batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_stream(spark: SparkSession, path: str, analyzer: Analyzer = LOWERCASE) -> Index:
    """The index of all batches that have been written."""
    tables = {t: spark.read.parquet(f"{path}/{t}").drop("batch") for t in TABLES if t != "terms"}
    return Index(**tables, terms=dictionary(tables["postings"]), analyzer=analyzer, saved=True)


def token_stream(stream: DataFrame, analyzer: Analyzer = LOWERCASE) -> DataFrame:
    """(doc_id, term_pos, term) of a stream of documents."""
    return stream.select("doc_id", F.posexplode(analyzer.terms(F.col("text"))).alias("term_pos", "term"))
