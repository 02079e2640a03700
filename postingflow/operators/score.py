"""Scores of a result's documents, from the leaves of the expression and the statistics of the index.

A leaf that stands in the expression twice counts twice. tf is the share of a document's terms; idf has no +1, so BM25
is negative for a term that most documents have.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.query import Expr, leaves
from .index import Index

K1, B = 1.2, 0.75


def _scored(index: Index, expr: Expr, result: DataFrame, weight: Column, corpus: bool) -> DataFrame:
    """Sum of ``weight`` over the leaves that each document of the result has.

    One join by document brings result, postings of the leaves and lengths together; numbers of the corpus are rows of
    one (corpus_stats) or at most one per leaf, and are sent to every task.
    """
    times = Counter(leaves(expr))
    spark = result.sparkSession
    found = index.postings_of(times).select("term", "doc_id", F.size("positions").alias("n"))
    rows = found.join(result.select("doc_id"), "doc_id", "left_semi")
    counts = spark.createDataFrame(sorted(times.items()), "term string, times long")
    if corpus:
        df = spark.createDataFrame(sorted(index.dfs(times).items()), "term string, df long")
        counts = counts.join(df, "term").crossJoin(index.corpus_stats())
        rows = rows.join(index.doc_stats, "doc_id")
    rows = rows.join(F.broadcast(counts), "term")
    return rows.groupBy("doc_id").agg(F.sum(F.col("times") * weight).alias("score"))


def term_count_score(index: Index, expr: Expr, result: DataFrame) -> DataFrame:
    """(doc_id, score): occurrences of the leaves."""
    return _scored(index, expr, result, F.col("n").cast("double"), corpus=False)


def tf_idf_score(index: Index, expr: Expr, result: DataFrame) -> DataFrame:
    """(doc_id, score): sum of tf * log2((N + 0.001) / (df + 0.001))."""
    return _scored(index, expr, result, F.col("n") / F.col("term_count") * F.log2((F.col("document_count") + 0.001) / (F.col("df") + 0.001)), corpus=True)


def bm25_score(index: Index, expr: Expr, result: DataFrame, *, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score): sum of log2((N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))."""
    tf = F.col("n") / F.col("term_count")
    idf = F.log2((F.col("document_count") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(1 - b) + F.lit(b) * F.col("term_count") / F.col("average_document_term_count")
    return _scored(index, expr, result, idf * (tf * F.lit(k1 + 1)) / (tf + F.lit(k1) * norm), corpus=True)


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows, best first; equal scores by ascending id."""
    return scores.orderBy(F.desc("score"), "doc_id").limit(k)
