"""Search: an expression over an index gives a table (doc_id, hits), and tables of what can be asked of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.compile import HITS, evaluate
from ..plans.query import Expr, Not, Term, leaves, parse_query, required
from .index import Index

RANKED_ROWS = 1 << 20  # rows of a result that one task numbers
SENT_IDS = 1 << 18  # ids of the rarest word's documents that go to every task: 2 MB


def perform_search(index: Index, expr: Expr, *, strict: bool = False) -> DataFrame:
    """(doc_id, hits): documents that match, with their hits (pos, len) in the order of the search.

    Postings of the expression's terms are filtered at the scan and shuffled once by document; if a word that every match
    has is in at most SENT_IDS documents, only theirs. A term that the index doesn't have matches nothing, or with
    ``strict`` raises KeyError.
    """
    words = set(leaves(expr))
    if strict and (missing := words - index.existing(words)):
        raise KeyError(", ".join(sorted(missing)))
    found = index.postings_of(words)
    if isinstance(expr, Term):  # nothing to bring together
        return found.select("doc_id", F.transform("positions", lambda p: F.struct(p.cast("long").alias("pos"), F.lit(1).cast("long").alias("len"))).alias("hits"))
    must = required(expr)
    if must and len(words) > 1 and (index.saved or words <= index.known.keys()):
        df = index.dfs(words)
        n, rarest = min((df[t], t) for t in must)
        if n <= SENT_IDS and 2 * n <= sum(df.values()) - n:  # else there is little to leave out
            found = found.join(F.broadcast(index.postings_of([rarest]).select("doc_id")), "doc_id", "left_semi")
    by_doc = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"))
    # the filter stays where the hits are: pushed down, it would hold and compute the whole tree a second time
    here = F.when(F.monotonically_increasing_id() >= 0, F.col("hits"))
    return evaluate(by_doc, expr, "m").select("doc_id", here.alias("hits")).where("hits is not null")


def search(index: Index, text: str) -> DataFrame:
    """The result of a query; empty if the query has no expression."""
    expr = parse_query(index, text)
    if expr is None:
        return index.doc_stats.where(F.lit(False)).select("doc_id", F.lit(None).cast(HITS).alias("hits"))
    return perform_search(index, expr)


def without(index: Index, keep: Expr, drop: Expr) -> DataFrame:
    return perform_search(index, Not(keep, drop))


def hits(result: DataFrame) -> DataFrame:
    """(doc_id, hit_index, term_pos, term_len): a row per hit, numbered from 0 in the order of the search."""
    return result.select("doc_id", F.posexplode("hits").alias("hit_index", "h")).select("doc_id", F.col("hit_index").cast("long"), F.col("h.pos").alias("term_pos"), F.col("h.len").alias("term_len"))


def hit_counts(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.size("hits").cast("long").alias("search_hit_count"))


def term_positions(result: DataFrame, position: int) -> DataFrame:
    """(doc_id, is_term_position): whether a hit of the document begins at a position."""
    return result.select("doc_id", F.exists("hits", lambda h: h["pos"] == position).alias("is_term_position"))


def numbered(result: DataFrame, rows_per_task: int = RANKED_ROWS) -> DataFrame:
    """The result with ``i``: the number of each document, from 0, by ascending id.

    Ids are cut at quantiles in ranges that are numbered side by side, so that ids far from the others change nothing; the
    counts of the ranges before give each its start.
    """
    n = result.count()
    ranges = max(1, -(-n // rows_per_task))
    if ranges == 1:
        return result.withColumn("i", (F.row_number().over(W.orderBy("doc_id")) - 1).cast("long"))
    cuts = result.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0]
    bounds = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))])
    cut = result.withColumn("__r", F.size(F.filter(bounds, lambda b: b < F.col("doc_id"))))
    start = cut.groupBy("__r").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.sum("__n").over(W.orderBy("__r")) - F.col("__n")).drop("__n")
    own = F.row_number().over(W.partitionBy("__r").orderBy("doc_id")) - 1
    return cut.withColumn("i", own).join(F.broadcast(start), "__r").withColumn("i", F.col("i") + F.col("__start")).drop("__r", "__start")
