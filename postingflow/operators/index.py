"""The positional inverted index: four tables, each a lazy DataFrame until it is saved.

A document is one row, so its occurrences are grouped inside the row and nothing is shuffled for that. To save an index
every text is analysed once, for the forward table, and everything else is derived from that.

=========  ==========================================================  ==========================================
forward    (doc_id, terms, starts, lengths): arrays, one row per text  text ranges; saved in ranges of doc_id
postings   (term, doc_id, positions): ascending positions              search; saved in ranges of (term, doc_id), so
                                                                       that a frequent term is no single task
doc_stats  (doc_id, term_count): texts without a term too              lengths, their number and mean
terms      (term, df, term_count)                                      dictionary
=========  ==========================================================  ==========================================
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import LOWERCASE, Analyzer, by_term

TABLES = ("forward", "postings", "doc_stats", "terms")
IN_ROW = 64  # terms whose positions are looked for one by one in what a document has of them


@dataclass(frozen=True)
class Index:
    forward: DataFrame
    postings: DataFrame
    doc_stats: DataFrame
    terms: DataFrame
    analyzer: Analyzer = LOWERCASE
    saved: bool = False
    lazy: bool = False  # postings and terms are made of the forward table at each use
    known: dict[str, int] = field(default_factory=dict, repr=False, compare=False)  # df of terms that were looked up, 0 for none

    # tables
    def tokens(self) -> DataFrame:
        """(doc_id, term_pos, term, position, length), in bytes of UTF-8."""
        zipped = F.arrays_zip(F.col("terms").alias("term"), F.col("starts").alias("position"), F.col("lengths").alias("length"))
        return self.forward.select("doc_id", F.posexplode(zipped).alias("term_pos", "t")).select("doc_id", F.col("term_pos").cast("long"), "t.term", "t.position", "t.length")

    def corpus_stats(self) -> DataFrame:
        """One row: document_count, average_document_term_count (null if there is no document)."""
        return self.doc_stats.agg(F.count(F.lit(1)).alias("document_count"), F.avg("term_count").alias("average_document_term_count"))

    def term_frequency(self) -> DataFrame:
        """(term, doc_id, term_count, tf): occurrences, and their share of the document's terms."""
        return self.postings.join(self.doc_stats, "doc_id").select("term", "doc_id", F.size("positions").cast("long").alias("term_count"), (F.size("positions") / F.col("term_count")).alias("tf"))

    def postings_of(self, terms: Iterable[str]) -> DataFrame:
        """Postings of some terms.

        Of a saved index only the row groups that can hold them are read; of a lazy one only their positions are taken from
        the texts.
        """
        wanted = sorted(set(terms))
        if self.lazy and len(wanted) <= IN_ROW:
            return grouped_of(self.forward, wanted)
        return self.postings.where(F.col("term").isin(wanted))

    def terms_of(self, terms: Iterable[str]) -> DataFrame:
        """What the dictionary has of some terms."""
        wanted = sorted(set(terms))
        return dictionary(self.postings_of(wanted)) if self.lazy else self.terms.where(F.col("term").isin(wanted))

    def dfs(self, terms: Iterable[str]) -> dict[str, int]:
        """Documents that have each of some terms, 0 for unknown ones: one job on the dictionary, however many there are."""
        wanted = set(terms)
        if new := sorted(wanted - self.known.keys()):
            found = {r.term: r.df for r in self.terms_of(new).select("term", "df").collect()}
            self.known.update({t: found.get(t, 0) for t in new})
        return {t: self.known[t] for t in wanted}

    def existing(self, terms: Iterable[str]) -> set[str]:
        """Which of some terms the dictionary has."""
        return {t for t, n in self.dfs(terms).items() if n}

    # single values
    def document_count(self) -> int:
        return self.doc_stats.count()

    def average_document_term_count(self) -> float | None:
        return self.corpus_stats().first().average_document_term_count

    def document_term_count(self, doc_id: int) -> int:
        row = self.doc_stats.where(F.col("doc_id") == doc_id).first()
        if row is None:
            raise KeyError(doc_id)
        return row.term_count

    def term_exists(self, term: str) -> bool:
        return bool(self.existing([term]))

    def term_count(self, term: str, doc_id: int | None = None) -> int:
        """Occurrences in the corpus or in one document; KeyError for a term that the corpus doesn't have."""
        row = self.terms_of([term]).first()
        if row is None:
            raise KeyError(term)
        if doc_id is None:
            return row.term_count
        one = self.postings_of([term]).where(F.col("doc_id") == doc_id).select(F.size("positions").cast("long").alias("n")).first()
        return one.n if one else 0

    def df(self, term: str) -> int:
        return self.dfs([term])[term]

    def tf(self, term: str, doc_id: int) -> float:
        n = self.term_count(term, doc_id)
        return n / self.document_term_count(doc_id) if n else 0.0

    # storage
    def save(self, path: str, part: str = "") -> None:
        """Parquet; postings in ranges of (term, doc_id), so that a search skips what its terms can't be in.

        The forward table is written first, and the others are made of it. ``part`` is a folder within each table.
        """
        spark = self.forward.sparkSession
        table = lambda name: f"{path}/{name}/{part}" if part else f"{path}/{name}"
        self.forward.write.mode("overwrite").parquet(table("forward"))
        forward = spark.read.schema(self.forward.schema).parquet(table("forward"))
        lengths(forward).write.mode("overwrite").parquet(table("doc_stats"))
        by_range = grouped(forward).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
        by_range.write.mode("overwrite").option("parquet.block.size", 32 << 20).parquet(table("postings"))
        postings = spark.read.schema(self.postings.schema).parquet(table("postings"))
        dictionary(postings).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(table("terms"))


def load(spark: SparkSession, path: str, analyzer: Analyzer = LOWERCASE) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in TABLES), analyzer=analyzer, saved=True)


def grouped(forward: DataFrame) -> DataFrame:
    """Postings of the documents of a forward table."""
    return forward.select("doc_id", F.explode(by_term("terms")).alias("p")).select("p.term", "doc_id", "p.positions")


def grouped_of(forward: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of some terms, row by row in the JVM: no batch of texts goes to Python, and no other position is kept."""
    hit = lambda t, i: F.when(t.isin(terms), F.struct(t.alias("term"), i.alias("pos")))
    held = forward.select("doc_id", F.filter(F.transform("terms", hit), lambda x: x.isNotNull()).alias("held"))
    one = lambda t: F.struct(t.alias("term"), F.transform(F.filter("held", lambda x: x["term"] == t), lambda x: x["pos"]).alias("positions"))
    # no column of its own: of a column that is exploded the optimizer asks the size first, which would analyse the text twice
    each = F.transform(F.array_distinct(F.transform("held", lambda x: x["term"])), one)
    return held.select("doc_id", F.explode(each).alias("p")).select("p.term", "doc_id", "p.positions")


def lengths(forward: DataFrame) -> DataFrame:
    return forward.select("doc_id", F.size("terms").cast("long").alias("term_count"))


def dictionary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("positions").cast("long")).alias("term_count"))


def check_ids(docs: DataFrame, id_col: str) -> None:
    """Ids are not null and not repeated: a document is one row."""
    bad = docs.groupBy(F.col(id_col).alias("id")).count().where("id is null or count > 1").limit(1).collect()
    if bad:
        raise ValueError(f"document id {bad[0].id} is {'null' if bad[0].id is None else 'repeated'}")


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", analyzer: Analyzer = LOWERCASE, check: bool = True, ranged: bool = False) -> Index:
    """The index of a table of texts; nothing is computed but the check of ids, which can be turned off.

    ``ranged`` brings texts in ranges of their ids before they are analysed, so that the saved forward table is; it costs
    one shuffle of the texts, and is for tables that aren't in the order of their ids already.
    """
    if check:
        check_ids(docs, id_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if ranged:
        base = base.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    terms: Column = analyzer.terms(F.col("text"))
    forward = base.select("doc_id", terms.alias("terms"), analyzer.ranges(F.col("text")).alias("r")).select("doc_id", "terms", "r.starts", "r.lengths")
    postings = grouped(forward)
    return Index(forward, postings, lengths(forward), dictionary(postings), analyzer, lazy=True)
