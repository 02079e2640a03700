"""Line dedup by overlapping windows of three lines.

Every run of three consecutive lines is hashed (96 bits). A window seen more than once anywhere in the table keeps its
first occurrence by (document, line); the lines that later occurrences cover, merged over all windows, are removed. A
removed line always stands earlier in the table as well, so no content is lost.

Only hashes and positions are shuffled to find the windows; texts move once, to meet their covered positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import of_row, packed, quoted, table, written

LINES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(id_col: Column, text: Column) -> list[Column]:
    return [id_col.alias("doc"), F.xxhash64(text).alias("sum")]


def line_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """(doc, sum, pos, h, g): each window's first line number and its two hashes."""
    text = quoted(text_col)
    base = docs.select(*_key(quoted(id_col), text), _lines(text).alias("lines")).where(F.size("lines") >= lines)
    one = lambda p: F.struct(p.alias("pos"), F.xxhash64(F.slice("lines", p + 1, lines)).alias("h"), F.hash(F.slice("lines", p + 1, lines)).alias("g"))
    return base.select("doc", "sum", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - lines), one)).alias("w")).select("doc", "sum", "w.pos", "w.h", "w.g")


def _uncovered(text: Column, pos: Column, lines: int) -> Column:
    """The lines that no window from ascending positions ``pos`` covers: the runs between one window's end and the next one's start."""

    def run(all_: Column, i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(F.get(pos, i - 1) + lines)
        end = F.coalesce(F.get(pos, i), F.size(all_))
        return F.slice(all_, begin + 1, F.greatest(end - begin, F.lit(0)))

    whole = lambda all_: F.flatten(F.transform(F.sequence(F.lit(0), F.size(pos)), lambda i: run(all_, i)))
    return F.element_at(F.transform(F.array(_lines(text)), whole), 1)  # so that the text is split once


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """All rows and columns of ``docs`` with the text cleaned, plus ``lines_removed`` (int; replaces a column so named).

    Occurrences are ordered by (id, null ids first; text hash; line). Rows that repeat both id and text count as one
    document and are treated alike. Texts of fewer than three lines and null texts have no window and stay as they are;
    a text of which every line is covered becomes empty. Empty lines count as lines. A text of any length is cleaned in
    time in proportion to its lines. Columns of any name stay as they are. Empty tables give empty tables.
    """
    found = written(line_windows(docs, id_col=id_col, text_col=text_col, lines=lines), "line-windows")
    place = F.struct("doc", "sum", "pos")
    repeated = found.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    # of a very frequent window, the occurrences are the side that adaptive execution splits
    later = found.join(repeated, ["h", "g"]).where(place != F.col("first")).groupBy("doc", "sum").agg(F.sort_array(F.collect_set("pos")).alias("pos"))
    later = later.select(F.col("doc").alias("doc2"), F.col("sum").alias("sum2"), "pos")
    text = of_row(text_col)
    rows = packed(docs).select("row", *_key(of_row(id_col), text))
    joined = rows.join(later, F.col("doc").eqNullSafe(F.col("doc2")) & F.col("sum").eqNullSafe(F.col("sum2")), "left")
    left = joined.select("row", F.when(F.col("pos").isNotNull(), _uncovered(text, F.col("pos"), lines)).alias("left"))
    hit = F.col("left").isNotNull()
    cleaned = F.when(hit, F.array_join("left", "\n")).otherwise(text)
    removed = F.when(hit, F.regexp_count(text, F.lit("\n")) + 1 - F.size("left")).otherwise(0)
    columns = [c for c in docs.columns if c.lower() != "lines_removed"]
    return left.select(*[(cleaned if c == text_col else of_row(c)).alias(c) for c in columns], removed.alias("lines_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


#: ``docs`` is the name of the input; the result has its columns and lines_removed.
def sql(docs: str = "documents") -> str:
    return f"""
with l as (select doc_id, string_split(text, chr(10)) as ls from {docs}),
w as (select doc_id, unnest(range(len(ls) - 2)) as pos, ls from l where len(ls) >= 3),
v as (select doc_id, pos, row_number() over (partition by ls[pos + 1], ls[pos + 2], ls[pos + 3] order by doc_id, pos) as k from w),
c as (select distinct doc_id, pos + unnest([0, 1, 2]) as i from v where k > 1),
g as (select doc_id, list(i) as cover from c group by doc_id),
x as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as i from l join g using (doc_id)),
y as (select x.doc_id, string_agg(line, chr(10) order by i) as left_over from x anti join c on x.doc_id = c.doc_id and x.i = c.i group by x.doc_id)
select d.doc_id, case when g.cover is null then d.text else coalesce(y.left_over, '') end as text, d.lang, d.source, d.n_chars,
  cast(coalesce(len(g.cover), 0) as integer) as lines_removed
from {docs} d left join g using (doc_id) left join y using (doc_id)
"""


SQL = sql()
