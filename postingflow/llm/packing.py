"""Best-fit packing of token sequences into bins of one capacity, planned on the length histogram.

1. A document longer than the capacity is cut into full bins and a rest; the rests and all other documents are pieces.
2. Pieces are counted by length. The histogram has at most ``capacity`` rows, whatever the corpus, and goes to the driver.
3. Best-fit decreasing runs over counts: each step places as many pieces of one length as there are equal bins for them,
   and gives the same bins as placing the pieces one by one.
4. The plan's runs (length, first rank, count -> bins, offset) go back as a table; pieces take the slot of their rank
   within their length. Ranks come from per-shard ranks and a prefix sum, so that a common length is no single task.

Full bins of long documents need no plan: they are numbered after the planned bins by a prefix sum over shards.
"""

from __future__ import annotations

import bisect
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import quoted, table, written

CAPACITY = 2048
ROWS_PER_SHARD = 1 << 18


class Run(NamedTuple):
    """``count`` pieces of one length from rank ``rank``: ``each`` to a bin from ``bin`` on, the first at ``offset``."""

    length: int
    rank: int
    count: int
    bin: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs of best-fit decreasing over counts by length, and the number of bins."""
    runs: list[Run] = []
    classes: dict[int, list[tuple[int, int]]] = {}  # space left -> (first bin, bins), newest last
    spaces: list[int] = []  # the keys of classes, ascending
    bins = 0

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in classes:
                bisect.insort(spaces, space)
                classes[space] = []
            classes[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = classes[space].pop()
                if not classes[space]:
                    del classes[space]
                    spaces.pop(at)
            else:
                space, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            each = space // length
            # the first bins are filled with as many as fit, one bin takes what is left, others stay as they are
            count = min(left, each * n)
            runs.append(Run(length, rank, count, first, each, capacity - space))
            full, rest = divmod(count, each)
            put(space - each * length, first, full)
            if rest:
                put(space - rest * length, first + full, 1)
            put(space, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + count, left - count
    return runs, bins


def words_and_end(text: Column) -> Column:
    """Tokens of a text: its words and an end mark; nothing for null and for texts without a word."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    return F.when(words > 0, words + 1).otherwise(0)


def pack(docs: DataFrame, length: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """``(doc_id, piece, start, length, bin, offset)``: where each piece of each row goes.

    ``length`` gives a row's tokens (default: words and an end mark). Pieces of a row are numbered from 0 and cover its
    tokens in order. Rows of length 0 (null and empty texts among them) or null length have one row with length 0 and
    null bin, so no row is lost. Rows that repeat an id, or the whole row, are packed each for itself, null ids too; ties of
    length are taken in the order of a hash of id and place in the input, so that no id is one task. A text of any length
    is counted whole and cut. Other columns are ignored; an empty table gives no row.
    """
    tokens = F.coalesce(length if length is not None else words_and_end(quoted(text_col)), F.lit(0)).cast("long")
    rows = written(docs.select(quoted(id_col).alias("doc_id"), F.greatest(tokens, F.lit(0)).alias("n"), F.monotonically_increasing_id().alias("row")), "lengths")
    spark = rows.sparkSession
    none = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("offset"))
    histogram = rows.withColumn("rest", F.col("n") % capacity).groupBy("rest").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.expr(f"n div {capacity}")).alias("full")).collect()
    runs, bins = plan({r.rest: r.pieces for r in histogram if r.rest}, capacity)
    most = max((r.pieces for r in histogram), default=0)
    shards = max(1, -(-max(most, sum(r.full for r in histogram)) // rows_per_shard))
    sharded = rows.where("n > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int")).withColumn("rest", F.col("n") % capacity)

    # pieces that are planned: a rank within the length, then the run that holds it
    in_shard = W.partitionBy("rest", "shard").orderBy("doc_id", "row")
    rests = sharded.where("rest > 0")
    before = rests.groupBy("rest", "shard").count().withColumn("before", F.sum("count").over(W.partitionBy("rest").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)))
    ranked = rests.withColumn("r", F.row_number().over(in_shard) - 1).join(before.select("rest", "shard", "before"), ["rest", "shard"]).withColumn("rank", F.col("r") + F.coalesce("before", F.lit(0)))
    # at most a few runs per length, so the plan is small whatever the corpus is
    table_ = spark.createDataFrame([tuple(map(int, r)) for r in runs], "rest long, first long, count long, bin0 long, each long, offset0 long")
    by_length = table_.groupBy("rest").agg(F.sort_array(F.collect_list(F.struct("first", "count", "bin0", "each", "offset0"))).alias("runs"))
    taken = ranked.join(by_length, "rest").withColumn("run", F.element_at(F.filter("runs", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["first"] + x["count"])), 1))
    step = F.col("rank") - F.col("run.first")
    planned = taken.select(
        "doc_id",
        F.expr(f"n div {capacity}").alias("piece"),
        (F.col("n") - F.col("rest")).alias("start"),
        F.col("rest").alias("length"),
        (F.col("run.bin0") + F.floor(step / F.col("run.each"))).alias("bin"),
        (F.col("run.offset0") + (step % F.col("run.each")) * F.col("rest")).alias("offset"),
    )

    # full bins, numbered after the planned ones
    long = sharded.withColumn("full", F.expr(f"n div {capacity}")).where("full > 0")
    start = long.groupBy("shard").agg(F.sum("full").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    upto = F.coalesce(F.sum("full").over(W.partitionBy("shard").orderBy("doc_id", "row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = long.withColumn("own", upto).join(start.select("shard", "before"), "shard")
    full = own.select("doc_id", (F.col("own") + F.col("before") + bins).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
    full = full.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), (F.col("first") + F.col("piece")).alias("bin"), F.lit(0).cast("long").alias("offset"))
    return planned.unionByName(full).unionByName(none)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
