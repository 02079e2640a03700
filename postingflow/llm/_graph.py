"""Connected components by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import removed, written

MAX_ROUNDS = 64  # labels at least double their reach every round; 2**64 nodes can't be exceeded


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of an edge with the smallest node of its component. Edges with a null end are ignored.

    Each round points every edge's roots at the smaller one and then shortens all paths, so a chain of n nodes takes
    about log n rounds. Each round's labels are a written table, so no lineage grows and a lost executor costs one round;
    the last round's tables are removed. A label that many nodes have is one key of a join, whose large side adaptive
    execution splits (spark.sql.adaptive.skewJoin.enabled, as by default).
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    links = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    nodes = links.select(F.col("a").alias("node")).union(links.select("b"))
    # the smallest neighbour, or the node itself: no label is ever larger than its node
    first = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    labels = written(nodes.distinct().join(first, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        # pointer jumping
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = written(labels.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label")), "labels")
        removed(labels)
        labels = jumped
        deep = labels.alias("x").join(labels.select(F.col("node").alias("label"), F.col("label").alias("above")), "label").where("above < label").limit(1).count()
        # links whose ends have different labels: the larger label's node takes the smaller label
        left = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        cross = links.join(left, "a").join(right, "b").where("la <> lb").select(F.greatest("la", "lb").alias("node"), F.least("la", "lb").alias("lower"))
        hooks = written(cross.groupBy("node").agg(F.min("lower").alias("lower")), "hooks")
        if not deep and not hooks.limit(1).count():
            removed(links, hooks)
            return labels
        hooked = written(labels.join(hooks, "node", "left").select("node", F.least("label", F.coalesce("lower", "label")).alias("label")), "labels")
        removed(labels, hooks)
        labels = hooked
    raise RuntimeError("components did not settle")
