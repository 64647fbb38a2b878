"""Connected groups of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected(edges: DataFrame) -> DataFrame:
    """``id, comp`` of every node of the edges ``a, b`` (bigint): ``comp`` is the smallest id of its group.

    Every round a node takes the smallest label around it and then the label of
    that label, so long chains halve.  The old label rides along in the same
    aggregation; rounds are cut off in the shared checkpoint folder.  A hot
    node is one side of a join with unique labels, which Spark can split.
    """
    pairs = edges.select("a", "b").filter("a <> b")
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("id")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("id")))
    both = cut_lineage(both.distinct())
    labels = cut_lineage(both.groupBy("id").agg(F.least(F.min("u"), F.first("id")).alias("comp")))
    while True:
        offers = both.join(labels.select(F.col("id").alias("u"), "comp"), "u").select("id", "comp", F.lit(None).cast("bigint").alias("old"))
        own = labels.select("id", "comp", F.col("comp").alias("old"))
        lower = offers.unionByName(own).groupBy("id").agg(F.min("comp").alias("comp"), F.max("old").alias("old"))
        jump = lower.select(F.col("id").alias("_at"), F.col("comp").alias("_root"))
        step = lower.join(jump, F.col("comp") == F.col("_at"), "left").select("id", F.coalesce("_root", "comp").alias("comp"), "old")
        step = cut_lineage(step)
        labels = step.select("id", "comp")
        if step.filter("comp <> old").isEmpty():
            return labels
