"""Connected components of a graph given by its edges, by joins and small aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import settled


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge other than the roots; the root is the smallest node it reaches.

    Each round links the larger neighbours of a node to the smallest one, then the smaller neighbours, until every
    node hangs directly on its root. Rounds grow with the logarithm of the longest chain. Minima are combined before
    the shuffle; no node's neighbours are gathered. Edges with a null end and loops are ignored.
    """
    x, y = F.col(a), F.col(b)
    hooks = settled(
        edges.where(x != y).select(F.greatest(x, y).alias("node"), F.least(x, y).alias("root")).distinct()
    )
    while True:
        both = hooks.unionByName(hooks.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("low"))
        large = both.where("root > node").join(low, "node").select(F.col("root").alias("node"), F.col("low").alias("root"))
        large = settled(large.distinct())
        least = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(least, "node")
        following = settled(
            small.select("node", F.col("low").alias("root"))
            .unionByName(small.where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root")))
            .distinct()
        )
        # Settled: each node has one root, and no root has one.
        ends = following.select("node", F.lit(2).alias("n")).unionByName(
            following.groupBy(F.col("root").alias("node")).agg(F.lit(1).alias("n"))
        )
        if ends.groupBy("node").agg(F.sum("n").alias("n")).where("n > 2").isEmpty():
            return following
        hooks = following
