"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _larger_first(pairs: DataFrame) -> DataFrame:
    a, b = (F.col(c) for c in pairs.columns)
    return pairs.where(a != b).select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``pairs`` (two long columns) but the roots.

    The root is the smallest node. Each round hangs the larger neighbours of a node
    below the smallest one, then the smaller ones; the number of rounds grows with
    the logarithm of the longest path. Edges stay in written tables. A hub with many
    neighbours meets its minimum in a join of two plain tables, which Spark can split.
    """
    edges = written(_larger_first(pairs), "edges")
    while True:
        both = edges.select(F.col("small").alias("u"), F.col("big").alias("v")).union(edges.select("big", "small"))
        lowest = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "lowest")
        large = edges.join(lowest, edges["small"] == lowest["u"]).select("big", F.col("m").alias("small"))
        large = written(large.distinct(), "large-star")
        least = large.groupBy("big").agg(F.min("small").alias("m"))
        small = large.join(least, "big").where("small <> m").select(F.col("small").alias("big"), F.col("m").alias("small"))
        edges = written(small.union(least).distinct(), "small-star")
        # Done when all edges form stars: no node hangs below two, and no centre hangs below another.
        torn = edges.groupBy("big").agg(F.min("small").alias("a"), F.max("small").alias("b")).where("a <> b").select("big")
        hung = edges.join(edges.select(F.col("small").alias("big")).distinct(), "big", "left_semi").select("big")
        if torn.union(hung).isEmpty():
            return edges.toDF("node", "root")
