"""Connected components by alternating large-star and small-star contraction.

The published two-phase algorithm: every round links each node straight to the
smallest neighbour, until all links form stars.  Links stay in tables; the
driver sees counts only.  The smallest neighbours are a table as well, so that a join with
them is one of two plain shuffles, which Spark splits where a node has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import stash


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) of every node that has a link in ``edges`` (a, b); root is the smallest node reached."""
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        tops = now.select(F.col("b").alias("a")).distinct()
        parents = now.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if parents.join(tops, "a", "left").where("n > 1").isEmpty() and now.join(tops, "a", "left_semi").isEmpty():
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stash(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = stash(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        low = stash(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        hop = large.join(low, "a")
        small = hop.where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = stash(small.distinct(), "edges")
    else:
        raise RuntimeError("connected components did not settle")
    links = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return links.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
