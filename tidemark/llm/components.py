"""Connected components by alternating large-star and small-star steps, each of which keeps the graph's connectivity.

Every round is two joins on the node and is stored; the number of rounds grows with the logarithm of the longest path.
A node that many links share is split by adaptive skew joins, because each step joins links with one minimum per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node are linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Here a > b on every edge."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), root the smallest node reachable. Nodes are of any ordered type."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        before, edges = edges, stored(_small_star(_large_star(edges)))
        forget(before)
        # Done when every node has one link, and it leads to a node that has none.
        busy = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        open_ends = busy.where("n > 1").limit(1).count() or edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        if not open_ends:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
