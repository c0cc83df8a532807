"""Connected components of an edge table, by alternating large and small stars.

Each round is two joins' worth of grouped minima over edges; rounds needed grow with the
logarithm of the longest chain, not with the size of a component.  The hub of a large
component is a hot key: its edges are joined where they lie.  Edges never leave the
executors: the driver sees a count and whether all are stars.  Every round is cut to a table in the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, drop_cut, hot_join


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Link each node's larger neighbours to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("copies"))
    return hot_join(both, least, "a", "copies", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Link each node's smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("copies"))
    linked = hot_join(down, least, "a", "copies", n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node of edges (a, b) links to one node only, which links to none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the component's smallest node.

    ``edges`` has columns a and b; direction, repeats and loops do not matter.  An empty
    table gives an empty result.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        if _all_stars(now):
            break
        n = now.count()
        after = cut(_small_star(_large_star(now, n).distinct(), n).distinct(), "edges")
        drop_cut(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
