"""Connected components by alternating large-star and small-star rounds, DataFrame operations only.

Rounds go on until the edges are stars. Each costs two aggregations and two joins over the remaining
edges and is written to the shared checkpoint folder. The rounds needed grow with the logarithm of the longest path, not with
its length. A hub with very many edges is reduced by partial aggregation before its rows are
shuffled, and its join side is a shuffled table of one row per node, so that adaptive execution can
split the hub's rows over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmark.llm.common import cut, drop_table

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; ``component`` is the smallest node it can reach.

    Edges are undirected. Null ends are ignored; a self edge makes its node a component of its own;
    repeated edges count once. An empty table gives an empty result.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes_alone = both.where("a = b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    star = cut(
        both.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .unionByName(nodes_alone)
        .distinct()
    )
    alone = star.where("u = v").select("u", "v")
    edges_now = cut(star.where("u <> v"))
    for _ in range(MAX_ROUNDS):
        if _settled(edges_now):
            break
        large = cut(_large_star(edges_now))
        small = cut(_small_star(large))
        drop_table(large)
        drop_table(edges_now)
        edges_now = small
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    members = edges_now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges_now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    lone = alone.select(F.col("u").alias("node"), F.col("v").alias("component"))
    result = cut(
        members.unionByName(roots).unionByName(lone).groupBy("node").agg(F.min("component").alias("component"))
    )
    drop_table(edges_now)
    drop_table(star)
    return result


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node's neighbourhood."""
    around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none: the edges are stars."""
    several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    chained = edges.select("u").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return several.unionByName(chained).isEmpty()
