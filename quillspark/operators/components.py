"""Connected components as alternating star contractions (G1).

Each round is two groupings and two equi-joins; the minimum is pre-aggregated before the shuffle, and no neighbour list is
ever gathered. Minima are written before they are joined back: both sides of the join are then shuffles of their own, whose hot
keys (a node with very many links) adaptive execution splits, which it can't where one side is a grouping by the same key. They are
merged, never broadcast: sorted ids take so little space in a file that Spark would think the minima small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.scratch import Scratch


def _down(edges: DataFrame) -> DataFrame:
    """Every link once, from the larger node u to the smaller node v."""
    u, v = F.greatest("u", "v"), F.least("u", "v")
    return edges.select(u.alias("u"), v.alias("v")).where("u != v").distinct()


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
    return both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    low = scratch.table(edges.groupBy("u").agg(F.min("v").alias("m")), "low")
    linked = edges.join(low.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(low.select("u", F.col("m").alias("v"))).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each node has one link down, and none of the nodes it leads to has any: one grouping, partly before its shuffle."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): for each node of a link, the smallest node it reaches.

    Null ends and self-links are ignored; repeated links count once; no links give no rows. A round keeps what is connected
    connected, so the loop ends when the links are stars around their smallest nodes; each round is written to the shared folder.
    """
    links = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    now = scratch.table(_down(links), "links")
    while not _is_forest_of_stars(now):
        large = scratch.table(_large_star(now, scratch), "large")
        now = scratch.table(_small_star(large, scratch), "stars")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
