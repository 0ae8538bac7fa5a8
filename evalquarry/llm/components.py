"""Connected components of a table of links, by alternating large and small stars.

Every step is a grouped minimum (summed up before the shuffle) and a join that Spark
can split where one node has very many links; the number of steps grows with the
logarithm of the longest chain. Nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalquarry.llm import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large: link a node's larger neighbours to its least
    neighbour or itself; small: link a node and its smaller neighbours to the least."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(least)
    return out.where("u > v")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node that has none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("down")))).alias("e"))
    each = ends.groupBy("e.x").agg(F.sum("e.down").alias("down"), F.min("e.down").alias("below"))
    return each.where("down > 1 OR (down = 1 AND below = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links: two id columns. Returns node and component (the least node it reaches) for
    every node but the least ones, which are their own component. Links with a null end
    and links of a node to itself say nothing. The result is a table that common.discard deletes."""
    a, b = links.columns
    known = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    edges = common.stash(links.where(known).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _settled(edges):
        before, edges = edges, common.stash(_star(_star(edges, True), False).distinct())
        common.discard(before)
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out.stash_path = edges.stash_path
    return out
