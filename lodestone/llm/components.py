"""Connected components by alternating large-star and small-star steps; labels are the least node of a component.

Every step replaces the edges by as many or fewer, each nearer to the least node; minima are aggregated before the shuffle,
so a node with very many neighbours costs one value per task and its edges are joined, not gathered. Each round is written
to the shared folder. Edges may repeat or be loops; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v). Large: each greater neighbour of a node is linked to the least of the node's neighbourhood. Small: each
    smaller one and the node itself."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label for every node that has a link to another one."""
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # done when every node has one smaller neighbour and that one none: then the edges are the labels
        several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        chained = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if not several.unionByName(chained).take(1):
            break
        edges = written(_star(written(_star(edges, large=True), "large"), large=False), "edges")
    own = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(own)
