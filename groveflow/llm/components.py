"""Connected components of a table of links, by large-star and small-star rounds.

Each round joins every node to the smallest node among its neighbours: large-star links the larger neighbours of a
node to it, small-star the smaller ones. The number of rounds grows with the logarithm of the number of links. Every
round is a group-by with map-side minima and a join that Spark may split when one node has very many links; its
result is written to the shared folder, so the lineage stays short and nothing passes through the driver but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveflow.session import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b. Returns the edges of the next round, again with a > b."""
    if large:  # both directions; larger neighbours move to the least of the node and its neighbours
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
        moved = around.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:  # smaller neighbours and the node itself move to the least
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        moved = around.join(least, "u").where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) in any direction, repeats and self links allowed. Returns (node, root) of every node that has
    a link to another one and is not itself the smallest node of its component; root is that smallest node."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialise(edges, "links"), None
    while True:
        edges = materialise(_star(_star(edges, True), False), "links")
        # a forest of depth one: every node appears once on the left, and no root has a smaller neighbour
        state = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
