"""Connected components of a distributed edge list, by alternating large-star and small-star rounds (Kiveris et al.,
"Connected Components in MapReduce and Beyond"). Only ids move; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (the larger ones, or the others and itself) to the least of them."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges, two columns of longs, -> node, component (the least node reachable). Nodes without an edge to another don't appear."""
    edges = stored(edges.toDF("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # done when every edge goes from a node with one neighbour below it to one that has none: stars
        heads = edges.select(F.col("v").alias("u")).distinct()
        chained = not edges.join(heads, "u", "left_semi").isEmpty()
        if not chained and edges.groupBy("u").count().filter("count > 1").isEmpty():
            break
        wide = stored(_star(edges, True), "edges")
        discard(edges)
        edges = stored(_star(wide, False), "edges")
        discard(wide)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
