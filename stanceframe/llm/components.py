"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanceframe.llm.common import stored


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)`` with the smallest node of each component.

    Only nodes with an edge appear.  Every round moves each node's neighbours to the smallest one it
    knows (two group-and-join steps, no list of neighbours is ever built), so the number of rounds is
    logarithmic in practice; each round's edges are written to the shared folder.  Two numbers, the
    edge count and a checksum, come to the driver to see whether a round changed anything."""
    cur = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .distinct(), "cc-edges")
    seen = _checksum(cur)
    if not seen[0]:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        # large star: neighbours above a node move to its smallest neighbour (or itself)
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: a node and its smaller neighbours move to the smallest of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        cur = stored(small, "cc-edges")
        now = _checksum(cur)
        if now == seen:
            break
        seen = now
    # at the end every node hangs on its smallest one
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")))
            .groupBy("node").agg(F.min("component").alias("component")))
