"""Connected components of a large graph, by shuffles alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.session import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the links (a, b).

    Two steps alternate until nothing changes. First every node passes the smallest of its
    neighbours to the larger ones, then to the smaller ones. Each step keeps at most one link
    per old one and shortens paths, so a chain of n links takes about log n rounds. A node
    with very many links is one row per link and is never held whole: the smallest neighbour
    is an aggregate, and the join back to the links splits a skewed key.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    before = None
    while True:
        # Large step: of all neighbours, the larger ones point at the smallest.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least"))
        least = least.withColumn("least", F.least("u", "least"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        )
        large = stored(large, "links")
        # Small step: the smaller neighbours, and the node itself, point at the smallest.
        down = large.groupBy("u").agg(F.min("v").alias("least"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))
            .where("u <> v")
            .distinct()
        )
        spent, edges = (edges, large), stored(small, "links")
        discard(*spent)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
