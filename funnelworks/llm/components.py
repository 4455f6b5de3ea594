"""Connected components of a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a long, b long); a component is named by its smallest node.

    Alternating large-star and small-star steps: each points a node's larger (or
    smaller) neighbours at the least node around it.  Neighbourhoods are only
    aggregated to their minimum, never gathered, so a node with very many links is
    as cheap as their number.  Each round is a written table; it ends when the
    set of links no longer changes, after a number of rounds that grows with the
    logarithm of the longest path.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: the smaller neighbours of a node, and the node itself, point at the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        before, edges = edges, staged(small.where("a <> b").distinct(), "edges")
        dropped(before, collect=False)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
