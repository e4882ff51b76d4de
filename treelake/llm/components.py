"""Connected components of an edge table by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, grown, settle


def connected_components(edges: DataFrame, kind: str = "bigint") -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) can reach.

    Alternates the large-star and small-star steps until the edges are stars: large-star joins every larger neighbour of
    a node to the smallest of its neighbourhood, small-star every smaller one. Both keep the components and shrink the
    paths, so that the rounds grow with the logarithm of the longest path. A neighbourhood is only ever reduced to its
    minimum, with partial sums, and joined back; it is never gathered. Each round is written to the shared folder and
    the one before it is deleted. Null nodes and self-loops are ignored; without edges the result is empty.
    """
    e = edges.select(F.col("a").cast(kind), F.col("b").cast(kind)).filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = settle(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(grown(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(grown(least), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        after = settle(kept.select("x.u", "x.v").filter(F.col("u") != F.col("v")).distinct())
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)
        e = after
        if now == before:
            break
        before = now
    stars = e.withColumnsRenamed({"u": "node", "v": "component"})
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
