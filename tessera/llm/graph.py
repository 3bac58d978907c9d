"""Connected components without gathering links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of links reaches.

    Rounds of large-star and small-star (Kiveris et al., "Connected Components in
    MapReduce and Beyond"): each points the neighbours of a node at the least of
    them. The least neighbour is a map-side combined min, written and joined back, so
    that the join of a hub's links can be split and they never meet in one task. Rounds grow with the logarithm of the
    diameter; each is written to the shared folder. Nodes without links are absent;
    null ends, self-links and repeated links are allowed and change nothing.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    spread = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("w"), F.least("u", "v").alias("m")), "least")
        large = both.join(least, both.u == least.w).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large")
        forget(least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "least")
        small = large.join(least, large.u == least.w)
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e"))
        after = materialize(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "small")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (edges, large, least):
            forget(old)
        edges = after
        if state == spread:
            break
        spread = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
