"""Connected components by alternating large-star and small-star contraction.

Every step is a grouped minimum and an equi-join, so a node with very many neighbours is
pre-aggregated before the shuffle and split by the skew join. The edges of each round are
written to the shared checkpoint folder, which cuts the lineage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a > b) re-hung on the least neighbour, of all neighbours or of the smaller ones."""
    seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        seen = seen.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    if large:
        hung = seen.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        hung = (seen.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                .union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
    return hung.where("a <> b").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node that has a link."""
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges, before = written(edges, "component-edges"), None
    while True:
        size = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(size) == before:
            break
        before = tuple(size)
        edges = written(_stars(_stars(edges, True), False), "component-edges")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
