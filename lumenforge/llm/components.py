"""Connected components by alternating large-star and small-star (Kiveris et al. 2014).

A node's neighbours are never gathered: a round is an aggregate (least neighbour), which
combines before it shuffles, and a join back. Both sides of that join are read from
written tables, so adaptive execution splits the partition of a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _round(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    near = both.where("b > a") if large else both.where("b < a")
    linked = near.join(scratch.table(least, "least"), "a")
    out = linked.select(F.col("b").alias("x"), F.col("m").alias("y"))
    if not large:
        out = out.unionByName(linked.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long; rows with null or a = b are ignored). Returns node, component: the least node that can be reached."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.table(edges, "edges")
    mark = None
    while True:
        edges = scratch.table(_round(edges, large=True), "edges")
        edges = scratch.table(_round(edges, large=False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
