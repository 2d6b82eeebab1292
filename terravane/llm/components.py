"""Distributed connected components: alternating large-star and small-star rounds over an edge table.

Each round joins and groups edges on the cluster and cuts the lineage; nothing is collected but one count a round. A
node with very many edges is no hot key for long: the star steps aggregate its neighbours' minimum before the shuffle,
and the join that hands the minimum back is a plain equi-join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v). Every u links its neighbours (the larger ones, or the smaller ones) and itself to the least of them."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = durable(both.groupBy("u").agg(F.min("v").alias("_v")).select(F.col("u").alias("_u"), F.least("u", "_v").alias("m")))
    j = both.join(least, F.col("u") == F.col("_u"))
    if large:
        j = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        j = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return j.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges with long columns u, v to (id, component): each node of an edge with the least node it can reach.

    Self-loops, repeated edges and both directions are fine; nodes without edges are not returned. Raises if rounds do
    not suffice (they grow with the logarithm of the longest path).
    """
    e = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    if e.isEmpty():
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(rounds):
        large = durable(_star(e, True))
        small = durable(_star(large, False))
        release(large)
        release(e)
        e = small
        # (count, checksum) stays the same exactly when the stars do
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            tops = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return tops.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError("connected components did not settle")
