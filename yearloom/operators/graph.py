"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearloom.session import cut_lineage


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the least of u and its partners; the minimum combines before the shuffle, so a hub is no hot key."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """One row for each node of the edges: node, component (the least node in it).

    Nothing is collected but one count and checksum a round. Self loops and repeated edges are harmless; null ends are
    dropped; an empty table gives an empty result.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    now = cut_lineage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for last in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(now.where("u = v")).distinct()
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        now = cut_lineage(small)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        if last == most_rounds - 1:
            raise RuntimeError(f"components have not settled after {most_rounds} rounds; rounds grow with the logarithm of the nodes")
        before = state
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
