"""Connected components of a graph given by its edges, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import forget, materialise


def least_neighbour(pairs: DataFrame) -> DataFrame:
    """u, v, m: for each pair its first end's least neighbour, itself included. A hot u is aggregated before it
    shuffles, and the join that brings m back is one that can be split."""
    return pairs.join(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "u")


def digest(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, and of a few numbers."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.pmod(h, F.lit((1 << 31) - 1)))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of the edges (u, v), by alternating large and small
    stars: each round hangs nodes on their least known neighbour, which halves distances, until only stars are left.
    Each round is a written table; only its size and whether it changed reach the driver."""
    now, was = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least_neighbour(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Every u of large is above its v, so a node's smaller neighbours are all its own rows.
        s = least_neighbour(large)
        small = s.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(s.select("u", F.col("m").alias("v"))).distinct()
        after = materialise(small, "edges")
        forget(now)
        now, before, was = after, was, digest(after)
        if was == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
