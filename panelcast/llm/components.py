"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(edges: DataFrame, u: str, v: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; ``root`` is the smallest node of its component.

    Each round sends every larger neighbour of a node to the smallest node around it (large star), then every
    smaller one too (small star).  Only the edges are kept, in the checkpoint folder; the number of rounds grows
    with the logarithm of the largest distance.  Nodes of any orderable type; edges with a null end are left out.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(
        F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v))).distinct()
    e = cut_lineage(e)
    state = _fingerprint(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        new = _fingerprint(e)
        if new == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = new
    raise RuntimeError("the components did not settle")
