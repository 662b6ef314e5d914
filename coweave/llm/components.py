"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _stars(edges: DataFrame, neighbour_above: bool) -> DataFrame:
    """One star round over edges (u > v).  Large star: every larger neighbour
    of a node is linked to the node's least neighbour (itself included).
    Small star: the node and its smaller neighbours are."""
    if neighbour_above:
        sym = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = (sym.join(least, "u").where(F.col("v") > F.col("u"))
               .select(F.col("v").alias("u"), F.col("m").alias("v")))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = (edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(least.select("u", F.col("m").alias("v"))))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node reachable, for every node on an edge that
    joins two different nodes.

    Aggregates are partial before their shuffle and the hot side of each join
    is a plain exchange that AQE can split, so a star of any size spreads.
    Each round is written as a table; the loop ends when a round changes
    nothing, which takes some log(longest chain) rounds.
    """
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    seen = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")]
    cur, state = cut_lineage(edges.where(x != y).select(
        F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), seen)
    while state["n"]:
        nxt, after = cut_lineage(_stars(_stars(cur, True), False), seen)
        if after == state:
            break
        cur, state = nxt, after
    # a fixed point is a set of stars: every node points at its least one
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
