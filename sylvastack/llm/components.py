"""Connected components of an edge table by alternating large-star and small-star steps, all as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import cleaned, in_files, materialize


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One star step on ``rows`` distinct edges (u > v).

    Large: every neighbour above u goes to the least of u and its neighbours. Small: u and its smaller neighbours do.
    The hub of a star meets its rows in a join, never in a list; the minima are written first, so that AQE can split the join.
    """
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = materialize(in_files(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), rows))
    moved = near.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


@cleaned
def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node that has an edge, with the smallest node that it reaches.

    ``src`` and ``dst`` are columns of one orderable type. Null ends and self-loops are dropped; repeated edges count once.
    An empty edge table gives an empty result. Converges in about the logarithm of the largest component's size.
    """
    a, b = F.col(src), F.col(dst)
    now = materialize(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark, rows = None, now.count()
    for _ in range(max_rounds):
        now = materialize(in_files(_star(_star(now, True, rows), False, rows), rows))
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
