"""Connected components over an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordmill.session import checkpoint

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Every vertex hands its larger (large) or smaller neighbours to the least vertex it knows."""
    if large:
        near = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select(F.col("dst"), F.col("src")))
    else:
        near = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    if large:
        moved = near.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    else:
        moved = near.join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst")).union(least.select(F.col("u"), F.col("m")))
    return moved.where(F.col("src") != F.col("dst")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node reachable from each node that some edge names.

    Edges are undirected; loops, repeated edges and rows with a null end add nothing. Nodes must be
    orderable and of one type. Every round is two aggregations and two joins on the edge table and ends in
    a checkpoint; rounds grow with the logarithm of the longest path. Nothing is collected but a
    row count and a checksum a round.
    """
    now = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where(F.col("src") != F.col("dst"))
    now = checkpoint(now.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if seen == mark or mark[0] == 0:
            break
        seen = mark
        now = checkpoint(_star(_star(now, True), False))
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(now.select(F.col("dst"), F.col("dst")).distinct())
