"""Connected components of an edge table, by alternating star operations.

A large star hangs every larger neighbour of a node on the smallest one near it, a small star
every smaller one; the two alternate until nothing changes, after about the logarithm of the
longest path.  Edges stay in tables: each round is two aggregations and joins, written to the
shared folder, and only a count and a checksum reach the driver.  Hubs are aggregated before they
are shuffled, and Spark may split them in the joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(a, b) with b < a."""
    if large:
        near = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        near = edges.toDF("u", "v")
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        out = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.where("a <> b").groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of edges(a, b) that has a link; root: its component's least node.

    Loops, repeated edges and either direction are accepted; rows with a null are dropped.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if not row["n"] or (row["n"], row["sum"]) == mark:
            break
        mark = (row["n"], row["sum"])
        now = written(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
