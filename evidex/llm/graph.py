"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """edges (a, b long) -> node, component (smallest id reachable), a row per node that isn't its component's smallest.

    Minima are partially aggregated; nothing but the edges moves, and each round's edges are checkpointed.
    Nulls and loops are ignored; an empty table gives an empty result.
    """
    e = checkpoint(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        again = e.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x"))
        chained = e.select("v").distinct().join(again.select(F.col("u").alias("v")), "v", "left_semi")
        if again.where("m <> x").isEmpty() and chained.isEmpty():
            break
        low = again.select(F.col("u").alias("w"), "m")
        large = e.join(low, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
