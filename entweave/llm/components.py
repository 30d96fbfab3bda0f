"""Connected components of an edge table, by alternating large-star and small-star steps.

Only DataFrames move; every round is written to the shared folder, so a lost executor never costs more than a round.

Defined results: null ends and loops are passed over, repeated edges count once; without edges there are no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> node, component (the smallest node reachable), for nodes that have an edge.

    A star step sends every neighbour to one centre; a hot node is split by Spark's partial aggregation, as only its
    smallest neighbour is aggregated and joined back."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "cc")
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked to u's smallest neighbour, u included
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s")).select("s.*").where("u <> v").distinct()
        moved = written(moved, "cc")
        # done when every node has one edge and no centre has one itself: stars only
        n = moved.agg(F.count("*").alias("n"), F.countDistinct("u").alias("u")).first()
        crossing = moved.join(moved.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        e = moved
        if n["n"] == n["u"] and not crossing:
            break
    else:
        raise RuntimeError("connected components didn't settle")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
