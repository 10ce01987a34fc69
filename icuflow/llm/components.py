"""Connected components of a graph given by its edges, by alternating large-star and small-star steps.

Each step is an aggregation and a join on the edges, so no node's neighbours are ever gathered in one place. Each
node's smallest neighbour is written to the shared folder before it is joined back, so that both sides of the join are
plain shuffles and adaptive execution can split the partition of a node with very many neighbours. Ends in about log^2
rounds with every edge pointing from a node to the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.llm.common import discard, settle


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every larger neighbour of u is tied to the smallest of u and its neighbours. edges: u > v."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select(F.col("u").alias("c"), "m"), "least")
    return both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u and its smaller neighbours are tied to the smallest of them. edges: u > v."""
    least = settle(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m"), "least")
    tied = edges.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), least


def _down(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge downwards to one with none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """edges: u, v (any type with an order, any direction, no nulls). Returns node, component (the smallest node) for all but the smallest nodes themselves, settled."""
    edges = settle(_down(edges).distinct(), "edges")
    while not _stars(edges):
        large, first = _large_star(edges)
        large = settle(_down(large), "edges")
        small, second = _small_star(large)
        before, edges = edges, settle(_down(small), "edges")
        discard(before, first, large, second)
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out.settled_at = edges.settled_at
    return out
