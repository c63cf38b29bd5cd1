"""Connected components of edges between long identifiers, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the larger (or the smaller and own) neighbours of each node at the smallest of its neighbourhood.

    The smallest neighbour is an aggregate with map-side combining, written out before it is joined back,
    so that adaptive execution can split the join of a node with very many neighbours.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    lowest = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lowest")
    joined = both.join(lowest, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node that some edge (a, b) touches; root is the smallest node of the component.

    Each round is written to the shared folder, so lineage stays short.  Edges from a node to itself
    and nulls are ignored; no edges give an empty result.
    """
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        now = scratch.table(_star(_star(now, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False), "stars")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
