"""Connected components of a graph given as written edges, by alternating star contractions.

Every round replaces each node's edges by edges to its smallest neighbour, first on the side of the larger neighbours,
then on the side of the smaller ones, so trees shrink to stars in a logarithmic number of rounds. Edges stay in written
tables; a frequent node's edges are joined with its one smallest neighbour, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of ``edges`` (``a, b`` bigint); null ends and loops are ignored."""
    swapped = F.when(F.col("a") > F.col("b"), F.struct(F.col("a").alias("hi"), F.col("b").alias("lo"))).otherwise(F.struct(F.col("b").alias("hi"), F.col("a").alias("lo")))
    current = scratch.table(edges.filter("a <> b").select(swapped.alias("e")).select("e.hi", "e.lo").distinct(), "edges")
    state = _state(current)
    for _ in range(max_rounds):
        if not state[0]:
            break
        # Large star: neighbours above a node move to the node's smallest neighbour (or the node itself).
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(current.select("lo", "hi"))
        smallest = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "smallest")
        large = scratch.table(current.join(smallest.withColumnRenamed("u", "lo"), "lo").select("hi", F.col("m").alias("lo")).distinct(), "large")
        # Small star: a node and its smaller neighbours move to the smallest of them.
        lowest = scratch.table(large.groupBy("hi").agg(F.min("lo").alias("m")), "lowest")
        moved = large.join(lowest, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        following = scratch.table(moved.union(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        scratch.drop(current, smallest, large, lowest)
        current, before = following, state
        state = _state(current)
        if state == before:
            break
    else:
        raise RuntimeError("components didn't settle")
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(current.select("lo", "lo").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())

