"""Connected components of an edge table, without a driver-side graph.

Every round gives each node the neighbour (itself included) of smallest rank, a
hash of node and round, and contracts all nodes onto that neighbour.  Random
ranks shrink any graph by a constant factor in expectation, so chains need
logarithmically many rounds, and no list of neighbours is ever gathered: minima
are pre-aggregated before they are shuffled, and hubs are plain join rows that
adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a bigint, b bigint) -> (node, component): the smallest node of each component of two nodes or more.

    Self loops and repeated edges are allowed.  An empty table gives an empty table.
    """
    live = scratch.write(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = None
    turn = 0
    while not live.isEmpty():
        turn += 1
        rank = lambda c: F.xxhash64(c, F.lit(turn))  # noqa: E731, B023
        both = live.select("a", "b").union(live.select("b", "a")).toDF("node", "other")
        best = both.groupBy("node").agg(F.min(F.struct(rank(F.col("other")).alias("r"), F.col("other").alias("to"))).alias("m"))
        own = F.struct(rank(F.col("node")).alias("r"), F.col("node").alias("to"))
        step = scratch.write(best.select("node", F.least(own, F.col("m"))["to"].alias("to")))
        if labels is None:
            labels = step
        else:
            old = labels
            labels = scratch.write(old.withColumnRenamed("to", "mid").join(step.withColumnRenamed("node", "mid"), "mid", "left").select("node", F.coalesce("to", "mid").alias("to")))
            scratch.drop(old)
        hop_a = step.toDF("a", "to_a")
        hop_b = step.toDF("b", "to_b")
        moved = live.join(hop_a, "a").join(hop_b, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        after = scratch.write(moved.where("a <> b").distinct())
        scratch.drop(live)
        live = after
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    smallest = labels.groupBy("to").agg(F.min("node").alias("component"))
    return labels.join(smallest, "to").select("node", "component")
