"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spectraloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) with the smallest node of each component; a node that is its own smallest has no row.

    Rounds of contraction: every node points at its smallest neighbour if that is smaller, pointers are doubled
    until they end, and the edges move to the ends. Each round joins on keys only (hot nodes are left to the
    skew handling of the join) and is written to the shared folder. At least half of the nodes that still have
    edges go in a round.
    """
    def ordered(e):
        return (e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    edges = scratch.keep(ordered(edges), "edges")
    found = None
    while not edges.isEmpty():
        up = scratch.keep(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "up")
        while True:
            further = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            step = scratch.keep(up.join(further, "up", "left")
                                .select("node", F.coalesce("next", "up").alias("up"),
                                        F.col("next").isNotNull().alias("moved")), "up")
            moved = not step.where("moved").isEmpty()
            up = step.drop("moved")
            if not moved:
                break
        if found is None:
            found = up.withColumnRenamed("up", "component")
        else:
            moved_on = (found.join(up.select(F.col("node").alias("component"), "up"), "component", "left")
                        .select("node", F.coalesce("up", "component").alias("component")))
            found = scratch.keep(moved_on.unionByName(up.withColumnRenamed("up", "component")), "labels")
        left = up.select(F.col("node").alias("a"), F.col("up").alias("up_a"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("up_b"))
        edges = scratch.keep(ordered(edges.join(left, "a", "left").join(right, "b", "left")
                                     .select(F.coalesce("up_a", "a").alias("a"), F.coalesce("up_b", "b").alias("b"))),
                             "edges")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
