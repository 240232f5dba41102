"""Reachability over an edge table: level by level, or by jumps of doubled length where every node has one edge at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import cut


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """edges: src, dst; seeds: node. node and its least depth, until nothing new is found or up to max_depth. Each level joins the last one's new nodes with
    the edges and leaves out what has been seen; a level is checkpointed, so that plans don't grow and lost executors cost one level. Both sides of a join are dealt by node: nothing that grows
    passes through the driver."""
    edges = cut(edges.select("src", "dst").distinct().repartition("src"))
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    if edges.groupBy("src").count().filter("count > 1 AND src IS NOT NULL").isEmpty():
        return _along(edges, seen, max_depth)
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = edges.join(front.hint("merge"), front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = cut(found.join(seen.select("node").hint("merge"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def _along(edges: DataFrame, seen: DataFrame, max_depth: int | None) -> DataFrame:
    """Where a node leads to one other at most: a round doubles the depth, so long chains take few rounds."""
    jump, step, n = edges, 1, seen.count()
    while max_depth is None or step <= max_depth:
        further = jump.join(seen.hint("merge"), F.col("src") == F.col("node")).select(F.col("dst").alias("node"), (F.col("depth") + step).alias("depth"))
        seen = cut(seen.unionByName(further).groupBy("node").agg(F.min("depth").alias("depth")))
        before, n, step = n, seen.count(), 2 * step
        if n == before:
            break
        on = jump.select(F.col("src").alias("dst"), F.col("dst").alias("_to")).hint("merge")
        jump = cut(jump.join(on, "dst").select("src", F.col("_to").alias("dst")))
    return seen if max_depth is None else seen.filter(F.col("depth") <= max_depth)
