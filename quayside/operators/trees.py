"""Trees of addresses as tables of nodes: a node is the path from the root, its parent the path before the last slash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import cut


def nodes(leaves: DataFrame, leaf: str) -> DataFrame:
    """node, parent (null for roots), depth from 1, n_leaves: distinct leaves at or below it. Leaves are counted by their own prefixes, each once."""
    parts = F.split("_leaf", "/")
    prefix = lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    each = leaves.select(F.col(leaf).alias("_leaf")).filter("_leaf IS NOT NULL").distinct()
    made = each.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(prefix(k).alias("node"), F.when(k > 1, prefix(k - 1)).alias("parent"), k.alias("depth")))).alias("n"))
    return made.groupBy("n.node", "n.parent", "n.depth").agg(F.count("*").alias("n_leaves"))


def inherited(tree: DataFrame, verdict: str) -> DataFrame:
    """Adds decided_by and fills the verdict from the nearest ancestor that has one. Every undecided node points at its parent; in a round it takes what its
    target has, or its target's own target, so that the rounds are the logarithm of the depth. Nodes without such an ancestor keep nulls."""
    other = [c for c in tree.columns if c != verdict]
    state = cut(tree.select("node", F.when(F.col(verdict).isNull(), F.col("parent")).alias("_to"), F.when(F.col(verdict).isNotNull(), F.col("node")).alias("decided_by"), F.col(verdict).alias("_v")))
    while not state.filter("_to IS NOT NULL").isEmpty():
        target = state.select(F.col("node").alias("_n"), F.col("_to").alias("_t2"), F.col("decided_by").alias("_d2"), F.col("_v").alias("_v2"))
        open_ = F.col("_to").isNotNull()
        state = cut(state.join(target, F.col("_to") == F.col("_n"), "left").select("node", F.when(open_, F.col("_t2")).alias("_to"), F.when(open_, F.col("_d2")).otherwise(F.col("decided_by")).alias("decided_by"), F.when(open_, F.col("_v2")).otherwise(F.col("_v")).alias("_v")))
    return tree.select(*other).join(state.select("node", "decided_by", F.col("_v").alias(verdict)), "node")


def dealt(tree: DataFrame, budget: int) -> DataFrame:
    """node, depth, budget: each root has the budget, and a node's budget is divided evenly among its children, fractions dropped, level by level."""
    rows = cut(tree.select("node", "parent", "depth"))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    shares = rows.groupBy(F.col("parent").alias("_p")).agg(F.count("*").alias("_n"))
    level = rows.filter("depth = 1").select("node", "depth", F.lit(budget).cast("long").alias("budget"))
    all_ = level
    for k in range(2, deepest + 1):
        above = level.join(shares, F.col("node") == F.col("_p")).select("_p", F.floor(F.col("budget") / F.col("_n")).cast("long").alias("budget"))
        level = cut(rows.filter(F.col("depth") == k).join(above, F.col("parent") == F.col("_p")).select("node", "depth", "budget"))
        all_ = all_.unionByName(level)
    return all_
