"""How close names are to the entries of a catalogue: the higher of two scores, the cosine of their letter pairs and the ratio of their matching blocks.

Names and entries meet over letter pairs that both have, so pairs without one in common are not looked at and have no score. The cosine comes from the counts of the shared pairs. The ratio can't exceed what
the letters in common allow; only where that bound is above the cosine are the blocks themselves looked for, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def longest_block(a: str, b: str) -> tuple[int, int, int]:
    """Where the longest common run of letters begins in a and in b, and its length; the first in a, then in b, among equals."""
    best, before = (0, 0, 0), [0] * (len(b) + 1)
    for i, x in enumerate(a):
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                now[j + 1] = before[j] + 1
                if now[j + 1] > best[2]:
                    best = (i - before[j], j - before[j], now[j + 1])
        before = now
    return best


def blocks_ratio(a: str, b: str) -> float:
    """Twice the letters in matching blocks by all letters: the longest block, then what is left and right of it."""
    if not a and not b:
        return 1.0
    matched, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        i, j, n = longest_block(x, y)
        if n:
            matched += n
            todo += [(x[:i], y[:j]), (x[i + n :], y[j + n :])]
    return 2 * matched / (len(a) + len(b))


def _pairs(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))


def _bound(a: Column, b: Column) -> Column:
    """What the ratio can be at most: letters in common, each as often as both have it."""
    times = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    both = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))
    return 2.0 * both / (F.length(a) + F.length(b))


def closest(names: DataFrame, name: str, entries: DataFrame, entry: str, k: int = 8) -> DataFrame:
    """name, entry, score (six digits), by_blocks (whether the ratio won) and pos from 1: the k closest entries of each distinct name, compared without case; ties by entry."""
    own = lambda df, c, to: df.select(F.lower(F.col(c)).alias(to)).filter(F.col(to) != "").distinct()
    grams = lambda df, c, n: df.select(c, F.explode(_pairs(F.col(c))).alias("g")).groupBy(c, "g").agg(F.count("*").alias(n))
    a, b = grams(own(names, name, "a"), "a", "n"), grams(own(entries, entry, "b"), "b", "m")
    size = lambda g, c, n, to: g.groupBy(c).agg(F.sqrt(F.sum(F.col(n) * F.col(n))).alias(to))
    met = a.join(b, "g").groupBy("a", "b").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    scored = met.join(size(a, "a", "n", "sa"), "a").join(size(b, "b", "m", "sb"), "b").select("a", "b", (F.col("dot") / (F.col("sa") * F.col("sb"))).alias("cos"))
    judged = scored.withColumn("most", _bound(F.col("a"), F.col("b")))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = zip(*(x.column(c).to_pylist() for c in ("a", "b", "cos", "most")), strict=True)
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), x.column("cos"), pa.array([blocks_ratio(p, q) if most > cos else None for p, q, cos, most in rows], pa.float64())], ["a", "b", "cos", "ratio"])

    both = judged.mapInArrow(look, "a string, b string, cos double, ratio double")
    final = both.select(F.col("a").alias(name), F.col("b").alias(entry), F.round(F.greatest("cos", F.coalesce("ratio", F.lit(0.0))), 6).alias("score"), F.coalesce(F.col("ratio") > F.col("cos"), F.lit(False)).alias("by_blocks"))
    place = F.row_number().over(W.partitionBy(name).orderBy(F.col("score").desc(), entry))
    return final.withColumn("pos", place).filter(F.col("pos") <= k)
