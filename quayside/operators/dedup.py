"""Duplicate handling: groups, canonical members, common lines, unique names, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import ordering


def duplicate_groups(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Keys that occur twice or more, their number of rows and their least id. One shuffle, summed before it."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(id_col).alias("canonical")).filter("n > 1")


def redundant_to_canonical(df: DataFrame, key: str, id_col: str, refs: str) -> DataFrame:
    """Every redundant id and the member that stands for it: most references, then the least id. The choice is an aggregate, so a
    large group is summed before the shuffle; only members of real groups are joined back."""
    best = df.groupBy(key).agg(F.min_by(id_col, F.struct(-F.col(refs), F.col(id_col))).alias("canonical"), F.count("*").alias("_n")).filter("_n > 1")
    return df.join(best, key).filter(F.col(id_col) != F.col("canonical")).select(F.col(id_col).alias("redundant"), "canonical")


def common_lines(docs: DataFrame, group: str, share: float, least_docs: int) -> DataFrame:
    """Lines on at least `share` of a group's documents, for groups of enough documents: group, line, n."""
    n_docs = docs.groupBy(group).agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= least_docs)
    each = docs.select(group, F.explode(F.array_distinct(X.lines(F.col("text")))).alias("line")).groupBy(group, "line").agg(F.count("*").alias("n"))
    return each.join(n_docs, group).filter(F.col("n") >= share * F.col("n_docs")).select(group, "line", "n")


def unique_suffix(df: DataFrame, name: str, order: str) -> DataFrame:
    """Names made unique by -2, -3, ... in an order; a name may stand on any share of the rows."""
    placed = ordering.placed_within(df, [name], [F.col(order)], "_nth")
    return placed.withColumn(name, F.when(F.col("_nth") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), F.col("_nth").cast("string")))).drop("_nth")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: the whole row is carried as one struct through an aggregate, no window is needed."""
    names = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*names), rank).alias("_row")).select(*keys, "_row.*")


def without(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def merge_sources(a: DataFrame, b: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Union of two source lists, one row for each id within a key; rows without an id all stay."""
    both = a.unionByName(b)
    known = both.filter(F.col(id_col).isNotNull()).dropDuplicates([*keys, id_col])
    return known.unionByName(both.filter(F.col(id_col).isNull()))
