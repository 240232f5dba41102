"""Joins that are not plain equi-joins: nearest and containing bands, tiers, prefixes, as-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan


def nearest(value: Column, bands: list[int], tolerance: float = 0.15) -> Column:
    """The nearest of a short list of bands, the smaller of two as near; past the last band the last; null beyond the tolerance."""
    near = F.array_min(F.transform(F.array(*[F.lit(b) for b in sorted(bands)]), lambda b: F.struct(F.abs(b - value).alias("off"), b.alias("band"))))
    return F.when((value >= max(bands)) | (near["off"] <= tolerance * value), near["band"])


def nearest_band(df: DataFrame, value: str, bands: list[int], tolerance: float = 0.15) -> DataFrame:
    """Adds band. The list is part of the expression, so there is no join."""
    return df.withColumn("band", nearest(F.col(value), bands, tolerance))


def containing_band(df: DataFrame, value: str, bands: DataFrame, low: str, high: str, order: str, cell: float = 10) -> DataFrame:
    """The first band (by `order`) with low <= value <= high, or nulls. Bands are cut into cells of the given width, in which they meet the distinct
    values by equality; the bands found go back to the rows by value."""
    names = bands.columns
    cells = bands.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))))
    values = df.select(F.col(value).alias("_value")).distinct().withColumn("_at", F.floor(F.col("_value") / cell))
    inside = (F.col("_at") == F.col("_cell")) & (F.col("_value") >= F.col(low)) & (F.col("_value") <= F.col(high))
    found = values.join(cells, inside).groupBy("_value").agg(F.min(F.struct(F.col(order).alias("_order"), *names)).alias("_band"))
    return df.join(found, F.col(value) == F.col("_value"), "left").select(*df.columns, *[F.col(f"_band.{c}").alias(c) for c in names])


def tiered(df: DataFrame, catalogue: DataFrame, tiers: list[tuple[Column, Column]], id_cols: list[str], target: str) -> DataFrame:
    """Equality joins tried in order: a row takes its matches of the first tier that has any; more than one is ambiguous and gives
    null. Adds tier, n_matches and target."""
    found = None
    for n, (left, right) in enumerate(tiers):
        side = catalogue.select(right.alias("_k"), F.col(target)).distinct()
        got = df.withColumn("_l", left).join(side, F.col("_l") == F.col("_k")).select(*id_cols, F.lit(n).alias("tier"), target)
        found = got if found is None else found.unionByName(got)
    best = found.groupBy(*id_cols, "tier").agg(F.count_distinct(target).alias("n_matches"), F.min(target).alias(target))
    first = best.groupBy(*id_cols).agg(F.min(F.struct("tier", "n_matches", target)).alias("_m")).select(*id_cols, "_m.*")
    return first.withColumn(target, F.when(F.col("n_matches") == 1, F.col(target)))


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """The last value of `right` at or before each row's time, by union and a running scan: no pair of rows is formed, and a key may hold any share of the rows."""
    a = left.withColumn("_t", F.col(left_time)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    b = right.select(by, F.col(right_time).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    for c in left.columns:
        if c != by:
            b = b.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    both = scan.ranged(a.unionByName(b.select(a.columns)), [by], ["_t", "_side"])
    return scan.last_so_far(both, [by], ["_t", "_side"], "_v", value).filter("_side = 1").drop("_t", "_v", "_side", "_part")


def scope_partition(scope: DataFrame, members: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Who offers and who doesn't: every key of the scope is on exactly one side."""
    return scope.join(members, key), scope.join(members.select(key).distinct(), key, "left_anti")
