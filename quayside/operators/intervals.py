"""Date windows: hull, intersection and verdicts against a given day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan


def hull(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The widest window of each key; an open side stays open only if all are."""
    return df.groupBy(*keys).agg(F.min(start).alias("start"), F.max(end).alias("end"))


def intersection(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The narrowest window of each key; where nothing is common the end is open."""
    both = df.groupBy(*keys).agg(F.max(start).alias("start"), F.min(end).alias("end"))
    return both.withColumn("end", F.when(F.col("start").isNull() | F.col("end").isNull() | (F.col("start") <= F.col("end")), F.col("end")))


def verdict(start: Column, end: Column, today: Column) -> Column:
    """Computed for a day, never stored."""
    return F.when(end < today, "expired").when(start > today, "scheduled").when(start.isNull() & end.isNull(), "unknown").otherwise("current")


def islands(df: DataFrame, key: str, order: list[str], state: str, time: str) -> DataFrame:
    """Since when each row's state has held without a break: adds since."""
    return scan.since(scan.ranged(df, [key], order), [key], order, state, time).drop("_part")
