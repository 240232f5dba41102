"""Differences between two states of a table, and how a state is brought up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: new, changed, unchanged or deleted. One full outer join of two narrow projections."""
    a = old.select(F.col(key), F.col(digest).alias("_old"))
    b = new.select(F.col(key), F.col(digest).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep: Column | None = None) -> DataFrame:
    """All new rows, and the old ones whose key is not among them and that `keep` allows."""
    rest = old.join(new.select(key).distinct(), key, "left_anti")
    return new.unionByName(rest if keep is None else rest.filter(keep))


def set_difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, side: added or missing."""
    added = new.select(key).distinct().join(old.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("added"))
    missing = old.select(key).distinct().join(new.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("missing"))
    return added.unionByName(missing)


def seen_dates(catalogue: DataFrame, batch: DataFrame, key: str, day: str, carried: list[str]) -> DataFrame:
    """first_seen is kept, last_seen moves on, other fields take the newest value that is not null."""
    now = batch.groupBy(key).agg(F.min(day).alias("_first"), F.max(day).alias("_last"), *[F.max_by(c, day).alias(f"_{c}") for c in carried])
    both = catalogue.join(now, key, "full_outer")
    return both.select(
        key, F.coalesce("first_seen", "_first").alias("first_seen"), F.greatest("last_seen", "_last").alias("last_seen"), *[F.coalesce(f"_{c}", c).alias(c) for c in carried],
    )


def deletion_gate(held: int, to_delete: int, most: float = 0.2) -> str | None:
    """Why the deletion is refused, or None."""
    return f"{to_delete} of {held} would go" if held and to_delete > most * held else None
