"""Comparison tables in long form (one row for each cell) and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YES, NO = ("var", "sunuluyor", "evet"), ("yok", "sunulmuyor", "hayır", "-")


def family_axes(name: Column, kind: Column, size: Column) -> Column:
    purpose = F.when(name.contains("small") | kind.contains("SMALL"), "compact").when(name.contains("large") | kind.contains("LARGE"), "bulk").when(kind == "PROMO", "campaign")
    return F.array(purpose, F.when(size >= 40, "xl").when(size < 5, "xs"), F.when(kind == "ECONOMY", "economy"))


def intersect_bounds(df: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Per key the greatest low and least high, whether they leave room, and how many members cause each. Counts of the
    extremes come from the aggregate of (bound, count) pairs, so members aren't joined back."""
    lows = df.groupBy(key, low).agg(F.count("*").alias("c")).groupBy(key).agg(F.max(F.struct(low, "c")).alias("l"))
    highs = df.groupBy(key, high).agg(F.count("*").alias("c")).groupBy(key).agg(F.min_by("c", high).alias("n_high"), F.min(high).alias("high"))
    both = lows.join(highs, key)
    return both.select(key, F.col(f"l.{low}").alias("low"), "high", (F.col(f"l.{low}") <= F.col("high")).alias("possible"), F.col("l.c").alias("n_low"), "n_high")


def blank(value: Column) -> Column:
    """Null for what says that nothing is offered or known."""
    return F.when(F.lower(F.trim(value)).isin("", *NO), None).otherwise(value)


def status_columns(cells: DataFrame) -> DataFrame:
    """The first column of each table whose filled cells are all verdicts, at least one of them positive: table_id, col."""
    own = F.lower(F.trim("value"))
    filled = cells.filter(F.coalesce(F.trim("value"), F.lit("")) != "")
    kinds = filled.groupBy("table_id", "col").agg(F.min("pos").alias("pos"), F.bool_and(own.isin(*YES, *NO)).alias("verdicts"), F.bool_or(own.isin(*YES)).alias("any_yes"))
    return kinds.filter("verdicts and any_yes").groupBy("table_id").agg(F.min_by("col", "pos").alias("col"))


def offers(cells: DataFrame) -> DataFrame:
    """Per row of a table: true, false or null. The status column decides; without one, a row whose filled cells all say no is
    false, one without filled cells null. Null is not false."""
    status = status_columns(cells).withColumnRenamed("col", "status")
    own = F.lower(F.trim("value"))
    rows = cells.join(status, "table_id", "left")
    at_status = F.max(F.when((F.col("col") == F.col("status")) & (own != ""), own.isin(*YES)))
    filled = F.count(F.when(own != "", 1))
    negative = F.count(F.when(own.isin(*NO), 1))
    got = rows.groupBy("table_id", "bank").agg(F.max("status").alias("status"), at_status.alias("said"), filled.alias("filled"), negative.alias("negative"))
    verdict = F.when(F.col("status").isNotNull() & F.col("said").isNotNull(), F.col("said")).when(F.col("filled") == 0, None).when(F.col("filled") == F.col("negative"), False).otherwise(True)
    return got.select("table_id", "bank", verdict.cast("boolean").alias("offers"))


def column_types(cells: DataFrame) -> DataFrame:
    """The type of each column from its filled values: bool, number, link, date or text."""
    v = F.col("value")
    filled = cells.filter(v.isNotNull() & (v != ""))
    every = lambda p: F.bool_and(v.rlike(p))
    kind = F.when(every("^(true|false)$"), "bool").when(every("^-?[0-9]+(\\.[0-9]+)?$"), "number").when(every("^https?://"), "link").when(every("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date").otherwise("text")
    return filled.groupBy("table_id", "col").agg(kind.alias("type"), F.count("*").alias("n"))
