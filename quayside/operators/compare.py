"""One question put to many providers: every provider in scope ends on exactly one side, with its best quote and its place, or with the reason why it has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def compared(scope: DataFrame, provider: str, members: DataFrame, member: str, value: Column, refusal: Column, highest: bool) -> DataFrame:
    """provider, member, value, place (from 1) and reason. members: rows of (provider, member); `refusal` is a member's reason, null where it is quoted, and `value` its quote. The best accepted
    quote of a provider counts, the smaller member among equals; without one the reason of its smallest member; a provider without members offers nothing."""
    quoted = members.select(provider, member, value.alias("_v"), refusal.alias("_r"))
    key = F.when(F.col("_r").isNull() & F.col("_v").isNotNull(), F.struct((-F.col("_v") if highest else F.col("_v")).alias("o"), F.col(member).alias("m")))
    best = quoted.groupBy(provider).agg(F.min(key).alias("_b"), F.min_by(F.coalesce("_r", F.lit("no quote")), F.when(F.col("_r").isNotNull() | F.col("_v").isNull(), F.col(member))).alias("_why"))
    sides = scope.select(provider).distinct().join(best, provider, "left")
    worth = -F.col("_b.o") if highest else F.col("_b.o")
    rows = sides.select(provider, F.col("_b.m").alias(member), worth.alias("value"), F.when(F.col("_b").isNull(), F.coalesce("_why", F.lit("not offered"))).alias("reason"))
    # Providers with a quote are ranked; they are as many as the providers of a market.
    place = F.rank().over(W.partitionBy(F.col("value").isNull()).orderBy(F.col("value").desc() if highest else F.col("value").asc()))
    return rows.withColumn("place", F.when(F.col("value").isNotNull(), place))
