"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's target is its share by weight of all words, at most `most_repeats` times its own; what it can't take is shared
again by weight. Targets are dealt in blocks of equally many words: the blocks go to the sources with the highest
quotients words / (2 * blocks held + 1), and a source's blocks to its shards the same way. In a shard the
documents stand in a seeded order, their words form a ring, and the shard's blocks are taken from a seeded
block on; a ring may be gone round several times, which repeats documents.

Shards keep a source with a third of all rows from meeting in one task: a shard has about
max(1000, 4 * sqrt(all rows)) rows, so neither the rows of a shard nor the shards of a source grow in proportion.

Cases: a null source is a source of its own, the last one; null and empty texts have size 0 and are never taken; sources
of size 0 have target 0; documents are placed by a hash of doc_id, source and text, so rows that share a null or repeated doc_id are spread over shards;
rows equal in all three are rows of their own (which of them is taken from may vary, the result as a whole does
not); of equal quotients the source first by code point, null last, the lower shard gets the block; a very long text is one row and
only its size is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import stored

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BLOCK_WORDS = 64
SEED = 20
SALTS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """sources: source, source_size. Adds target. The windows without a key see one row per source.

    Sources are ordered by the level at which they would be full; the first level that holds when all
    before are full is the final one."""
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    given = F.array(*[F.lit(w) for w in weights])
    rows = sources.withColumn("weight", F.get(given, (nth - 1) % len(weights))).withColumn("room", most_repeats * F.col("source_size"))
    full_at = (F.col("room") / F.col("weight")).alias("full_at")
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    rows = rows.select("*", full_at).withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("room").over(before), F.lit(0))) / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "level"))).over(every)["level"]
    return rows.withColumn("final", level).select("source", "source_size", F.least(F.col("weight") * F.col("final"), F.col("room").cast("double")).alias("target"))


def sainte_lague(parties: DataFrame, votes: str, seats: str, by: list[str], key: Column) -> DataFrame:
    """Adds quota: how many of the group's seats each party gets. Quotients are compared only for the seats that can be in
    question: a party's quota differs from its exact share by at most half a seat for each party, times its share, plus a half."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    share = F.when(F.sum(votes).over(group) > 0, F.col(votes) / F.sum(votes).over(group)).otherwise(F.lit(0.0))
    rows = parties.withColumn("_share", share).withColumn("_slack", F.ceil(F.col("_share") * F.count("*").over(group) / 2) + 2)
    rows = rows.withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_share") * F.col(seats)) - F.col("_slack"))).withColumn("_high", F.ceil(F.col("_share") * F.col(seats)) + F.col("_slack"))
    rows = rows.withColumn("_open", F.col(seats) - F.sum("_low").over(group))
    each = rows.withColumn("_seat", F.explode(F.sequence("_low", "_high"))).withColumn("_quotient", F.col(votes) / (2 * F.col("_seat") + 1))
    won = F.row_number().over(group.orderBy(F.col("_quotient").desc(), key, "_seat")) <= F.col("_open")
    names = parties.columns
    return each.withColumn("_won", won & (F.col(votes) > 0)).groupBy(*names).agg((F.min("_low") + F.sum(F.col("_won").cast("long"))).alias("quota"))


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))


def mix(spark: SparkSession, docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, row (a hash of doc_id, source and text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), row_key().alias("row"))
    rows = stored(rows, spark, "sizes")
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    per_shard = max(1000, 4 * math.isqrt(n))
    goal = targets(stats.drop("n"))
    quotas = sainte_lague(goal.withColumn("seats", F.lit((total + block_words // 2) // block_words).cast("long")), "target", "seats", [], F.col("source").asc_nulls_last())
    quotas = quotas.join(stats.select(F.col("source").alias("_s"), F.ceil(F.col("n") / per_shard).alias("n_shards")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "seats")
    quotas = stored(quotas, spark, "quotas")

    # Each source stands once for each salt, so that the rows of a large source are spread over tasks.
    place = F.xxhash64(F.lit(seed), "row")
    salted = quotas.select(F.col("source").alias("_s"), "source_size", "target", F.col("quota").alias("blocks"), "n_shards", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    dealt = rows.withColumn("place", place).join(salted, F.col("source").eqNullSafe(F.col("_s")) & (F.pmod("place", F.lit(SALTS)) == F.col("_salt")))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("place"), F.col("n_shards"))).drop("_s", "_salt", "n_shards")

    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"))
    shards = sainte_lague(shards, "words", "blocks", ["source"], F.col("shard").asc())
    ring = F.least(F.col("quota") * block_words, most_repeats * F.col("words"))
    full = F.when(F.col("words") > 0, F.floor(ring / F.col("words"))).otherwise(F.lit(0))
    start = F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.greatest(F.ceil(F.col("words") / block_words), F.lit(1))) * block_words
    shards = shards.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "words", full.cast("long").alias("rounds"), (ring - full * F.col("words")).cast("long").alias("rest"), start.cast("long").alias("start"))

    order = Window.partitionBy("source", "shard").orderBy("place", "row", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("begin", F.coalesce(F.sum("size").over(order), F.lit(0)))
    both = placed.join(shards, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    end, stop = F.col("begin") + F.col("size"), F.col("start") + F.col("rest")
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(end, b) - F.greatest(F.col("begin"), a))
    part = overlap(F.col("start"), stop) + overlap(F.lit(0), stop - F.col("words"))
    return both.select("doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size") + part).alias("taken"), "row")


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents of the mix, whole, as often as it takes them: a remainder of half of a document or more counts as one.

    Rows equal in doc_id, source and text share their takes evenly."""
    takes = mix(spark, docs).groupBy(F.col("row").alias("_row")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = takes.filter("taken > 0").select("_row", F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int").alias("_times")).filter("_times > 0")
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("_doc"), row_key().alias("_row")).join(times, "_row")
    return rows.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[F.col("_doc").getField(c).alias(c) for c in names])
