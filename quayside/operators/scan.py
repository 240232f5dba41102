"""Running state of each key over rows spread across tasks: the previous row, the last value so far, runs of equal states.

Rows are range-partitioned by (key, order), so a key with any share of all rows is spread over as many tasks as it needs. Every task looks at its own
stretch of a key; one small row for each stretch carries on what the next stretch has to know. Equal orders are in any
order, so the order should be total. Nulls in a key are a key of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import cut


def ranged(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df in ranges, with the number of each row's range: the input of the functions below. Small ranges are put together unless their number is given."""
    columns = [F.col(c) for c in (*keys, *order)]
    return cut((df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)).select("*", F.spark_partition_id().alias("_part")))


def _carried(rows: DataFrame, summary: DataFrame, keys: list[str], carry: Column, name: str) -> DataFrame:
    """Adds to each row what the stretches before its own say of its key. A summary has a row for each stretch."""
    before = summary.select("_part", *keys, carry.alias(name)).filter(F.col(name).isNotNull())
    mine, other = rows.alias("r"), before.alias("b")
    same = F.col("r._part") == F.col("b._part")
    for k in keys:
        same &= F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}"))
    return mine.join(other, same, "left").select("r.*", F.col(f"b.{name}"))


def previous(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, first: str | None = None) -> DataFrame:
    """Adds the value of the row before, null for the first row of a key; `first` names a column that tells such rows."""
    here = W.partitionBy("_part", *keys).orderBy(*order)
    local = rows.withColumn("_p", F.lag(F.struct(value)).over(here))
    last = rows.groupBy("_part", *keys).agg(F.max_by(F.struct(F.col(value)), F.struct(*order)).alias("_v"))
    found = _carried(local, last, keys, F.lag("_v").over(W.partitionBy(*keys).orderBy("_part")), "_c")
    found = found.withColumn("_p", F.coalesce("_p", "_c")).withColumn(name, F.col("_p")[value])
    return (found.withColumn(first, F.col("_p").isNull()) if first else found).drop("_p", "_c")


def last_so_far(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the last value that is not null, up to and with the row itself."""
    here = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("_l", F.last(value, ignorenulls=True).over(here))
    known = rows.filter(F.col(value).isNotNull()).groupBy("_part", *keys).agg(F.max_by(value, F.struct(*order)).alias("_v"))
    stretches = rows.select("_part", *keys).distinct()
    same = F.col("s._part") == F.col("k._part")
    for k in keys:
        same &= F.col(f"s.{k}").eqNullSafe(F.col(f"k.{k}"))
    summary = stretches.alias("s").join(known.alias("k"), same, "left").select("s.*", "k._v")
    earlier = F.last("_v", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    found = _carried(local, summary, keys, earlier, "_c")
    return found.withColumn(name, F.coalesce("_l", "_c")).drop("_l", "_c")


def since(rows: DataFrame, keys: list[str], order: list[str], state: str, time: str, name: str = "since") -> DataFrame:
    """Adds since when each row's state has held without a break."""
    seen = previous(rows, keys, order, state, "_before", "_first")
    turned = F.col("_first") | ~F.col("_before").eqNullSafe(F.col(state))
    return last_so_far(seen.withColumn("_from", F.when(turned, F.col(time))), keys, order, "_from", name).drop("_before", "_first", "_from")
