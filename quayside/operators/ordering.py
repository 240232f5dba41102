"""Places in a total order without one task that sees all rows, and the checkpoints that this needs."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return base or "file://" + tempfile.mkdtemp(prefix="quayside-")


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def placed(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Adds each row's place, from 1, in an order over all rows. Ranges of rows are sorted each in a task of its own, and numbered by the sizes of
    the ranges before: the window sees one row for each range. Ties are in any order, so the order should have none."""
    inner = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), inner.alias("_nth")))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_nth") + 1).alias(name))


def placed_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """Adds each row's place, from 1, among the rows of its keys; a key may hold any share of all rows."""
    rows = placed(df, [*map(F.col, keys), *order], "_at")
    first = rows.groupBy(*keys).agg(F.min("_at").alias("_first"))
    return rows.join(first, keys).select(*df.columns, (F.col("_at") - F.col("_first") + 1).alias(name))
