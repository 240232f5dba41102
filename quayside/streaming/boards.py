"""Streams: latest board per key, alerts on the turn of a condition, states with the time since when they hold, windows, and
idempotent upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def latest_board(events: DataFrame) -> DataFrame:
    """The newest value of each instrument and bank, in update mode: state is one row for each of them, however long the stream runs."""
    newest = F.max_by(F.struct("value", "ts"), F.struct("ts", "event_id"))
    return events.groupBy(F.col("event_type").alias("instrument"), (F.col("user_id") % 4).alias("bank")).agg(newest.alias("n"), F.count("*").alias("updates")).select("instrument", "bank", "n.value", "n.ts", "updates")


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def edge_alerts(events: DataFrame, threshold: float) -> DataFrame:
    """One row for each time a user's value goes above the threshold; nothing while it stays there."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        above = bool(state.get[0]) if state.exists else False
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        hit = (rows["value"] > threshold).tolist()
        fired = [h and not b for h, b in zip(hit, [above, *hit[:-1]], strict=True)]
        state.update((bool(hit[-1]),))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"][fired], "value": rows["value"][fired]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, value double", "above boolean", "append", GroupStateTimeout.NoTimeout)


def status_since(events: DataFrame) -> DataFrame:
    """Changes of state (down after an error, else ok), each with the time since when it holds. Being fine when first seen is silent."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, since = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            now = "down" if r.event_type == "error" else "ok"
            if now != current:
                if current is not None or now != "ok":
                    out.append((key[0], r.event_id, now, r.ts))
                current, since = now, r.ts
        state.update((current, since))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "state", "since"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, state string, since timestamp", "state string, since timestamp", "append", GroupStateTimeout.NoTimeout)


BUCKETS = 16


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The batch numbers that each bucket's folder holds, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    for b in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "bucket_of_key=*/batch_of_rows=*")) or []:
        out.setdefault(int(b.getPath().getParent().getName().split("=")[1]), []).append(int(b.getPath().getName().split("=")[1]))
    return {b: sorted(n) for b, n in out.items()}


def upsert_into(path: str, key: str | list[str], order: str, buckets: int = BUCKETS):
    """A foreachBatch writer that keeps the newest row of each key. Keys are hashed into bucket folders, and a batch rewrites those that it has keys of, each as
    a new version named by the batch: it starts from the last version before its own number, so a batch that runs again gives the same. The version before
    stays for that; older ones go. Other buckets keep their files."""
    keys = [key] if isinstance(key, str) else key

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("r")).select("r.*", bucket.alias("bucket_of_key")).persist()
        touched = sorted(r.bucket_of_key for r in newest.select("bucket_of_key").distinct().collect())
        have = _versions(spark, path)
        before = {b: max((v for v in have.get(b, []) if v < n), default=None) for b in touched}
        rows = newest
        places = [f"{path}/bucket_of_key={b}/batch_of_rows={v}" for b, v in before.items() if v is not None]
        if places:
            old = spark.read.schema(batch.schema).parquet(*places).select("*", bucket.alias("bucket_of_key"))
            rows = newest.unionByName(old.join(newest.select(*keys), keys, "left_anti"))
        if touched:
            rows.withColumn("batch_of_rows", F.lit(n)).repartition(len(touched), "bucket_of_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket_of_key", "batch_of_rows").parquet(path)
        newest.unpersist()
        folder = spark._jvm.org.apache.hadoop.fs.Path
        fs = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for b, v in before.items():
            for older in have.get(b, []):
                if v is not None and older < v:
                    fs.delete(folder(f"{path}/bucket_of_key={b}/batch_of_rows={older}"), True)

    return write


def last_version(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows that upsert_into wrote last: the newest version of each bucket."""
    places = [f"{path}/bucket_of_key={b}/batch_of_rows={n[-1]}" for b, n in sorted(_versions(spark, path).items())]
    if not places:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(*places)
