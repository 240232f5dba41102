"""Streaming queries over the events table, each driven once to its end into files of the shared folder, with the batch SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import shared_base
from ..streaming import boards, status
from .catalog import register


def _appended(stream: DataFrame) -> DataFrame:
    """What an appending stream writes."""
    base = f"{shared_base(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/rows")


def _upserted(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key of an updating stream."""
    base = f"{shared_base(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream.writeStream.outputMode("update").foreachBatch(boards.upsert_into(f"{base}/rows", keys, order)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return boards.last_version(stream.sparkSession, f"{base}/rows", stream.schema)


@register("stream_latest_board", "SELECT event_type AS instrument, user_id % 4 AS bank, arg_max(value, (ts, event_id)) AS value, count(*) AS updates FROM events GROUP BY 1, 2")
def stream_latest_board(spark: SparkSession, d: str) -> DataFrame:
    return _upserted(boards.latest_board(boards.read_events(spark, d)), ["instrument", "bank"], "updates").drop("ts")


@register("stream_edge_alerts", "SELECT user_id, event_id, value FROM (SELECT event_id, user_id, value, value > 40 AS hit, lag(value > 40) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE hit AND NOT coalesce(before, false)")
def stream_edge_alerts(spark: SparkSession, d: str) -> DataFrame:
    return _appended(boards.edge_alerts(boards.read_events(spark, d), 40))


@register("stream_status_changes", "SELECT user_id, event_id, state, ts AS since FROM (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'down' ELSE 'ok' END AS state, lag(CASE WHEN event_type = 'error' THEN 'down' ELSE 'ok' END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE (before IS NULL AND state <> 'ok') OR before <> state")
def stream_status_changes(spark: SparkSession, d: str) -> DataFrame:
    return _appended(boards.status_since(boards.read_events(spark, d)))


@register("stream_hourly_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(round(CAST(sum(value) AS DECIMAL(20,6)), 2) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    got = _upserted(boards.windowed_counts(boards.read_events(spark, d)), ["start", "event_type"], "n")
    return got.select("start", "event_type", "n", F.round(F.col("total").cast("decimal(20,6)"), 2).cast("double").alias("total"))


CHECKS = "CASE WHEN value > 45 THEN 'down' WHEN value > 15 THEN 'slow' ELSE 'ok' END"


@register(
    "stream_status_merge",
    f"""WITH e AS (SELECT user_id, event_id, event_type AS product, {CHECKS} AS state, epoch_us(ts) AS us FROM events WHERE epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) - 600000 FROM events)),
    g AS (SELECT *, CASE WHEN us // 1000 > lag(us) OVER w // 1000 + {status.QUIET_MS} THEN 1 ELSE 0 END AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)), s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY us, event_id) AS seg FROM g),
    p AS (SELECT *, lag(state) OVER (PARTITION BY user_id, seg, product ORDER BY us, event_id) AS prior FROM s), t AS (SELECT *, prior IS DISTINCT FROM state AS turned FROM p),
    f AS (SELECT *, max(CASE WHEN turned THEN us END) OVER (PARTITION BY user_id, seg, product ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM t)
    SELECT user_id, product, event_id, coalesce(prior, 'unknown') AS before, since, state, us AS at FROM f WHERE turned AND (prior IS NOT NULL OR state <> 'ok')
    UNION ALL SELECT user_id, NULL, NULL, NULL, max(us), 'stale', max(us) + {status.QUIET_MS * 1000} FROM s GROUP BY user_id, seg HAVING max(us) // 1000 + {status.QUIET_MS} <= (SELECT epoch_ms(max(ts)) - 600000 FROM events)""",
)
def stream_status_merge(spark: SparkSession, d: str) -> DataFrame:
    """Checks of all sources in six lots of files, those of the same minutes spread over two of them, read in many micro-batches, a lot each, with a restart in between."""
    base = f"{shared_base(spark).rstrip('/')}/status-{uuid.uuid4().hex}"
    e = spark.read.schema(boards.EVENT).parquet(f"{d}/events.parquet").select("ts", "user_id", "event_id", F.col("event_type").alias("product"), F.expr(CHECKS).alias("state")).filter("ts IS NOT NULL")
    first, last, n = e.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts")), F.count("*")).first()
    # A row may come up to four minutes after its time.
    seen = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(240)) * 1_000_000
    slot = F.least(F.floor((seen - F.lit(first or 0)) * 6 / F.lit(max(1, (last or 0) - (first or 0)))), F.lit(5)).cast("int")
    cores = spark.sparkContext.defaultParallelism
    files, buckets, partitions = n // 3_000_000 + 1, max(status.BUCKETS, n // 100_000), cores * (n // (2_000_000 * cores) + 1)
    for k in range(6):
        _in_files(e.filter(slot == k), files).write.mode("append").parquet(f"{base}/in")
        if k in (2, 5):
            checks = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
            status.run_to_end(status.status_changes(checks, buckets=buckets), base, partitions)
    return spark.read.schema(status.OUT).parquet(f"{base}/rows")


def _in_files(rows: DataFrame, n: int) -> DataFrame:
    """Rows dealt so that writing them makes exactly n files, however few they are: each file has a row without any value, as an empty one would not be written."""
    marks = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("_file"))
    dealt = rows.withColumn("_file", F.pmod(F.xxhash64(*rows.columns), F.lit(n)).cast("int")).unionByName(marks, allowMissingColumns=True)
    return dealt.repartitionById(n, F.col("_file")).drop("_file")
