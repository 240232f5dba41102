"""Status of many sources from a stream of checks, in order of event time, with timers.

Sources are dealt into buckets, and a bucket is a key of the stateful operator: one call to the state or a timer serves all of its sources, and their rows are merged together in arrays.
The rows of a bucket are packed into blocks in order of time before they are dealt out, and wait as such blocks in state until the watermark has passed them, so rows that come late within the delay are still taken in order, and the result does not depend on
how the stream was cut into micro-batches. A source holds a state for each of its products with the time since when it holds; products that a check does not name keep theirs.
A source without a check for QUIET is stale: a timer says so and its state is given back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DELAY = "10 minutes"
QUIET_MS = 3 * 60 * 60 * 1000
OUT = "user_id long, product string, event_id long, before string, since long, state string, at long"
#: Rows of a block of the state at most, and rows that a task holds while it makes blocks.
BLOCK, PACK = 4096, 1 << 18
#: Rows that are merged at once, beyond those of one millisecond.
MERGE = 1 << 18
#: Buckets that sources are dealt into; what a stream started with holds for its checkpoint.
BUCKETS = 64
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A check, and what a source holds of a product: there us is the time of the source's last check. since is when the state was first seen.
ROW = pa.schema([("user_id", pa.int64()), ("us", pa.int64()), ("event_id", pa.int64()), ("product", pa.string()), ("state", pa.string()), ("since", pa.int64())])


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ROW) as w:
        w.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(value: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(value)).read_all()


def _blocks(rows: pa.Table) -> Iterator[tuple[int, bytes]]:
    """Rows in order of time as blocks, each with its least time."""
    for at in range(0, rows.num_rows, BLOCK):
        some = rows.slice(at, BLOCK)
        yield some["us"][0].as_py(), _packed(some)


def _first_after(rows: pa.Table, ms: int) -> int:
    return int(np.searchsorted(rows["us"].to_numpy(), (ms + 1) * 1000))


def _of_source(part: pd.DataFrame, source: int) -> pa.Table:
    """The checks of one source, in order of time."""
    part = part.sort_values("us", kind="stable")
    columns = [pd.Series([source] * len(part)), part["us"], part["event_id"], part["product"], part["state"], part["us"]]
    return pa.Table.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(columns, ROW.types, strict=True)], schema=ROW)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of many batches as blocks of their buckets, with the time of a block's last row, which the watermark is taken from."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += batch.num_rows
        if n >= PACK:
            yield _buckets(some)
            some, n = [], 0
    if n:
        yield _buckets(some)


def _buckets(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches)
    rows = rows.take(np.lexsort((rows["us"].to_numpy(), rows["bucket"].to_numpy()))).combine_chunks()
    bucket, at = rows["bucket"].to_numpy(), np.flatnonzero(_turns(rows["bucket"].to_numpy()))
    us, rows, made = rows["us"], rows.append_column("since", rows["us"]).select(ROW.names).cast(ROW), []
    for start, stop in zip(at, [*at[1:], len(bucket)], strict=True):
        for k, (least, packed) in enumerate(_blocks(rows.slice(start, stop - start))):
            made.append((bucket[start], us[min(start + (k + 1) * BLOCK, stop) - 1].as_py(), least, packed))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int32(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary()), strict=True)], names=["bucket", "ts", "least", "rows"])


def _slices(due: list[pa.Table], now: int) -> Iterator[tuple[pa.Table, int]]:
    """Due rows by time, some MERGE at once, each with the millisecond that they reach to: a merge in steps makes the same rows."""
    times = np.sort(np.concatenate([np.empty(0, dtype="int64"), *(t["us"].to_numpy() // 1000 for t in due)]))
    begun = [0] * len(due)
    for until in [*np.unique(times[MERGE - 1 :: MERGE]).tolist(), now]:
        done = [_first_after(t, until) for t in due]
        yield pa.concat_tables([ROW.empty_table(), *(t.slice(a, b - a) for t, a, b in zip(due, begun, done, strict=True))]), until
        begun = done


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, null being one, and the values."""
    found = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def _turns(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first does."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _ends(start: np.ndarray) -> np.ndarray:
    """The last row of each run, by where runs start."""
    return np.roll(start, -1)


def merge(held: pa.Table, due: pa.Table, now: int, quiet_ms: int) -> tuple[pd.DataFrame, pa.Table]:
    """What due checks, in order of arrival where they are the same event, and the time make of what the sources hold: the rows to tell and what is held then."""
    rows = pa.concat_tables([held, due])
    who, users = _codes(rows["user_id"])
    what, products = _codes(rows["product"])
    how, states = _codes(rows["state"])
    us, at = rows["us"].to_numpy(), rows["since"].to_numpy()
    event, no_event = rows["event_id"].fill_null(0).to_numpy(), rows["event_id"].is_null().to_numpy()
    new = np.arange(len(who)) >= held.num_rows
    order = np.lexsort((what, event, no_event, us, new, who))
    # An event of a product that came twice counts once, as it came last.
    again = ~_ends(_turns(*(c[order] for c in (what, event, no_event, us, new, who)))) & (new & ~no_event)[order]
    order = order[~again]
    who, what, how, us, at, event, no_event, new = (c[order] for c in (who, what, how, us, at, event, no_event, new))

    # A source that was quiet for too long starts anew.
    mine = ~_turns(who)
    gap = np.zeros(len(who), dtype=bool)
    gap[1:] = mine[1:] & (us[1:] // 1000 > us[:-1] // 1000 + quiet_ms)
    seg = np.cumsum(gap | ~mine)
    end = _ends(~mine)
    last, seg_last = us[end], seg[end]
    gone = last // 1000 + quiet_ms <= now
    at_gap = np.flatnonzero(gap) - 1
    stale_who, stale_us = np.append(who[at_gap], who[end][gone]), np.append(us[at_gap], last[gone])

    # The checks of a product between such starts, each with the state before.
    nth = np.cumsum(~mine) - 1
    by = np.lexsort((what, seg))
    who, what, how, at, event, no_event, new, seg, nth = (c[by] for c in (who, what, how, at, event, no_event, new, seg, nth))
    start = _turns(seg, what)
    turned = start | _turns(how)
    turn = np.maximum.accumulate(np.where(turned, np.arange(len(who)), 0))
    ok = states.index(pa.scalar("ok", pa.string())).as_py()
    tell = np.flatnonzero(new & turned & (~start | (how != ok)))
    first = start[tell]
    before = np.maximum(tell - 1, 0)
    named = lambda values, codes: values.to_numpy(zero_copy_only=False)[codes] if len(values) else np.empty(0, dtype=object)
    n, source = len(stale_who), pd.array(users.to_pandas(integer_object_nulls=True), dtype="Int64")
    told = pd.DataFrame({
        "user_id": source[np.append(who[tell], stale_who)],
        "product": np.append(named(products, what[tell]), [None] * n),
        "event_id": pd.arrays.IntegerArray(np.append(event[tell], np.zeros(n, dtype="int64")), np.append(no_event[tell], np.ones(n, dtype=bool))),
        "before": np.append(np.where(first, "unknown", named(states, how[before])), [None] * n),
        "since": pd.arrays.IntegerArray(np.append(at[turn[before]], stale_us), np.append(first, np.zeros(n, dtype=bool))),
        "state": np.append(named(states, how[tell]), ["stale"] * n),
        "at": np.append(at[tell], stale_us + quiet_ms * 1000),
    })

    keep = np.flatnonzero(_ends(start) & (seg == seg_last[nth]) & ~gone[nth])
    kept = [users.take(pa.array(who[keep])), last[nth[keep]], pa.nulls(len(keep), pa.int64()), products.take(pa.array(what[keep])), states.take(pa.array(how[keep])), at[turn[keep]]]
    return told, pa.Table.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in kept], schema=ROW)


class StatusMerge(StatefulProcessor):
    """Changes of state only; being fine when first seen is silent. Times are microseconds. A key is a bucket of sources, with rows as pack makes them, or a source with its checks."""

    def __init__(self, quiet_ms: int = QUIET_MS) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: Blocks of up to BLOCK rows in order of time, numbered in order of arrival.
        self.waiting = handle.getMapState("waiting", "block long", "least long, rows binary")
        self.held = handle.getValueState("held", "rows binary")
        #: When something is due next, in milliseconds, and the number of the next block. Timers that were registered for later and come first find nothing due.
        self.next = handle.getValueState("next", "ms long, block long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, block = self.next.get() if self.next.exists() else (None, 0)
        least = due
        for part in rows:
            for first, packed in self._in_time(part, timerValues.getCurrentWatermarkInMs()) if "rows" in part else _blocks(_of_source(part, key[0])):
                self.waiting.updateValue((block,), (first, packed))
                least, block = first // 1000 if least is None else min(least, first // 1000), block + 1
        if least is not None:
            self._wake(least, block, least != due)
        yield from ()

    def _in_time(self, part: pd.DataFrame, now: int) -> Iterator[tuple[int, bytes]]:
        """Blocks as they came, without rows that come after the watermark has passed them."""
        for least, packed in zip(part["least"].tolist(), part["rows"], strict=True):
            if least // 1000 > now:
                yield least, bytes(packed)
            else:
                rows = _unpacked(packed)
                yield from _blocks(rows.slice(_first_after(rows, now)))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        at, number = self.next.get() if self.next.exists() else (now + 1, 0)
        if at > now:
            return
        due, least = [], []
        for block, first, rows in sorted((tuple(k)[0], *tuple(v)) for k, v in self.waiting.iterator()):
            if first // 1000 <= now:
                rows = _unpacked(rows)
                n = _first_after(rows, now)
                due.append(rows.slice(0, n))
                if n == rows.num_rows:
                    self.waiting.removeKey((block,))
                    continue
                first = rows["us"][n].as_py()
                self.waiting.updateValue((block,), (first, _packed(rows.slice(n))))
            least.append(first // 1000)
        held = _unpacked(self.held.get()[0]) if self.held.exists() else ROW.empty_table()
        for some, until in _slices(due, now):
            told, held = merge(held, some, until, self.quiet_ms)
            if len(told):
                yield told
        if held.num_rows:
            self.held.update((_packed(held),))
            least.append(int(held["us"].to_numpy().min()) // 1000 + self.quiet_ms)
        else:
            self.held.clear()
        if least:
            self._wake(min(least), number)
        else:
            self.next.clear()

    def _wake(self, ms: int, block: int, timer: bool = True) -> None:
        self.next.update((ms, block))
        if timer:
            self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


def status_changes(checks: DataFrame, delay: str = DELAY, quiet_ms: int = QUIET_MS, buckets: int = BUCKETS) -> DataFrame:
    """checks: ts, user_id, event_id, product, state; to the changes of each product and the sources that went stale."""
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")
    rows = checks.filter(F.col("ts").isNotNull()).select(bucket.alias("bucket"), F.unix_micros("ts").alias("us"), *(F.col(c).cast("long") for c in ("user_id", "event_id")), "product", "state")
    packed = rows.mapInArrow(pack, "bucket int, ts timestamp, least long, rows binary").withWatermark("ts", delay)
    return packed.groupBy("bucket").transformWithStateInPandas(StatusMerge(quiet_ms), OUT, "append", "eventTime")


def run_to_end(changes: DataFrame, base: str, partitions: int | None = None) -> None:
    """Read all that is there into files under base, go on from the checkpoint there. State is kept in RocksDB, for the processor needs it, in so many partitions as the first run says."""
    spark: SparkSession = changes.sparkSession
    wanted = {"spark.sql.streaming.stateStore.providerClass": PROVIDER} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        changes.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
