"""Facts about keys of the whole corpus, asked and answered in packed form.

Documents are packed into batch files of a few MB in the shared folder, once. A step goes over
every batch, makes the sorted distinct 64-bit keys of its texts with a value for each, and sends
them to buckets by their leading bits: a row per batch and bucket that has keys, holding arrays. A bucket joins
the values of equal keys over all batches and answers every batch in the order that it asked.
A step gets the answers to the earlier steps that it names; it reads the texts only if it looks at them. What a step saves of a batch, such as the few lines or windows that are
still in question, later steps get back, so they need not make it again.

A key adds one entry per batch however often it occurs there, so a line, passage or copy that a
third of all documents share is summed before the shuffle and cannot fill one task. Lost executors cost a retry of their tasks only: batch files are
named by the attempt that lists them, and answers are stored in the shared folder.

Size. A step's rows are at most its keys, and at most batches times buckets. From GROW bytes on a batch takes several files and a bucket as many times more bytes, both with the
root of the corpus, so that rows grow with it and not with its square, up to MAX_FILES files. Work in a batch follows the buckets that it has keys for, never the number
of all. Tasks are at most MAX_TASKS, whatever the number of batches and buckets. Files and answers go when the result is stored.
"""

from __future__ import annotations

import gc
import io
import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import text_bytes
from ._shared import Store, forget, release, remove, shared_dir, sorted_groups, stored

BATCH_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
TASK_BATCHES = 4
GROW = 1 << 30
MAX_FILES = 16
MAX_TASKS = 1 << 14
NO_ID = np.iinfo(np.int64).max
ANSWERS = "batch long, step int, bucket int, n int, answer binary"


class Texts:
    """One batch: ids (NO_ID for null), all bytes, where each text begins, the answers to earlier steps, and what these saved."""

    def __init__(self, store: Store, files: str, answers: dict[int, tuple[np.ndarray, np.ndarray]], saved: dict[int, str]) -> None:
        self.store, self.files, self.answers, self._saved = store, files.split(","), answers, saved
        self.to_save: dict[str, np.ndarray] | None = None

    @cached_property
    def _rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = []
        for name in self.files:
            with self.store.open(name) as f:
                parts.append(ipc.open_stream(f.read()).read_all())
        t = pa.concat_tables(parts).combine_chunks()
        return t.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy(), *text_bytes(t.column("text"))

    ids = property(lambda self: self._rows[0])
    data = property(lambda self: self._rows[1])
    at = property(lambda self: self._rows[2])

    def save(self, **arrays: np.ndarray) -> None:
        """For later steps; written to the shared folder under a name of this attempt."""
        self.to_save = arrays

    def saved(self, step: int) -> dict[str, np.ndarray]:
        with self.store.open(self._saved[step]) as f:
            raw = f.read()
        with np.load(io.BytesIO(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True))) as z:
            return {k: z[k] for k in z.files}

    def bits(self, step: int) -> np.ndarray:
        """The yes/no answers to the keys of a step, in order of the keys. Each row of answers begins at a byte."""
        n, raw = self.answers.get(step, (np.zeros(0, np.int64), np.zeros(0, np.uint8)))
        if not len(n):
            return np.zeros(0, bool)
        return np.unpackbits(raw)[_padded(n)].astype(bool)

    def longs(self, step: int) -> np.ndarray:
        """Signed integers as answers, in order of the keys."""
        return self.answers[step][1].view(np.int64) if step in self.answers else np.zeros(0, np.int64)


def _padded(n: np.ndarray) -> np.ndarray:
    """Places of n[0], n[1], ... bits of which each row begins at a byte."""
    room = -(-n // 8) * 8
    return np.repeat(np.cumsum(room) - room - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _binaries(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Slices of an array, from cut to cut, as one binary each."""
    data = np.ascontiguousarray(data)
    offsets = (cuts * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data.view(np.uint8))])


def pack_batches(spark: SparkSession, docs: DataFrame, batch_bytes: int = BATCH_BYTES, grow: int = GROW) -> tuple[str, DataFrame, int]:
    """Write doc_id and text of all rows to batch files: the folder, a stored row (batch, file, n_bytes) for each batch, and how many files a batch has at most."""
    folder = shared_dir(spark, "batches")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, held, size = Store(folder), [], 0

        def flush() -> pa.RecordBatch:
            key = uuid.uuid4()
            out = io.BytesIO()
            t = pa.Table.from_batches(held).combine_chunks()
            with ipc.new_stream(out, t.schema, options=ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            store.publish(f"{key.hex}.arrow", [out.getbuffer()])
            return pa.RecordBatch.from_pydict({"batch": [key.int >> 65], "file": [f"{key.hex}.arrow"], "n_bytes": [size]})

        for b in batches:
            b = b.set_column(1, "text", b.column("text").cast(pa.large_string()))
            _, at = text_bytes(b.column("text"))
            i = 0
            while i < b.num_rows:
                j = min(b.num_rows, max(i + 1, int(np.searchsorted(at, at[i] + max(0, batch_bytes - size), "right")) - 1))
                held.append(b.slice(i, j - i))
                size += int(at[j] - at[i])
                i = j
                if size >= 0.9 * batch_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, "batch long, file string, n_bytes long")
    files = stored(rows, spark, "batch-list")
    n, total = files.agg(F.count("*"), F.sum("n_bytes")).first()
    each = min(MAX_FILES, math.isqrt(max(1, (total or 0) // grow)))
    if each == 1:
        return folder, files, 1

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), pa.schema([("batch", pa.int64()), ("file", pa.string()), ("n_bytes", pa.int64())]))
        for i in range(0, t.num_rows, each):
            g = t.slice(i, each)
            yield pa.RecordBatch.from_pydict({"batch": [g.column("batch")[0].as_py()], "file": [",".join(g.column("file").to_pylist())], "n_bytes": [pc.sum(g.column("n_bytes")).as_py()]})

    grouped = stored(files.repartition(max(1, n // (64 * each)), "batch").mapInArrow(several, "batch long, file string, n_bytes long"), spark, "batch-list")
    forget(spark, files)
    return folder, grouped, each


class Exchange:
    """Steps over the batches of a set of documents."""

    def __init__(self, spark: SparkSession, docs: DataFrame, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES, grow: int = GROW) -> None:
        self.spark = spark
        self.folder, self.batches, each = pack_batches(spark, docs, batch_bytes, grow)
        n, total = self.batches.agg(F.count("*"), F.sum("n_bytes")).first()
        self.n_batches = max(1, n)
        self.shift = max(2, (-(-(total or 0) // (bucket_bytes * each)) - 1).bit_length())
        self.answers: list[DataFrame] = []

    def _over_batches(self, work: Callable[[Texts], Iterator[pa.RecordBatch]], batch_key: bool, schema: str, needs: tuple[int, ...]) -> DataFrame:
        folder = self.folder
        asked = self.batches.select("batch", F.lit(-1).alias("step"), F.lit(0).alias("bucket"), F.lit(0).alias("n"), F.col("file").cast("binary").alias("answer"))
        for k in needs:
            asked = asked.unionByName(self.answers[k])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store = Store(folder)
            for g in sorted_groups(batches, ["batch"]):
                g = g.combine_chunks()
                step, bucket, n = (g.column(c).to_numpy().astype(np.int64) for c in ("step", "bucket", "n"))
                raw, at = text_bytes(g.column("answer"))
                answers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                saved: dict[int, str] = {}
                for k in needs:
                    a, b = np.searchsorted(step, [k, k + 1])
                    if a < b and bucket[a] < 0:
                        saved[k] = raw[at[a] : at[a + 1]].tobytes().decode()
                        a += 1
                    if a < b:
                        answers[k] = n[a:b], raw[at[a] : at[b]]
                for out in work(Texts(store, raw[: at[1]].tobytes().decode(), answers, saved)):
                    yield out.add_column(0, "batch", pa.array(np.full(out.num_rows, g.column("batch")[0].as_py()))) if batch_key else out
                release()

        return asked.repartition(min(MAX_TASKS, -(-self.n_batches // TASK_BATCHES)), "batch").sortWithinPartitions("batch", "step", "bucket").mapInArrow(run, schema)

    def ask(self, keys_of: Callable[[Texts], tuple[np.ndarray, list[np.ndarray]]], join: Callable[[np.ndarray, list[np.ndarray]], np.ndarray], types: list[str], needs: tuple[int, ...] = ()) -> None:
        """One step. keys_of: the sorted distinct keys of a batch, and arrays of values beside them, of these types.
        join: from where each key of a bucket begins among all that were asked, and the values, an answer for each key or for each that asked: booleans or int64. needs: the earlier steps whose answers keys_of looks at."""
        shift, step = self.shift, len(self.answers)
        vals_of = [f"v{i}" for i in range(len(types))]

        def ask(t: Texts) -> Iterator[pa.RecordBatch]:
            keys, vals = keys_of(t)
            names = ["bucket", "keys", *vals_of]
            if t.to_save is not None:
                out = io.BytesIO()
                np.savez(out, **t.to_save)
                name = t.store.publish(f"{uuid.uuid4().hex}.npz", [out.tell().to_bytes(8, "little"), pa.compress(out.getbuffer(), "zstd", asbytes=True)])
                row = [pa.array([zlib.crc32(name.encode()) % (1 << shift)], pa.int32()), pa.array([None], pa.binary()), *[pa.array([name.encode() if not i else None], pa.binary()) for i in range(len(types))]]
                yield pa.RecordBatch.from_arrays(row, names)
            bucket = (keys >> np.uint64(64 - shift)).astype(np.int32)
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
            cuts = np.append(first, len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), *[_binaries(x, cuts) for x in (keys, *[v.astype(k) for v, k in zip(vals, types, strict=True)])]], names)

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns = ["batch", "step", "bucket", "n", "answer"]
            for g in sorted_groups(batches, ["bucket"]):
                names = g.filter(pc.is_null(g.column("keys")))
                if len(names):
                    same = [pa.array(np.full(len(names), x, np.int32)) for x in (step, -1, 0)]
                    yield pa.RecordBatch.from_arrays([names.column("batch").combine_chunks(), *same, names.column("v0").combine_chunks()], columns)
                    g = g.filter(pc.is_valid(g.column("keys")))
                    if not len(g):
                        continue
                raw, at = text_bytes(g.column("keys"))
                keys, cut = raw.view(np.uint64), at // 8
                vals = [text_bytes(g.column(c))[0].view(k) for c, k in zip(vals_of, types, strict=True)]
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                joined = join(first, [v[order] for v in vals])
                each = np.empty(len(keys), joined.dtype)
                each[order] = joined if len(joined) == len(keys) else np.repeat(joined, np.diff(np.append(first, len(keys))))
                n = np.diff(cut)
                if each.dtype == bool:
                    bits = np.zeros(int((-(-n // 8) * 8).sum()), bool)
                    bits[_padded(n)] = each
                    out = _binaries(np.packbits(bits), np.concatenate([[0], np.cumsum(-(-n // 8))]))
                else:
                    out = _binaries(each.astype(np.int64), cut)
                yield pa.RecordBatch.from_arrays([g.column("batch").combine_chunks(), pa.array(np.full(len(n), step, np.int32)), g.column("bucket").combine_chunks(), pa.array(n.astype(np.int32)), out], columns)
                del keys, vals, order, each, joined, out
                release()

        rows = self._over_batches(ask, True, "batch long, bucket int, keys binary, " + ", ".join(f"{v} binary" for v in vals_of), needs)
        rows = rows.repartition(min(MAX_TASKS, 1 << shift), "bucket").sortWithinPartitions("bucket")
        self.answers.append(stored(rows.mapInArrow(answer, ANSWERS), self.spark, f"answers-{step}"))
        del rows
        drop_shuffles(self.spark)

    def result(self, work: Callable[[Texts], pa.RecordBatch], schema: str, needs: tuple[int, ...] = ()) -> DataFrame:
        """What work makes of each batch, stored; all else that the steps wrote is deleted."""
        out = stored(self._over_batches(lambda t: iter([work(t)]), False, schema, needs), self.spark, "exchange-result")
        forget(self.spark, self.batches, *self.answers)
        remove(self.spark, self.folder)
        return out


def drop_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a finished step once the driver's garbage is collected, which else happens at no certain time."""
    gc.collect()
    spark._jvm.System.gc()


def answered(keys: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """The answer to each key, given those to the sorted distinct keys."""
    if not len(keys):
        return np.zeros(0, answers.dtype)
    order = np.argsort(keys)
    k = keys[order]
    out = np.empty(len(keys), answers.dtype)
    out[order] = answers[np.cumsum(np.concatenate([[False], k[1:] != k[:-1]]))]
    return out


def at_least(n: int) -> Callable[[np.ndarray, list[np.ndarray]], np.ndarray]:
    """join: whether the counts of a key come to n or more."""
    return lambda first, vals: np.add.reduceat(vals[0].astype(np.int64), first) >= n


def beaten(first: np.ndarray, vals: list[np.ndarray]) -> np.ndarray:
    """join: for each that asked, whether another's value of the key is smaller than its own."""
    return np.repeat(np.minimum.reduceat(vals[0], first), np.diff(np.append(first, len(vals[0])))) < vals[0]


def counted(keys: np.ndarray, most: int = 65535) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs (up to `most`)."""
    found, n = np.unique(keys, return_counts=True)
    return found, np.minimum(n, most)


def counted_once_a_document(keys: np.ndarray, docs: np.ndarray, most: int = 65535) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and in how many documents each occurs; docs ascend."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], docs[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new_pair = new_key | np.concatenate([[True], d[1:] != d[:-1]])
    first = np.flatnonzero(new_key)
    return k[first], np.minimum(np.add.reduceat(new_pair.astype(np.int64), first), most)
