"""Session-level helpers of the llm operators: tables, shared folders and grouping of sorted rows."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Caches of this Python worker that only one operator uses: each has clear().
caches: list = []


def release(drop_caches: bool = True, keep: tuple = ()) -> None:
    """Give memory that large arrays held back to the system: Python workers live on between tasks, also those of other
    operators, whose caches go too; keep: the caller's own."""
    if drop_caches:
        for c in caches:
            if not any(c is k for k in keep):
                c.clear()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):
    _libc = None


#: Bytes of an Arrow batch between Spark and a Python worker in the pipeline.
ARROW_BYTES = 4 << 20
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """From here on tasks of this session get rows in Arrow batches of ARROW_BYTES, or one row, where the session sets no limit of its own: executor and worker
    each hold one batch and the buffers that it grew in. All rows come, in more batches."""
    if spark.conf.get(_ARROW_LIMIT, None) is None:
        spark.conf.set(_ARROW_LIMIT, str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors see.

    Only where the setting is absent and the master is local (tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="quayside-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and base.startswith("/"):
        base = f"file://{base}" if spark.sparkContext.master.startswith("local") else base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(name: str, taken: list[str]) -> str:
    """A column name that none of the others equals, whatever their case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """checkpoint() needs a folder; the cluster's own setting wins."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))


def stored(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """df, written to a shared folder and read again: the lineage ends there and lost executors cost nothing."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


_paths: dict[int, tuple[DataFrame, str]] = {}


def forget(spark: SparkSession, *dfs: DataFrame) -> None:
    """Delete what stored() wrote for these, once all that was made of it is stored itself."""
    for df in dfs:
        _, path = _paths.pop(id(df), (None, None))
        if path:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a shared folder, whatever file system it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(files: DataFrame) -> DataFrame:
    """A stored list of files, about one to a task: its rows are small and would else be put into one."""
    return files.repartition(max(1, files.count()))


class Store:
    """Byte files in a shared folder, for tasks: local paths directly, other file systems through pyarrow."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.local = folder[7:] if folder.startswith("file://") else folder if folder.startswith("/") else None
        if self.local is None:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(folder)

    def publish(self, name: str, parts: list[bytes]) -> str:
        """Write under a name of this attempt, then rename: a retried or duplicated task can't leave half a file."""
        tmp = f".{name}.{uuid.uuid4().hex}"
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            with open(f"{self.local}/{tmp}", "wb") as f:
                f.writelines(parts)
            os.replace(f"{self.local}/{tmp}", f"{self.local}/{name}")
        else:
            self.fs.create_dir(self.root, recursive=True)
            with self.fs.open_output_stream(f"{self.root}/{tmp}") as f:
                for p in parts:
                    f.write(p)
            self.fs.move(f"{self.root}/{tmp}", f"{self.root}/{name}")
        return name

    def writer(self, name: str) -> Writer:
        """A file to be written piece by piece; it gets its name when it is done."""
        return Writer(self, name)

    def open(self, name: str):
        """A seekable reader."""
        return open(f"{self.local}/{name}", "rb") if self.local is not None else self.fs.open_input_file(f"{self.root}/{name}")

    def size(self, name: str) -> int:
        return os.path.getsize(f"{self.local}/{name}") if self.local is not None else self.fs.get_file_info(f"{self.root}/{name}").size


class Writer:
    """Writes under a name of this attempt; done() renames it."""

    def __init__(self, store: Store, name: str) -> None:
        self.store, self.name, self.tmp = store, name, f".{name}.{uuid.uuid4().hex}"
        if store.local is not None:
            os.makedirs(store.local, exist_ok=True)
            self.file = open(f"{store.local}/{self.tmp}", "wb")  # noqa: SIM115
        else:
            store.fs.create_dir(store.root, recursive=True)
            self.file = store.fs.open_output_stream(f"{store.root}/{self.tmp}")
        self.write = self.file.write

    def done(self) -> str:
        self.file.close()
        if self.store.local is not None:
            os.replace(f"{self.store.local}/{self.tmp}", f"{self.store.local}/{self.name}")
        else:
            self.store.fs.move(f"{self.store.root}/{self.tmp}", f"{self.store.root}/{self.name}")
        return self.name


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows that come sorted by keys, in tables of whole groups, and where the groups begin and end in each.

    Groups are cut out of whole Arrow batches; only the last group of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if len(held) > 1 and all(batch.column(k)[-1] == held[0].column(k)[0] for k in keys):  # still the same group
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        cuts = _cuts(t, keys)
        if len(cuts) > 2:
            yield t.slice(0, cuts[-2]), cuts[:-1]
        held = t.slice(cuts[-2]).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, _cuts(t, keys)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows with equal keys, from rows that come sorted by them."""
    for t, cuts in whole_groups(batches, keys):
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield t.slice(a, b - a)


def _cuts(t: pa.Table, keys: list[str]) -> list[int]:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        c = t.column(k).combine_chunks().to_numpy(zero_copy_only=False)
        new[1:] |= c[1:] != c[:-1]
    return [*np.flatnonzero(new).tolist(), t.num_rows]
