"""Nearest vectors for many queries through inverted lists around coarse centroids.

Centroids are learned on a bounded sample. Every vector goes to the list of its nearest centroid; a query looks at the `probe` nearest lists, and the exact cosine decides among what
they hold. How many lists that takes is measured: for a bounded sample of queries the exact neighbours are found by a scan of all vectors, and the probe is the least at which the wanted share of
them lies in the lists looked at. Lists are cut into blocks, and so are the queries of a list, so that a list of any size is spread over tasks.

Vectors that are null, of another length, not finite or of length zero have no neighbours and are none's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE = 8192
TRIED = 64
BLOCK = 2048
ASKED = 256
#: Rows that are held against all centroids at once, pairs of blocks that are scored at once, and vectors that wait for their blocks in a task.
STEP, PAIRS, HELD = 1024, 8, 1 << 16


def _sliced(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


def _unit(batch: pa.RecordBatch, column: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are vectors, and these at length 1."""
    v = batch.column(column)
    n = np.asarray(v.value_lengths().fill_null(0))
    ok = np.flatnonzero(n == dims)
    x = np.asarray(v.take(pa.array(ok)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, dims)
    size = np.sqrt((x * x).sum(1))
    fine = np.isfinite(size) & (size > 0)
    return ok[fine], x[fine] / size[fine, None]


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            own = x[near == j]
            if len(own):
                m = own.mean(0)
                c[j] = m / max(np.sqrt((m * m).sum()), 1e-12)
    return c


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> list[int]:
    """The places of the k best, the smaller id first among equals."""
    some = np.arange(len(ids))
    if len(ids) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, -k)[-k])  # all that are as good as the k-th
    return some[np.lexsort((ids[some], -score[some]))[:k]].tolist()


def nearest(spark: SparkSession, vectors: DataFrame, id_col: str, vector: str, queries: Column, allowed: Column | None = None, k: int = 10, dims: int = 64, recall: float = 0.97, lists: int | None = None) -> DataFrame:
    """query_id, pos from 1, the id and the score (cosine, six digits) of the k nearest vectors of each row that `queries` marks, itself left out. `allowed` is applied before anything is scored."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"), (F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))).alias("ok")).filter("id IS NOT NULL")
    schema = "query_id long, pos int, " + id_col + " long, score double"
    n = rows.count()
    drawn = pa.Table.from_batches(rows.filter("ok").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().to_batches()).combine_chunks()
    x = _unit(drawn.to_batches()[0], "v", dims)[1] if drawn.num_rows else np.zeros((0, dims))
    if not len(x):
        return spark.createDataFrame([], schema)
    c = centroids(x, lists or max(4, min(1024, int(n**0.5))))
    tried = rows.filter("asks").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(TRIED).select("id", "v").toArrow().combine_chunks()
    at, q = _unit(tried.to_batches()[0], "v", dims) if tried.num_rows else (np.zeros(0, np.int64), np.zeros((0, dims)))
    probe = _probe(rows, q, np.asarray(tried.column("id").combine_chunks())[at] if len(at) else np.zeros(0, np.int64), c, k, dims, recall)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, STEP):
            of, u = _unit(b, "v", dims)
            if not len(of):
                continue
            ids, asks, ok = (np.asarray(b.column(m).take(pa.array(of))) for m in ("id", "asks", "ok"))
            order = np.argsort(-(u @ c.T), axis=1, kind="stable")
            wants = np.repeat(np.flatnonzero(asks), min(probe, len(c)))
            held = np.flatnonzero(ok)
            where = np.concatenate([order[asks, :probe].ravel(), order[held, 0]])
            row = np.concatenate([wants, held])
            yield pa.RecordBatch.from_arrays(
                [pa.array(where.astype(np.int32)), pa.array(np.concatenate([np.ones(len(wants), bool), np.zeros(len(held), bool)])), pa.array(ids[row]), pa.array([r.tobytes() for r in u[row].astype(np.float32)], pa.binary())], ["list", "asks", "id", "u"],
            )

    placed = rows.mapInArrow(filed, "list int, asks boolean, id long, u binary")

    def blocks(side: DataFrame, most: int, name: str) -> DataFrame:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[int, bytes]]] = {}
            n = 0

            def out(j: int) -> pa.RecordBatch:
                g = held.pop(j)
                return pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([np.array([i for i, _ in g], np.int64).tobytes()], pa.binary()), pa.array([b"".join(u for _, u in g)], pa.binary())], ["list", f"{name}_ids", f"{name}_u"])

            for b in _sliced(batches, STEP):
                n += b.num_rows
                for j, i, u in zip(b.column("list").to_pylist(), b.column("id").to_pylist(), b.column("u").to_pylist(), strict=True):
                    held.setdefault(j, []).append((i, u))
                    if len(held[j]) >= most:
                        n -= len(held[j])
                        yield out(j)
                # However many lists a task has, few vectors wait: the largest lists go first, as smaller blocks.
                while n > HELD:
                    j = max(held, key=lambda j: len(held[j]))
                    n -= len(held[j])
                    yield out(j)
            for j in list(held):
                yield out(j)

        spread = F.pmod(F.xxhash64("id"), F.lit(16))
        return side.repartition("list", spread).mapInArrow(pack, f"list int, {name}_ids binary, {name}_u binary")

    met = blocks(placed.filter("asks"), ASKED, "q").join(blocks(placed.filter("NOT asks"), BLOCK, "h"), "list")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, PAIRS):
            out: list[tuple[int, int, float]] = []
            for qi, qu, hi, hu in zip(*(b.column(m).to_pylist() for m in ("q_ids", "q_u", "h_ids", "h_u")), strict=True):
                qid, hid = np.frombuffer(qi, np.int64), np.frombuffer(hi, np.int64)
                s = np.frombuffer(qu, np.float32).reshape(-1, dims).astype(np.float64) @ np.frombuffer(hu, np.float32).reshape(-1, dims).astype(np.float64).T
                s[qid[:, None] == hid[None]] = -np.inf
                for r, one in enumerate(qid.tolist()):
                    out += [(one, int(hid[p]), float(s[r, p])) for p in _best(hid, s[r], k) if s[r, p] > -np.inf]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "id", "s"])

    found = met.mapInArrow(score, "query_id long, id long, s double").withColumn("score", F.round("s", 6))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("pos", place).filter(F.col("pos") <= k).select("query_id", "pos", F.col("id").alias(id_col), "score")


def _probe(rows: DataFrame, q: np.ndarray, own: np.ndarray, c: np.ndarray, k: int, dims: int, recall: float) -> int:
    """The least number of lists in which the share `recall` of the exact neighbours of some queries lies; all lists where no query can tell."""
    if not len(q):
        return len(c)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, STEP):
            of, u = _unit(b, "v", dims)
            if not len(of):
                continue
            ids = np.asarray(b.column("id").take(pa.array(of)))
            s = q @ u.T
            s[own[:, None] == ids[None]] = -np.inf
            lists = (u @ c.T).argmax(1)
            out = [(r, int(ids[p]), float(s[r, p]), int(lists[p])) for r in range(len(q)) for p in _best(ids, s[r], k) if s[r, p] > -np.inf]
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int64(), pa.float64(), pa.int32()), strict=True)], ["q", "id", "s", "list"])

    place = F.row_number().over(W.partitionBy("q").orderBy(F.col("s").desc(), "id"))
    exact = rows.filter("ok").mapInArrow(scan, "q int, id long, s double, list int").withColumn("_n", place).filter(F.col("_n") <= k).collect()
    rank = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1, kind="stable")
    need = np.sort([rank[r.q, r.list] + 1 for r in exact])
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) if len(need) else len(c)
