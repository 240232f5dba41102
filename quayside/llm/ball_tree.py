"""Centroid clustering by ball-tree filtering, in exact integers.

Every task builds metric trees of up to TREE vectors, once, and writes them to the shared folder. A ball holds its count, its
integer sum and the radius around its mean. In a round all balls of a level are compared with the centroids at once: a centroid that the
triangle inequality shows to be farther from every point of the ball than another one is dropped; a ball with one centroid left
gives its count and sum to that centroid whole, else its children are looked at, and in leaves each vector's exact squared distances
decide. Spark adds the counts and sums of all tasks, so that the driver sees one row for each centroid.

Cases: a vector that is null, has another number of components than `dims`, or a null or non-finite component is left out; so is one
with a component beyond +-LIMIT / SCALE, whose squared distances may not fit in 64 bits. A null vec_id is kept, its seed hash being that of `3:`; equal rows
count each; the seeds are ordered by hash, then by the vector. Fewer vectors than `k` make as many centroids; an empty
table gives no rows. Many equal vectors are one ball of radius 0. Ties in distance go to the smaller number. Columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import forget, release, stored

SCALE = 1024
#: Integers up to this size, so that 64 squared differences fit in 64 bits.
LIMIT = 1 << 27
TREE = 8192
LEAF = 32
#: What floating point may be off by in a distance, as a share of the components; balls nearer to a decision than that are opened.
SLACK = 1e-9


def integers(embedding: Column) -> Column:
    """floor(1024 * x) of each component, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def kept_vectors(embeddings: DataFrame, dims: int) -> DataFrame:
    """vec_id and its integers x, of the vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LIMIT // SCALE))  # NaN counts as larger than any number
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).filter(F.coalesce(fine, F.lit(False)))
    return rows.select("vec_id", integers(F.col("embedding")).alias("x"))


def seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()], np.int64)


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the vectors, and the balls: each covers the places first to last of it; children stand side by side, 0 for none."""
    order, xf = np.arange(len(x)), x.astype(np.float64)
    first, last, child, total, radius = [0], [len(x)], [0], [], []
    k = 0
    while k < len(first):
        a, b = first[k], last[k]
        v = xf[order[a:b]]
        s = x[order[a:b]].sum(0)
        total.append(s)
        away = ((v - s / (b - a)) ** 2).sum(1)
        radius.append(float(np.sqrt(away.max())))
        if b - a > leaf and (v != v[0]).any():
            one = v[away.argmax()]
            other = v[((v - one) ** 2).sum(1).argmax()]
            along = v @ (other - one)
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(along, half)]
            child[k] = len(first)
            first += [a, a + half]
            last += [a + half, b]
            child += [0, 0]
        k += 1
    return order, {"first": np.array(first, np.int32), "last": np.array(last, np.int32), "child": np.array(child, np.int32), "radius": np.array(radius), "total": np.array(total, np.int64).reshape(-1, x.shape[1])}


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors (rows) to centroids (columns)."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # every sum below is an integer that a double holds
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)[None]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def filtered(x: np.ndarray, balls: dict[str, np.ndarray], c: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], int]:
    """Counts and sums by centroid, the assignments as (places, centroids), and how many vectors were compared one by one. x is in the order of the tree."""
    k = len(c)
    counts, sums = np.zeros(k, np.int64), np.zeros((k, x.shape[1]), np.int64)
    size = balls["last"] - balls["first"]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at, open_for, compared = np.zeros(1, np.int64), np.ones((1, k), bool), 0
    cf = c.astype(np.float64)
    while len(at):
        mean = balls["total"][at] / size[at, None]
        d = np.sqrt(((mean[:, None] - cf[None]) ** 2).sum(2))
        slack = SLACK * (np.abs(mean).max(1) + np.abs(cf).max() + 1)[:, None]
        r = balls["radius"][at][:, None]
        best = np.where(open_for, d + r + slack, np.inf).min(1, keepdims=True)
        open_for = open_for & (d - r - slack <= best)
        one = open_for.sum(1) == 1
        to = open_for.argmax(1)
        np.add.at(counts, to[one], size[at[one]])
        np.add.at(sums, to[one], balls["total"][at[one]])
        found += [(np.arange(balls["first"][n], balls["last"][n]), np.full(size[n], j)) for n, j in zip(at[one].tolist(), to[one].tolist(), strict=True)]
        rest = ~one
        leaf = rest & (balls["child"][at] == 0)
        if leaf.any():
            places = np.concatenate([np.arange(balls["first"][n], balls["last"][n]) for n in at[leaf].tolist()])
            allowed = np.repeat(open_for[leaf], size[at[leaf]], axis=0)
            near = np.where(allowed, squared(x[places], c), np.iinfo(np.int64).max).argmin(1)
            np.add.at(counts, near, 1)
            np.add.at(sums, near, x[places])
            found.append((places, near))
            compared += len(places)
        inner = rest & ~leaf
        left = balls["child"][at[inner]]
        at = np.stack([left, left + 1], 1).ravel().astype(np.int64)
        open_for = np.repeat(open_for[inner], 2, axis=0)
    return counts, sums, found, compared


PARTS = ("first", "last", "child", "radius", "total")
TREES = "ids binary, nulls binary, x binary, " + ", ".join(f"{p} binary" for p in PARTS)


def write_trees(spark: SparkSession, vectors: DataFrame, dims: int, tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """A stored row for each tree of up to `tree` vectors of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(rows: pa.Table) -> pa.RecordBatch:
            ids = rows.column("vec_id").combine_chunks()
            x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, dims)
            order, balls = build(x, leaf)
            out = [ids.fill_null(0).to_numpy()[order], np.asarray(ids.is_null())[order], x[order].astype(np.int32), *[balls[p] for p in PARTS]]
            return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in out], ["ids", "nulls", "x", *PARTS])

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= tree:
                t = pa.Table.from_batches(held)
                full = t.num_rows - t.num_rows % tree
                for i in range(0, full, tree):
                    yield made(t.slice(i, tree))
                held = t.slice(full).combine_chunks().to_batches()
        if sum(h.num_rows for h in held):
            yield made(pa.Table.from_batches(held))
        release()

    return stored(vectors.mapInArrow(run, TREES), spark, "ball-trees")


def _trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray, dict[str, np.ndarray]]]:
    kinds = {"first": np.int32, "last": np.int32, "child": np.int32, "radius": np.float64, "total": np.int64}
    for b in batches:
        for row in range(b.num_rows):
            raw = {n: b.column(n)[row].as_buffer() for n in b.schema.names}
            balls = {p: np.frombuffer(raw[p], k) for p, k in kinds.items()}
            balls["total"] = balls["total"].reshape(-1, dims)
            x = np.frombuffer(raw["x"], np.int32).reshape(-1, dims).astype(np.int64)
            yield pa.array(np.frombuffer(raw["ids"], np.int64), mask=np.frombuffer(raw["nulls"], bool)), x, balls


def round_sums(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and sum of the vectors nearest to each centroid that has any."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, x, balls in _trees(batches, dims):
            n, s, _, _ = filtered(x, balls, centroids)
            counts += n
            sums += s
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    # The sums of components are decimals: 64 bits may not hold them.
    part = trees.mapInArrow(run, "cluster int, n long, s array<long>")
    total = part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims)])
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(dims)]) for r in total.collect()}


def cluster(spark: SparkSession, embeddings: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    vectors = kept_vectors(embeddings, dims)
    c = seeds(vectors, k, seed)
    if not len(c):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = write_trees(spark, vectors, dims, tree, leaf)
    for _ in range(rounds):
        for j, (n, s) in round_sums(trees, c).items():
            c[j] = [v // n for v in s]
    last = c.copy()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, balls in _trees(batches, dims):
            to = np.zeros(len(x), np.int32)
            for places, j in filtered(x, balls, last)[2]:
                to[places] = j
            away = np.empty(len(x), np.int64)
            for j in np.unique(to).tolist():
                of = to == j
                away[of] = squared(x[of], last[j : j + 1])[:, 0]
            yield pa.RecordBatch.from_arrays([ids, pa.array(to), pa.array(away)], ["vec_id", "cluster", "distance"])

    found = stored(trees.mapInArrow(assign, "vec_id long, cluster int, distance long"), spark, "assigned")
    forget(spark, trees)
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    # One row for each centroid: k of them.
    facts = spark.createDataFrame([(j, int(sums.get(j, 0)), int(sum(sums.values())), hashlib.sha256(",".join(map(str, last[j].tolist())).encode()).hexdigest()) for j in range(len(last))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
