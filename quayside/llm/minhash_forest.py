"""N-gram Jaccard join with a MinHash LSH forest.

Texts with the same words are one class. A class's set of word n-grams gives a signature of trees x depth least hashes, and
each tree is a prefix trie of its part of the signatures: classes that share a prefix lie in one branch. Branches are found by grouping on the prefix, which
gives the runs that sorting the signatures would give, without a total order. The
matched prefixes start at the full depth. They are shortened until pairs at the threshold have the target recall by calculation, and then until the recall that is measured reaches
it: a bounded sample of texts is joined with all others exactly, by n-grams, and the pairs found so are looked up in the tries. A pair is judged in the first tree only in which its classes share a
branch, and its Jaccard similarity is computed from the texts.

Large branches are dealt into blocks, and every pair of blocks is a task of its own; only sums per class and a spanning set of links leave it,
so a branch that holds a third of the corpus neither meets in one task nor writes out its pairs. Groups are
the connected components of the links, found by alternating large-star and small-star rounds.

A very long text is read whole by the task that has it, with memory in proportion to its words.

Cases: words are split at ASCII white space and taken unchanged; a text of fewer words than n is one n-gram; null and empty texts have no n-gram and no
link, each is its own group; rows with a null doc_id take part, and ids in the result are the least non-null ones of a
group or class (null if there are none); equal rows are copies of each other; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import mix, slices, text_bytes, window_hashes, word_hashes, words
from ._shared import forget, release, stored, whole_groups

N = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 5
RECALL = 0.999
BLOCK = 512
SLICE = 1 << 18
SALTS = 8
#: The sample that the recall is measured with: texts, bytes of a text, and n-grams in all.
SAMPLE, SAMPLE_BYTES, SAMPLE_GRAMS = 256, 1 << 16, 1 << 18
#: Pairs whose signatures agree in less than the threshold minus this are not verified: over five standard deviations. Pairs lost so count as lost in the measured
#: recall.
MARGIN = 0.25
_random = np.random.Generator(np.random.PCG64(11))
_FACTORS = _random.integers(1, 1 << 63, TREES * DEPTH * 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _random.integers(0, 1 << 63, TREES * DEPTH * 4, dtype=np.uint64)


def shingles(data: np.ndarray, at: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word n-grams, where each text's begin, the hashes of all words, and where each text's begin."""
    starts, ends, first = words(data, at)
    codes = word_hashes(data, starts, ends)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    grams = window_hashes(codes, n)
    whole = np.flatnonzero(doc[: len(grams)] == doc[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
    own = grams[whole]
    per = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    cut = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(cut[-1], np.uint64)
    short = np.flatnonzero((count > 0) & (count < n))
    is_long = np.ones(len(out), bool)
    is_long[cut[short]] = False
    out[is_long] = own
    for k in short.tolist():
        x = np.uint64(count[k])
        for c in codes[first[k] : first[k + 1]]:
            x = mix(np.array([x ^ c]))[0]
        out[cut[k]] = x
    return out, cut, codes, first


def signatures(grams: np.ndarray, cut: np.ndarray, size: int) -> np.ndarray:
    """One row of 32-bit values for each text that has an n-gram."""
    begins = cut[:-1][np.diff(cut) > 0]
    out = np.empty((len(begins), size), np.uint32)
    if len(begins):
        for k in range(size):
            out[:, k] = np.minimum.reduceat((grams ^ _MASKS[k]) * _FACTORS[k], begins) >> np.uint64(32)
    return out


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def signed(spark: SparkSession, docs: DataFrame, n: int, trees: int, depth: int) -> DataFrame:
    """Per row: doc_id, row_key, two hashes of the word sequence and the signature (null without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            data, at = text_bytes(b.column("text"))
            for i, j in slices(at, SLICE):
                grams, cut, codes, first = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], n)
                has = np.diff(cut) > 0
                raw = signatures(grams, cut, trees * depth).astype("<u4").tobytes()
                rows = np.cumsum(has) - 1
                width = 4 * trees * depth
                place = np.arange(len(codes), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
                order = mix(place + np.uint64(1))
                both = []
                for salt in (0x1234567, 0x89ABCDE):
                    s = np.zeros(len(has), np.uint64)
                    s[has] = np.add.reduceat(mix(codes * order + np.uint64(salt)), first[:-1][has]) if has.any() else 0
                    both.append(pa.array(s.view(np.int64)))
                sig = pa.array([raw[r * width : (r + 1) * width] if h else None for r, h in zip(rows.tolist(), has.tolist(), strict=True)], pa.binary())
                del raw
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("row_key").slice(i, j - i), *both, sig], ["doc_id", "row_key", "h1", "h2", "sig"])
            release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    return stored(rows.mapInArrow(sign, "doc_id long, row_key long, h1 long, h2 long, sig binary"), spark, "signatures")


def recall_at(similarity: float, trees: int, depth: int) -> float:
    return 1 - (1 - similarity**depth) ** trees


def sampled(spark: SparkSession, docs: DataFrame, nodes: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of classes drawn by a hash: their nodes and how many n-grams each has; all distinct n-grams, sorted by value, and the class of each."""
    drawn = nodes.select("node", "row_key").orderBy(F.xxhash64("node", F.lit(5)), "node").limit(4 * SAMPLE)
    texts = docs.select(row_key().alias("row_key"), "text").filter(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(drawn), "row_key").groupBy("node").agg(F.first("text").alias("text"))
    rows = sorted((r.node, r.text) for r in texts.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(SAMPLE).collect())
    data, at = text_bytes(pa.array([t for _, t in rows], pa.string()))
    every, cut, _, _ = shingles(data, at, n)
    grams = [np.unique(every[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    fits = int(np.searchsorted(np.cumsum([len(g) for g in grams]), SAMPLE_GRAMS, "right"))
    size = np.array([len(g) for g in grams[:fits]], np.int64)
    flat, of = (np.concatenate(grams[:fits]), np.repeat(np.arange(fits), size)) if fits else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(flat, kind="stable")
    return np.array([r[0] for r in rows[:fits]], np.int64), size, flat[order], of[order]


def measured(spark: SparkSession, docs: DataFrame, nodes: DataFrame, n: int, threshold: float, trees: int, full: int, agree: float) -> list[float] | None:
    """The share of a sample's exact pairs that tries of depth 1, 2, ... full find; None if the sample has no pairs. The sample, of a proven size, goes to every task with its code."""
    own, size, flat, of = sampled(spark, docs, nodes, n)
    if not len(flat):
        return None
    distinct, begin = np.unique(flat, return_index=True)
    count = np.diff(np.append(begin, len(flat)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.asarray(b.column("row_key"))
            data, at = text_bytes(b.column("text"))
            out: list[tuple[int, int]] = []
            for i, j in slices(at, SLICE):
                every, cut, _, _ = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], n)
                where = np.searchsorted(distinct, every)
                hit = np.zeros(len(every), bool)
                inside = where < len(distinct)
                hit[inside] = distinct[where[inside]] == every[inside]
                doc = np.repeat(np.arange(j - i), np.diff(cut))
                for d in np.unique(doc[hit]).tolist():
                    g = np.unique(where[cut[d] : cut[d + 1]][hit[cut[d] : cut[d + 1]]])
                    m = count[g]
                    shared = np.bincount(of[np.repeat(begin[g] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))], minlength=len(size))
                    total = len(np.unique(every[cut[d] : cut[d + 1]]))
                    out += [(int(own[k]), int(keys[i + d])) for k in np.flatnonzero(shared >= threshold * (size + total - shared)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in out], pa.int64()), pa.array([k for _, k in out], pa.int64())], ["own", "row_key"])
            release()

    pairs = docs.select(row_key().alias("row_key"), "text").filter("text IS NOT NULL").mapInArrow(scan, "own long, row_key long")
    pairs = pairs.join(nodes.select("row_key", "node", "sig"), "row_key").filter("node != own")
    pairs = pairs.join(nodes.select(F.col("node").alias("own"), F.col("sig").alias("own_sig")), "own")
    at = lambda c, t, d: F.substring(F.col(c), t * (4 * full) + 1 + 4 * d, F.lit(4))
    alike = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.transform(F.sequence(F.lit(0), F.lit(full - 1)), lambda d: (at("sig", t, d) == at("own_sig", t, d)).cast("int"))))
    first = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.aggregate(F.slice("alike", t * full + 1, full), F.struct(F.lit(0).alias("n"), F.lit(1).alias("on")), lambda s, x: F.struct((s["n"] + s["on"] * x).alias("n"), (s["on"] * x).alias("on")), lambda s: s["n"]))
    reach = pairs.withColumn("alike", alike).select(F.when(F.aggregate("alike", F.lit(0), lambda s, x: s + x) >= agree * trees * full, F.array_max(first)).otherwise(0).alias("reach"))
    n_of = {r.reach: r["count"] for r in reach.groupBy("reach").count().collect()}
    every = sum(n_of.values())
    return [sum(c for k, c in n_of.items() if k >= d) / every for d in range(1, full + 1)] if every else None


def branches(nodes: DataFrame, trees: int, depth: int, full: int) -> DataFrame:
    """Nodes in branches of two and more: branch, tree, the blocks a <= b of the task, own (the node's block), node."""
    prefix = lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.substring(F.col("sig"), t * (4 * full) + 1, F.lit(4 * depth))).alias("branch"))
    each = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), prefix)).alias("at")).select("node", "at.*")
    sizes = each.groupBy("branch").agg(F.count("*").alias("n")).filter("n > 1")
    found = each.join(sizes, "branch").withColumn("m", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    found = found.select("branch", "tree", "node", "own", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"))
    return found.select("branch", "tree", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node")


TASK = ["branch", "a", "b"]


def by_task(rows: DataFrame) -> DataFrame:
    """Rows of a task together. The number of partitions is stated, since the work goes with pairs and not with bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *TASK).sortWithinPartitions(*TASK)


def judged(sig: np.ndarray, own: np.ndarray, tree: int, a: int, b: int, depth: int, agree: float) -> np.ndarray:
    """Pairs of rows that a task judges, one pair a row: of its two blocks, alike by signature, and in one branch in no earlier
    tree. sig: rows x trees x full depth."""
    n, trees, full = sig.shape
    left, right = (np.arange(n), np.arange(n)) if a == b else (np.flatnonzero(own == a), np.flatnonzero(own == b))
    out = []
    for k in range(0, len(left), 256):
        rows = left[k : k + 256]
        same = np.zeros((len(rows), len(right)), np.int16)
        keep = rows[:, None] < right[None, :] if a == b else np.ones((len(rows), len(right)), bool)
        for t in range(trees):
            hit = np.ones((len(rows), len(right)), bool)
            for d in range(full):
                eq = sig[rows, t, d][:, None] == sig[right, t, d][None, :]
                same += eq
                if d < depth and t < tree:
                    hit &= eq
            if t < tree:
                keep &= ~hit
        keep &= same >= agree * trees * full
        p, q = np.nonzero(keep)
        out.append(np.stack([rows[p], right[q]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def common(grams: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """How many n-grams each pair shares; grams: distinct and sorted."""
    if len(pairs) <= 4 * len(grams):
        return np.array([len(np.intersect1d(grams[i], grams[j], assume_unique=True)) for i, j in pairs.tolist()], np.int64)
    row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    every, place, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = times[place] > 1
    column = np.cumsum(times > 1) - 1
    total = np.zeros(len(pairs), np.int64)
    for low in range(0, int((times > 1).sum()), 1 << 14):
        some = shared & (column[place] >= low) & (column[place] < low + (1 << 14))
        bits = np.zeros((len(grams), 1 << 14), bool)
        bits[row[some], column[place[some]] - low] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for k in range(0, len(pairs), 4096):
            i, j = pairs[k : k + 4096].T
            total[k : k + 4096] += np.bitwise_count(packed[i] & packed[j]).sum(1, dtype=np.int64)
    return total


def wanted(tasks: DataFrame, nodes: DataFrame, trees: int, depth: int, full: int, agree: float) -> DataFrame:
    """The rows of a task that are in a pair to be judged: without those, no text needs to be fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_groups(batches, TASK):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(-1, trees, full)
            cols = {c: t.column(c).to_numpy() for c in ("tree", "a", "b", "own")}
            keep = np.zeros(len(sig), bool)
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                found = judged(sig[i:j], cols["own"][i:j], int(cols["tree"][i]), int(cols["a"][i]), int(cols["b"][i]), depth, agree)
                keep[i + np.unique(found)] = True
            yield from t.select(["branch", "tree", "a", "b", "own", "node"]).filter(pa.array(keep)).to_batches()
            release()

    rows = tasks.join(nodes.select("node", "sig"), "node").select("branch", "tree", "a", "b", "own", "node", "sig")
    return by_task(rows).mapInArrow(run, "branch long, tree int, a int, b int, own int, node long")


def verified(rows: DataFrame, n: int, threshold: float, trees: int, depth: int, full: int, agree: float) -> DataFrame:
    """rows: tasks with sig, copies and text. Per task and class with a link: node, root (of a set that the task's links
    connect), links (copies of the classes linked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_groups(batches, TASK):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(-1, trees, full)
            cols = {c: t.column(c).to_numpy() for c in ("tree", "a", "b", "own", "node", "copies")}
            out: list[list[np.ndarray]] = []
            texts = t.column("text")
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                pairs = judged(sig[i:j], cols["own"][i:j], int(cols["tree"][i]), int(cols["a"][i]), int(cols["b"][i]), depth, agree)
                if not len(pairs):
                    continue
                data, at = text_bytes(texts.slice(i, j - i))
                every, cut, _, _ = shingles(data, at, n)
                grams = [np.unique(every[p:q]) for p, q in zip(cut[:-1], cut[1:], strict=True)]
                size = np.array([len(g) for g in grams])
                both = common(grams, pairs)
                score = both / (size[pairs[:, 0]] + size[pairs[:, 1]] - both)
                linked = score >= threshold
                pairs = pairs[linked]
                if not len(pairs):
                    continue
                root = connect(j - i, pairs)
                weight, node = cols["copies"][i:j], cols["node"][i:j]
                x, y = pairs.T
                links = np.bincount(x, weight[y], j - i) + np.bincount(y, weight[x], j - i)
                has = np.flatnonzero(links > 0)
                out.append([node[has], node[root[has]], links[has].astype(np.int64)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "root", "links"])
            release()

    return by_task(rows).mapInArrow(run, "node long, root long, links long")


def connect(n: int, pairs: np.ndarray) -> np.ndarray:
    """The first row of each row's connected set."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(low, pairs[:, 1], root[pairs[:, 0]])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def with_least(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges with the m of their node. A node may have very many edges: its m stands once for each salt."""
    salted = low.select("node", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return edges.withColumn("_salt", F.pmod(F.xxhash64("root"), F.lit(SALTS)).cast("int")).join(salted, ["node", "_salt"])


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges: node, root. Per node that has an edge: node, label, the least node of its component. Each round joins every larger neighbour of a
    node to its least neighbour, then every smaller one; rounds end when the edges stay the same."""
    edges = stored(edges.select("node", "root").filter("node != root").distinct(), spark, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("m", "node").alias("m"))
        large = with_least(both.filter("root > node"), low).select(F.col("root").alias("node"), F.col("m").alias("root"))
        large = stored(large.filter("node != root").distinct(), spark, "large-star")
        down = large.select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root"))
        low = down.groupBy("node").agg(F.min("root").alias("m"))
        small = with_least(down, low).select(F.col("root").alias("node"), F.col("m").alias("root")).unionByName(low.select("node", F.col("m").alias("root")))
        done, edges = edges, stored(small.filter("node != root").distinct(), spark, "small-star")
        forget(spark, done, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select("node", F.col("root").alias("label")).unionByName(edges.select(F.col("root").alias("node"), F.col("root").alias("label"))).distinct()
        before = now


def jaccard_join(spark: SparkSession, docs: DataFrame, n: int = N, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """Per row: doc_id, row_key, class_id (least doc_id of the group of near copies), copy_of (least doc_id of the
    texts with the same words), n_copies, n_links (other rows with a similarity of `threshold` or more, copies included), and label, a
    number of the group (null for a row without words)."""
    full = depth
    rows = signed(spark, docs, n, trees, full)
    classes = rows.filter("sig is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n_copies"), F.min("row_key").alias("row_key"), F.first("sig").alias("sig"))
    nodes = stored(classes.withColumn("node", F.xxhash64("h1", "h2")), spark, "nodes")
    while recall_at(threshold, trees, depth) < recall and depth > 1:
        depth -= 1
    agree = max(0.0, threshold - MARGIN)
    shares = measured(spark, docs, nodes, n, threshold, trees, full, agree) if depth > 1 else None
    while shares and depth > 1 and shares[depth - 1] < recall:
        depth -= 1
    need = stored(wanted(branches(nodes, trees, depth, full), nodes, trees, depth, full, agree), spark, "wanted")
    keyed = nodes.select("node", "row_key", "n_copies", "sig").join(need.select("node").distinct(), "node")
    texts = docs.select(row_key().alias("row_key"), "text").join(keyed.select("row_key").distinct(), "row_key", "left_semi")
    texts = texts.groupBy("row_key").agg(F.first("text").alias("text"))
    fetched = keyed.join(texts, "row_key").select("node", F.col("n_copies").alias("copies"), "sig", "text")
    found = stored(verified(need.join(fetched, "node"), n, threshold, trees, depth, full, agree), spark, "links")
    forget(spark, need)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(spark, found)
    known = nodes.filter("n_copies > 1").select("node").unionByName(links.select("node")).distinct()
    about = nodes.select("h1", "h2", "node", "copy_of", "n_copies").join(known, "node").join(links, "node", "left").join(labels, "node", "left")
    about = stored(about.withColumn("label", F.coalesce("label", "node")), spark, "classes")
    forget(spark, nodes, found)
    least = about.groupBy("label").agg(F.min("copy_of").alias("class_id"))
    about = about.join(least, "label")
    # A class may hold a third of all rows: each stands once for each salt.
    salted = about.select("h1", "h2", "class_id", "copy_of", "n_copies", "links", "label", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    each = rows.drop("sig").withColumn("_salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int"))
    joined = each.join(salted, ["h1", "h2", "_salt"], "left")
    has_words = ~((F.col("h1") == 0) & (F.col("h2") == 0))
    known = F.col("label").isNotNull()
    return joined.select(
        "doc_id", "row_key", F.when(known, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(known, F.col("copy_of")).otherwise(F.col("doc_id")).alias("copy_of"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), (F.coalesce("n_copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.when(known, F.col("label")).when(has_words, F.xxhash64("h1", "h2")).alias("label"),
    )


def one_of_each_group(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with all their columns, without those whose group holds a row of a smaller doc_id (null last), and
    one only of equal rows."""
    found = jaccard_join(spark, docs)
    grouped = found.filter("n_links > 0").select("row_key", "label", "doc_id")
    first = grouped.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row_key")).alias("f")).select("label", F.col("f.row_key").alias("first"))
    lost = stored(grouped.join(first, "label").filter("row_key != first").select(F.col("row_key").alias("_lost")).distinct(), spark, "lost")
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("_doc"), row_key().alias("_row_key"))
    kept = rows.join(lost, F.col("_row_key") == F.col("_lost"), "left_anti")
    twins = grouped.join(first, F.col("row_key") == F.col("first")).groupBy("row_key").count().filter("count > 1")
    if not twins.isEmpty():
        nth = F.row_number().over(Window.partitionBy("_row_key").orderBy(F.lit(0)))
        pairs = twins.select(F.col("row_key").alias("_twin"))
        apart = kept.join(pairs, F.col("_row_key") == F.col("_twin"), "left")
        kept = apart.withColumn("_nth", F.when(F.col("_twin").isNotNull(), nth).otherwise(1)).filter("_nth = 1")
    return kept.select(*[F.col("_doc").getField(c).alias(c) for c in names])
