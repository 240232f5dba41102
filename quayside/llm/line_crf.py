"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of character kinds, word statistics and repeats within the
document, of the line and of the lines before and after it; a 2x2 table scores neighbouring states. Forward-backward
gives each line's probability of being good, and the mean of these, weighted by line length, is the document's
quality. A document's label counts for all of its lines while learning.

Learning uses a bounded sample of the labelled documents: those with the least hash of doc_id among the documents at hand that may be learned
from, at most `max_docs` of them and at most `max_lines` lines in all (documented parameters), so what comes to the driver is at most max_lines rows of features. A learned text's lines all bear its label, so the table of neighbouring states learns how firmly
states hold together, not where they turn. Scoring reads every whole text.

Cases: null and empty texts are one empty line and get a score; a null doc_id is scored, is never learned from and never
held out; labels with a null quality or without a document are ignored, of several labels of one document the lowest
counts; of equal scores none comes first, for each row has its own verdict; a very long text is scored whole, with memory in proportion to its lines and words; with no label, or labels of one kind only, all scores are the share of good labels (0.5 without any); rows
repeat in the result as in the input; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import mix, slices, text_bytes, window_hashes, word_hashes, words
from ._shared import release

MAX_DOCS = 6000
#: Lines of the sample in all.
MAX_LINES = 200_000
SLICE = 1 << 18
THRESHOLD = 0.7
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "exclaim": b"!?", "pause": b",;:", "stop": b".",
    "symbol": b"#*$%&<>{}[]=~^_@+\\/", "bar": b"|",
}


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_TABLES = {k: _table(v) for k, v in CLASSES.items()}


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _seen(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands before, for each."""
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    return again


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, the bytes in each, and where each text's lines begin."""
    n_docs = len(at) - 1
    breaks = np.flatnonzero(data == 0x0A)
    line_at = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    doc = np.sort(np.concatenate([np.arange(n_docs), np.searchsorted(at, breaks, "right") - 1]), kind="stable")
    n = len(line_at)
    edge = np.append(line_at, at[-1])
    length = np.diff(edge)
    count = {}
    for k, t in _TABLES.items():
        c = np.zeros(len(data) + 1, np.int32)
        hit = t[data]
        if k == "upper":  # capitals of two bytes, from À to Þ
            hit[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        np.cumsum(hit, out=c[1:])
        count[k] = c[edge[1:]] - c[edge[:-1]]
    starts, ends, first = words(data, edge)
    codes = word_hashes(data, starts, ends)
    n_words = np.diff(first)
    line = np.repeat(np.arange(n), n_words)
    repeat = np.bincount(line[_seen(codes + mix(line.astype(np.uint64)))], minlength=n)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (line[1:] == line[:-1])
    adjacent = np.bincount(line[same], minlength=n)
    grams = window_hashes(codes, 5)
    gram_line = line[: len(grams)]
    whole = doc[gram_line] == doc[line[4:]] if len(grams) else np.zeros(0, bool)
    looped = np.bincount(gram_line[whole][_seen(grams[whole] + mix(doc[gram_line][whole].astype(np.uint64)))], minlength=n)
    lettered = np.bincount(line, weights=ends - starts, minlength=n)
    last = np.zeros(n, np.uint8)
    some = n_words > 0
    last[some] = data[ends[first[1:][some] - 1] - 1]
    letters = count["upper"] + count["lower"]
    base = np.stack([
        _share(count["upper"], letters), _share(count["symbol"], n_words), _share(count["exclaim"], n_words), _share(count["digit"], length), _share(count["bar"], n_words), _share(count["pause"], n_words),
        _share(count["stop"], n_words), _share(repeat, n_words), _share(adjacent, n_words), _share(looped, n_words), _share(lettered, n_words) / 10, np.log1p(n_words) / 5, _TABLES["stop"][last].astype(float), (n_words == 0).astype(float),
    ], axis=1).astype(np.float32)
    base = np.minimum(base, 3)
    steep = np.minimum(base[:, :10] * 8, 1)
    own = np.concatenate([base, steep], axis=1)
    before, after = np.zeros((n, 10), np.float32), np.zeros((n, 10), np.float32)
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    before[inner + 1], after[inner] = steep[inner], steep[inner + 1]
    return np.concatenate([own, before, after, np.ones((n, 1), np.float32)], axis=1), length, np.searchsorted(doc, np.arange(n_docs + 1))


@dataclass
class Model:
    """Weights of the state good against bad, the scores of neighbouring states (from, to), and the scale of a score."""

    weights: np.ndarray
    pairs: np.ndarray
    scale: tuple[float, float]
    prior: float | None = None


def forward_backward(odds: np.ndarray, cut: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's probability of being good, the expected state pairs of each chain, and its log normaliser. All chains
    go forward line by line together, the longest first."""
    n = np.diff(cut)
    order = np.argsort(-n, kind="stable")
    begin, size = cut[:-1][order], n[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    step = np.exp(pairs)
    total = len(odds)
    node = np.empty((total, 2))
    node[:, 1] = 1 / (1 + np.exp(-odds))
    node[:, 0] = 1 - node[:, 1]
    forward, backward, scale = np.empty((total, 2)), np.ones((total, 2)), np.ones(total)
    for t in range(longest):
        at = begin[: active[t]] + t
        x = node[at] if t == 0 else (forward[at - 1] @ step) * node[at]
        s = x.sum(1)
        forward[at], scale[at] = x / s[:, None], s
    for t in range(longest - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        backward[at] = ((backward[at + 1] * node[at + 1]) @ step.T) / scale[at + 1][:, None]
    good = forward[:, 1] * backward[:, 1]
    good /= good + forward[:, 0] * backward[:, 0]
    chain = np.repeat(np.arange(len(n)), n)
    inner = np.flatnonzero(chain[1:] == chain[:-1]) if total else np.zeros(0, np.int64)
    joint = forward[inner][:, :, None] * step[None] * (node[inner + 1] * backward[inner + 1])[:, None, :] / scale[inner + 1][:, None, None]
    expected = np.zeros((len(n), 2, 2))
    np.add.at(expected, chain[inner], joint)
    log_z = np.bincount(chain, np.log(scale) + np.logaddexp(0, odds), len(n))
    return good, expected, log_z


def quality(good: np.ndarray, length: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The mean over each text's lines, weighted by length; an empty line weighs as one byte."""
    w = np.maximum(length, 1).astype(float)
    chain = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    return np.bincount(chain, good * w, len(cut) - 1) / np.bincount(chain, w, len(cut) - 1)


def fit(x: np.ndarray, length: np.ndarray, cut: np.ndarray, label: np.ndarray, rounds: int = 300, penalty: float = 1e-3) -> Model:
    """Maximum likelihood by Adam. Documents weigh the same whatever their length."""
    if len(label) == 0 or label.min() == label.max():
        return Model(np.zeros(x.shape[1]), np.zeros((2, 2)), (1.0, 0.0), float(label.mean()) if len(label) else 0.5)
    n = np.diff(cut)
    chain = np.repeat(np.arange(len(n)), n)
    weight = 1.0 / n / len(n)
    x = x.astype(np.float64)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    want = np.zeros((len(n), 2, 2))
    want[np.arange(len(n)), label, label] = n - 1
    for k in range(1, rounds + 1):
        good, pairs, _ = forward_backward(x @ theta[:-4], cut, theta[-4:].reshape(2, 2))
        g = np.concatenate([x.T @ ((good - label[chain]) * weight[chain]), ((pairs - want) * weight[:, None, None]).sum(0).ravel()]) + penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    good, _, _ = forward_backward(x @ theta[:-4], cut, theta[-4:].reshape(2, 2))
    # The document's mean is put on the scale of a probability by a logistic curve over the same sample.
    q = quality(good, length, cut)
    z = np.log(np.clip(q, 1e-4, 1 - 1e-4) / np.clip(1 - q, 1e-4, 1))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * z + b)))
        h = p * (1 - p) + 1e-9
        grad = np.array([((p - label) * z).mean() + 1e-3 * (a - 1), (p - label).mean()])
        hess = np.array([[(h * z * z).mean() + 1e-3, (h * z).mean()], [(h * z).mean(), h.mean() + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    return Model(theta[:-4], theta[-4:].reshape(2, 2), (max(float(a), 0.05), float(b)))


def score_texts(model: Model, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The score of each text, each line's probability of being good, and where each text's lines begin."""
    x, length, cut = line_features(data, at)
    if model.prior is not None:
        return np.full(len(at) - 1, model.prior), np.full(len(length), model.prior), cut
    good, _, _ = forward_backward(x.astype(np.float64) @ model.weights, cut, model.pairs)
    q = quality(good, length, cut)
    z = np.log(np.clip(q, 1e-4, 1 - 1e-4) / np.clip(1 - q, 1e-4, 1))
    return 1 / (1 + np.exp(-(model.scale[0] * z + model.scale[1]))), good, cut


def held_out(doc_id) -> F.Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> Model:
    """Learn from at most max_docs labelled documents that aren't held out, in the order of a hash of their ids, as long as they have no more than max_lines lines in all;
    one that has more alone is passed over. Labels of documents that aren't there take no place. The ids, at most max_docs, come to the driver and are
    broadcast; the features of their lines come to the driver."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).dropna().filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).join(ids, "doc_id", "left_semi")
    drawn = [r.doc_id for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()]
    spark = docs.sparkSession
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    some = spark.createDataFrame([(d,) for d in drawn], "doc_id long")
    size = {r.doc_id: r.n for r in docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_lines.alias("n")).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
    within, room = [], max_lines
    for d in drawn:
        if size[d] <= room:
            within.append((d,))
            room -= size[d]
        elif size[d] <= max_lines:
            break
    sample = known.join(F.broadcast(spark.createDataFrame(within, "doc_id long")), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            data, at = text_bytes(b.column("text"))
            for i, j in slices(at, SLICE):
                x, length, cut = line_features(data[at[i] : at[j]], at[i : j + 1] - at[i])
                rows = [(x[p:q].tobytes(), length[p:q].astype(np.int64).tobytes()) for p, q in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("label").slice(i, j - i), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "label", "x", "length"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    got = texts.mapInArrow(features, "doc_id long, label int, x binary, length binary").toArrow().to_pydict()
    rows = sorted(zip(got["doc_id"], got["x"], got["length"], got["label"], strict=True))[:max_docs]
    width = line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(-1, width)
    length = np.frombuffer(b"".join(r[2] for r in rows), np.int64)
    cut = np.concatenate([[0], np.cumsum([len(r[2]) // 8 for r in rows])]).astype(np.int64)
    return fit(x, length, cut, np.array([min(1, max(0, r[3])) for r in rows], np.int64))


def score(docs: DataFrame, model: Model, with_lines: bool = False) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted and, if asked for, the probability of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            data, at = text_bytes(b.column("text"))
            parts = [score_texts(model, data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in slices(at, SLICE)]
            value = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0)
            cols = [b.column("doc_id"), b.column("held_out"), pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))]
            if with_lines:
                cols.append(pa.array([g[p:q].tolist() for _, g, cut in parts for p, q in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", "lines"][: len(cols)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + ", lines array<double>" * with_lines)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    return score(docs, learn(docs, labels, max_docs))


def good_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the classifier accepts, with all their columns and no shuffle: the verdict is computed beside the row. A model that no label was there
    for rejects nothing."""
    if model.prior == 0.5:
        return docs
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            data, at = text_bytes(b.column("text"))
            value = [score_texts(model, data[at[i] : at[j]], at[i : j + 1] - at[i])[0] for i, j in slices(at, SLICE)]
            yield b.filter(pa.array(np.concatenate(value) >= THRESHOLD)) if value else b
        release()

    return docs.select(*names).mapInArrow(keep, docs.schema)
