"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised by lower-casing A-Z and turning every other ASCII character that is no digit or
letter into a gap; words are what stands between gaps. The automaton holds every window of
`width` consecutive words of every benchmark item (a shorter item is one window) and reads each
normalised document once. Places map back to the original text through the word starts.

Cases: null and empty texts have no words and are never contaminated; an item without words or without
an id is no item; equal item rows count once; an empty benchmark leaves every document clean;
one row comes out per document row, repeated doc_ids included; other columns are ignored.
of a very long text the words' places are held at once. A worker builds an automaton once. Its size is some hundred times that of the benchmark, so a
benchmark of more than `automaton_bytes` is read in blocks, each with its own automaton and pass over the texts, one after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import covered, slices, text_bytes, words
from ._shared import caches, fresh, release, stored

WIDTH = 13
AUTOMATON_BYTES = 2 << 20
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:0x30] = FOLD[0x3A:0x41] = FOLD[0x5B:0x61] = FOLD[0x7B:0x80] = 0x20
FOLD[0x41:0x5B] += 0x20
GAP = FOLD == 0x20


def fold(text: str | None) -> list[str]:
    """The words of a text; each byte is kept as one character."""
    return (text or "").encode().translate(FOLD.tobytes()).decode("latin-1").split(" ")


def windows(text: str | None, width: int = WIDTH) -> list[str]:
    ws = [w for w in fold(text) if w]
    return [" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))] if ws else []


def _automaton(items: list[tuple[str, str]], width: int):
    import ahocorasick

    owners: dict[str, set[str]] = {}
    for item, text in items:
        for w in windows(text, width):
            owners.setdefault(w, set()).add(item)
    found = ahocorasick.Automaton()
    for w, of in owners.items():
        found.add_word(f" {w} ", (w.count(" ") + 1, tuple(of)))
    found.make_automaton()
    return found if owners else None


_automata: dict = {}
caches.append(_automata)


def automaton(items: list[tuple[str, str]], width: int):
    """One for each Python worker and block of the benchmark; the last one is kept."""
    key = (width, hash(tuple(items)))
    if key not in _automata:
        _automata.clear()
        _automata[key] = _automaton(items, width)
    return _automata[key]


def make_room() -> None:
    """Tasks call this by name, as they do automaton(): a dictionary that their own code named would be a new one in each task."""
    release(keep=(_automata,))


def _scan(items: list[tuple[str, str]], width: int, again: bool = False, keep_text: bool = False):
    """again: the batches carry the items and spans that earlier blocks of the benchmark found."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(items, width)
        make_room()
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            before = list(zip(batch.column("items").to_pylist(), batch.column("spans").to_pylist(), strict=True)) if again else None
            out: list[tuple] = []
            for i, j in slices(at, 1 << 22):
                own, cut = data[at[i] : at[j]], at[i : j + 1] - at[i]
                starts, ends, first = words(own, cut, GAP)
                plain = FOLD[own].tobytes()
                for k in range(j - i):
                    a, b = int(first[k]), int(first[k + 1])
                    mask, of = np.zeros(b - a, bool), set()
                    if found is not None and a < b:
                        text = f" {b' '.join(plain[cut[k] : cut[k + 1]].split()).decode('latin-1')} "
                        if ends_at := [(e, n, x) for e, (n, x) in found.iter(text)]:
                            spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 0x20)
                            stop = np.searchsorted(spaces, np.array([e for e, _, _ in ends_at]))
                            length = np.array([n for _, n, _ in ends_at])
                            for n in np.unique(length).tolist():
                                mask |= covered(b - a, stop[length == n] - n, n)
                            of.update(*(x for _, _, x in ends_at))
                    if before:
                        of.update(before[i + k][0])
                        for r in before[i + k][1]:
                            mask[r["first"] : r["stop"]] = True
                    spans = [{"first": s, "stop": e, "begin": int(starts[a + s] - cut[k]), "end": int(ends[a + e - 1] - cut[k])} for s, e in _runs(mask)] if of else []
                    out.append((b - a, int(mask.sum()), sorted(of), spans))
            n_words, n_hit, of_items, found_spans = zip(*out, strict=True) if out else ((), (), (), ())
            cols = [batch.column("doc_id"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(of_items, pa.list_(pa.string())), pa.array(found_spans, SPANS)]
            yield pa.RecordBatch.from_arrays(cols if keep_text else cols[:1] + cols[2:], NAMES if keep_text else NAMES[:1] + NAMES[2:])

    return scan


NAMES = ["doc_id", "text", "n_words", "n_hit", "items", "spans"]
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<first:long,stop:long,begin:long,end:long>>"
SPANS = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]))


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _blocks(benchmark: DataFrame, most: int) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """The benchmark, a stated query set, in blocks of at most about `most` bytes or one item, and whether each is the last."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").dropna().distinct()
    held, size = [], 0
    for r in items.toLocalIterator():
        if held and size + len(r.text) > most:
            yield held, False
            held, size = [], 0
        held.append((r.item, r.text))
        size += len(r.text)
    yield held, True


def benchmark_hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, items (with a window in it), and spans: the hit runs as
    word places [first, stop) and as byte places [begin, end) of the original text in UTF-8."""
    rows, again = docs.select(F.col("doc_id").cast("long"), "text"), False
    for block, last in _blocks(benchmark, automaton_bytes):
        rows = rows.mapInArrow(_scan(block, width, again, not last), SCHEMA if last else SCHEMA.replace("long,", "long, text string,", 1))
        if not last:
            rows, again = stored(rows, spark, "benchmark-block"), True
    return rows


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    ids = F.array_sort("items")
    return benchmark_hits(spark, docs, benchmark, width).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans",
    )


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns. The verdict is computed beside the row, so rows with a null or
    repeated doc_id stand for themselves; the spans that earlier blocks of the benchmark found go along."""
    names = docs.columns
    spans, bad = fresh("_spans", names), fresh("_bad", names)

    def judge(block: list[tuple[str, str]], again: bool):
        scan = _scan(block, width, again)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = {"doc_id": b.column("doc_id"), "text": b.column("text")}
                if again:
                    own |= {"items": pa.array([[]] * b.num_rows, pa.list_(pa.string())), "spans": b.column(spans)}
                for x in scan(iter([pa.RecordBatch.from_arrays(list(own.values()), list(own))])):
                    n_words, n_hit = x.column("n_words").to_numpy(), x.column("n_hit").to_numpy()
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), x.column("spans"), pa.array((n_hit > 0) & (20 * n_hit >= n_words))], [*names, spans, bad])

        return run

    schema = docs.select("*", F.expr("cast(null as array<struct<first:long,stop:long,begin:long,end:long>>)").alias(spans), F.expr("cast(null as boolean)").alias(bad)).schema
    rows, again = docs, False
    for block, last in _blocks(benchmark, automaton_bytes):
        rows = rows.mapInArrow(judge(block, again), schema)
        if not last:
            rows, again = stored(rows, spark, "benchmark-block"), True
    return rows.filter(~F.col(bad)).select(*names)
