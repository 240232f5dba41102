"""Repeated word windows by recompression.

Each text is a string of word names. A round first replaces every maximal run of one name by a name
for the run, then every pair of neighbours whose first name is of the left and whose second is of the
right kind by a name for the pair. Names and kinds are hashes of what they stand for, so all Spark tasks give the
same names without a dictionary, and equal substrings get the same symbols except near their ends.
With each symbol goes the range of words that it depends on.

A window is represented by one of the symbols that depend on nothing outside it, the one whose name has the
least hash; equal windows choose the same one at the same place. Neighbouring windows share it in runs.
Symbols that stand for one run only in the whole corpus are done; the others reveal candidates,
and every window of those is then compared by its own hash: equal ones are the repeats.

Cases: null text has no words; texts shorter than a window keep everything; a window repeated inside one
text is a repeat; equal rows repeat each other; a very long text is a batch of its own and needs memory in proportion to its words; an empty table gives no rows; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._bytes import mix, slices, window_hashes, word_hashes, words
from ._exchange import NO_ID, Exchange, Texts, answered, at_least, counted

WIDTH = 35
ROUNDS = 3
SLICE = 1 << 19
#: Of the bits by which symbols are compared, the last ones hold their place, so that the first of equals wins.
PLACE = np.uint64((1 << 26) - 1)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def recompress(codes: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after some rounds, and the word range [lo, hi) that each depends on. A symbol at the end of its
    text depends on what lies beyond."""
    name, own = codes, doc
    lo = np.arange(len(codes))
    hi = lo + 1
    for r in range(rounds):
        for pairs in (False, True):
            n = len(name)
            if n < 2:
                return name, lo - 1, hi + 1
            same_doc = own[1:] == own[:-1]
            left_lo, right_hi = lo - 1, hi + 1  # beyond the text's ends
            left_lo[1:][same_doc] = lo[:-1][same_doc]
            right_hi[:-1][same_doc] = hi[1:][same_doc]
            if not pairs:
                first = np.flatnonzero(np.concatenate([[True], ~same_doc | (name[1:] != name[:-1])]))
                length = np.diff(np.append(first, n))
                last = first + length - 1
                made = name[first]
                long = length > 1
                made[long] = mix(made[long] ^ mix(length[long].astype(np.uint64)))
                name, own, lo, hi = made, own[first], left_lo[first], right_hi[last]
            else:
                right = (mix(name ^ np.uint64(0x51ED27 + r)) & np.uint64(1)).astype(bool)
                joined = np.concatenate([same_doc & ~right[:-1] & right[1:], [False]])
                second = np.concatenate([[False], joined[:-1]])
                partner = np.flatnonzero(joined)
                new_lo = np.where(right, left_lo, lo)
                new_hi = np.where(right, hi, right_hi)
                new_lo[partner], new_hi[partner] = lo[partner], hi[partner + 1]
                made = name.copy()
                made[partner] = mix(name[partner] * np.uint64(0x9E3779B97F4A7C15) + mix(name[partner + 1]))
                keep = ~second
                name, own, lo, hi = made[keep], own[keep], new_lo[keep], new_hi[keep]
    return name, lo, hi


class Windows:
    """All windows of a slice of texts: their hashes, and the runs that share a symbol."""

    def __init__(self, t: Texts, i: int, j: int, width: int, rounds: int) -> None:
        self.begin = int(t.at[i])
        data, at = t.data[t.at[i] : t.at[j]], t.at[i : j + 1] - t.at[i]
        self.starts, self.ends, self.first = words(data, at)
        n = len(self.starts)
        self.keys, self.run_first, self.run_last = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.codes = word_hashes(data, self.starts, self.ends)
        if n < width:
            return
        doc = np.repeat(np.arange(j - i), np.diff(self.first))
        name, lo, hi = recompress(self.codes, doc, rounds)
        w = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
        if not len(w):
            return
        a, b = np.searchsorted(lo, w), np.searchsorted(hi, w + width, "right")
        ranked = (mix(name) & ~PLACE) | (np.arange(len(name), dtype=np.uint64) & PLACE)
        some = b > a
        chosen = np.full(len(w), -1, np.int64)
        level = np.frexp(np.maximum(b - a, 1).astype(np.float64))[1] - 1
        table = ranked
        for k in range(int(level[some].max(initial=0)) + 1):
            of = some & (level == k)
            if of.any():
                chosen[of] = (np.minimum(table[a[of]], table[b[of] - (1 << k)]) & PLACE).astype(np.int64)
            if len(table) > 1 << k:
                table = np.minimum(table[: -(1 << k)], table[1 << k :])
        new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (w[1:] != w[:-1] + 1) | (doc[w[1:]] != doc[w[:-1]]) | (chosen[1:] < 0)])
        at_run = np.flatnonzero(new)
        self.run_first = w[at_run]
        self.run_last = w[np.append(at_run[1:], len(w)) - 1]
        alone = chosen[at_run] < 0
        self.keys = name[np.maximum(chosen[at_run], 0)]
        if alone.any():
            self.keys[alone] = mix(window_hashes(self.codes, width)[self.run_first[alone]] + np.uint64(1))

    def window_keys(self, keep: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of the windows of some runs."""
        n = self.run_last[keep] - self.run_first[keep] + 1
        w = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.run_first[keep], n)
        return (window_hashes(self.codes, width)[w] if len(w) else np.zeros(0, np.uint64)), w


def _steps(width: int, rounds: int):
    parts = lambda t: (Windows(t, i, j, width, rounds) for i, j in slices(t.at, SLICE))
    joined = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.uint64)

    def symbols(t: Texts):
        keys, n = counted(joined([p.keys for p in parts(t)]), 2)
        return keys, [n]

    def kept_runs(t: Texts, p: list[Windows]) -> list[np.ndarray]:
        keep = answered(joined([x.keys for x in p]), t.bits(0))
        return np.split(keep, np.cumsum([len(x.keys) for x in p])[:-1]) if p else []

    def by_window(t: Texts):
        p = list(parts(t))
        found = [x.window_keys(keep, width) for x, keep in zip(p, kept_runs(t, p), strict=True)]
        before = np.cumsum([0, *[len(x.starts) for x in p]])
        every = joined([k for k, _ in found])
        keys, n = counted(every, 2)
        word = np.concatenate([w + b for (_, w), b in zip(found, before, strict=False)]) if found else np.zeros(0, np.int64)
        t.save(of=np.searchsorted(keys, every).astype(np.uint32), word=word.astype(np.uint32))
        return keys, [n]

    def cut(t: Texts, with_text: bool) -> pa.RecordBatch:
        s = t.saved(1)
        hit = s["word"][t.bits(1)[s["of"]]].astype(np.int64)
        own = [t.data[a:b].tobytes().split() for a, b in zip(t.at[:-1].tolist(), t.at[1:].tolist(), strict=True)]
        first = np.cumsum([0, *map(len, own)])
        n = int(first[-1])
        gone = np.cumsum(np.bincount(hit, minlength=n + 1) - np.bincount(hit + width, minlength=n + 1))[:n] > 0
        n_words, n_removed, kept = [], [], []
        for words_of, a, b in zip(own, first[:-1].tolist(), first[1:].tolist(), strict=True):
            lost = int(gone[a:b].sum())
            n_words.append(b - a)
            n_removed.append(lost)
            kept.append(b" ".join(compress(words_of, (~gone[a:b]).tolist()) if lost else words_of))
        ids = pa.array(t.ids, pa.int64(), mask=t.ids == NO_ID)
        cols = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            cols.append(pa.array([k.decode() for k in kept], pa.string()))
            names.append("kept")
        return pa.RecordBatch.from_arrays(cols, names)

    return symbols, by_window, cut


def remove_repeated_windows(spark: SparkSession, docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS, with_text: bool = False, **sizes: int) -> DataFrame:
    """Remove each word covered by a window of `width` words that also starts anywhere else, the same text included.

    Per row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words joined by one space."""
    symbols, by_window, cut = _steps(width, rounds)
    x = Exchange(spark, docs, **sizes)
    x.ask(symbols, at_least(2), ["u1"])
    x.ask(by_window, at_least(2), ["u1"], (0,))
    return x.result(lambda t: cut(t, with_text), RESULT + ", kept string" * with_text, (1,))
