"""Exact duplicate byte ranges by a depth-limited radix sort of suffixes.

Only the first `width` bytes of each suffix count, and they are looked at digit by digit, the most
selective one first; after each pass the suffixes alone in their group leave.
Pass 1, the leading digit: the least hash of all 20-byte grams in the suffix's first `width` bytes.
Neighbouring suffixes share it in runs, so a run is handled as one. Runs alone in their document's
group over the whole corpus are done: no equal window exists elsewhere.
Pass 2, the run's whole text: where every run of a group has the same text, the group's smallest
document decides for all its windows at once.
Pass 3, the full window: single windows of the groups that remain. Their equal groups are exactly the
repeated windows, told apart by 64-bit hashes within equal leading digits.

Cases: null text is empty; a null doc_id counts as larger than any other and removes nothing elsewhere; rows with the
same doc_id never remove each other's bytes; texts shorter than the width keep everything; a very long text is cut into overlapping pieces while windows are made; an empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._bytes import BASE, BYTE_CODES, INVERSE, mix, powers, sliding_min, slices
from ._exchange import NO_ID, Exchange, Texts, answered, at_least, beaten, counted_once_a_document

WIDTH = 50
GRAM = 20
SLICE = 1 << 18
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Runs:
    """Runs of neighbouring windows with the same leading digit, of all texts of a batch."""

    def __init__(self, t: Texts, width: int, gram: int, whole: bool = False) -> None:
        self.width = width
        parts: list[tuple[np.ndarray, ...]] = []
        for i, j in slices(t.at, SLICE):
            for a, b in self._pieces(int(t.at[i]), int(t.at[j]), j - i):
                parts.append(self._runs(t, i, j, a, b, gram, whole))
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64)]
        self.keys, self.docs, self.first, self.last, self.whole = joined

    def _pieces(self, a: int, b: int, n: int) -> Iterator[tuple[int, int]]:
        """A very long text is looked at in overlapping pieces."""
        step = 1 << 20
        if n > 1 or b - a <= step:
            yield a, b
            return
        for k in range(a, b - self.width + 1, step):
            yield k, min(b, k + step + self.width - 1)

    def _runs(self, t: Texts, i: int, j: int, a: int, b: int, gram: int, whole: bool) -> tuple[np.ndarray, ...]:
        n, width = b - a, self.width
        if n < width:
            return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64)
        total = prefix(t.data[a:b])
        grams = mix((total[gram:] - total[:-gram]) * powers(INVERSE, n - gram + 1))
        digit = sliding_min(grams, width - gram + 1)
        starts, stops = np.maximum(t.at[i:j], a) - a, np.minimum(t.at[i + 1 : j + 1], b) - a - width + 1
        fits = np.flatnonzero(stops > starts)
        begins = np.zeros(len(digit) + 1, np.int32)
        begins[starts[fits]] += 1
        inside = np.zeros(len(digit) + 1, np.int32)
        inside[starts[fits]] += 1
        inside[stops[fits]] -= 1
        valid = np.cumsum(inside[:-1]) > 0
        new = begins[:-1] > 0
        new[1:] |= (digit[1:] != digit[:-1]) | ~valid[:-1]
        first = np.flatnonzero(new & valid)
        doc = fits[np.searchsorted(starts[fits], first, "right") - 1]
        end = np.empty(len(first), np.int64)
        end[:-1] = first[1:]
        end[-1:] = stops[fits[-1:]]
        last = np.minimum(end, stops[doc]) - 1
        text = mix((total[last + width] - total[first]) * powers(INVERSE, n + 1)[first] + (last - first).astype(np.uint64)) if whole else np.zeros(len(first), np.uint64)
        return mix(digit[first]), doc + i, first + a, last + a, text  # mixed again: least values would fill the first buckets


def prefix(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(BASE, len(data)), out=total[1:])
    return total


def window_keys(t: Texts, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows first..last of each run, and the run of each; runs in ascending order."""
    keys, of = [], []
    k = 0
    while k < len(first):
        stop = max(k + 1, int(np.searchsorted(first, first[k] + SLICE)))
        a, b = int(first[k]), int(last[k:stop].max()) + width
        total = prefix(t.data[a:b])
        n = last[k:stop] - first[k:stop] + 1
        run = np.repeat(np.arange(k, stop), n)
        w = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + first[run] - a
        keys.append(mix((total[w + width] - total[w]) * powers(INVERSE, b - a + 1)[w]))
        of.append(run)
        k = stop
    return (np.concatenate(keys), np.concatenate(of)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by key, where each distinct key begins in it, and the distinct keys."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return order, first, k[first]


def _radix(width: int, gram: int):
    def leading(t: Texts):
        r = Runs(t, width, gram)
        keys, n = counted_once_a_document(r.keys, r.docs, 2)
        return keys, [n]

    def by_run(t: Texts):
        r = Runs(t, width, gram, True)
        keep = answered(r.keys, t.bits(0))
        order, first, keys = grouped(r.keys[keep])
        t.save(of=np.searchsorted(keys, r.keys[keep]).astype(np.uint32), first=r.first[keep].astype(np.uint32), n=(r.last - r.first + 1)[keep].astype(np.uint32))
        if not len(keys):
            return keys, [np.zeros(0, np.int64)] + [np.zeros(0, np.uint64)] * 2
        ids, text = t.ids[r.docs[keep]][order], r.whole[keep][order]
        return keys, [np.minimum.reduceat(ids, first), np.minimum.reduceat(text, first), np.maximum.reduceat(text, first)]

    def join_runs(first: np.ndarray, vals: list[np.ndarray]) -> np.ndarray:
        """The smallest doc_id where all runs have the same text; else NO_ID - 1, which asks for a look at each window."""
        same = np.minimum.reduceat(vals[1], first) == np.maximum.reduceat(vals[2], first)
        return np.where(same, np.minimum.reduceat(vals[0], first), NO_ID - 1)

    def decided(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The runs that survive: first and last window, text, the smallest document of the run's group, and whether it wants a look at each window."""
        r = t.saved(1)
        first = r["first"].astype(np.int64)
        low = t.longs(1)[r["of"]]
        return first, first + r["n"] - 1, np.searchsorted(t.at, first, "right") - 1, low, low == NO_ID - 1

    def by_window(t: Texts):
        first, last, doc, _, open_ = decided(t)
        keys, of = window_keys(t, first[open_], last[open_], width)
        order, begins, distinct = grouped(keys)
        ids = t.ids[doc[open_]][of][order]
        return distinct, [np.minimum.reduceat(ids, begins) if len(begins) else ids]

    def cut(t: Texts, with_text: bool) -> pa.RecordBatch:
        first, last, doc, low, open_ = decided(t)
        own = t.ids[doc]
        step = np.zeros(len(t.data) + 1, np.int32)
        sure = ~open_ & (low < own)
        np.add.at(step, first[sure], 1)
        np.add.at(step, last[sure] + width, -1)
        keys, of = window_keys(t, first[open_], last[open_], width)
        if len(keys):
            where = np.arange(len(keys)) - np.searchsorted(of, of) + first[open_][of]
            # A window goes if its string has a smaller document in another batch, or in this one.
            order, begins, _ = grouped(keys)
            ids, n = own[open_][of][order], np.diff(np.append(begins, len(keys)))
            lost = np.empty(len(keys), bool)
            lost[order] = np.repeat(t.bits(2), n) | (np.repeat(np.minimum.reduceat(ids, begins), n) < ids)
            gone = where[lost]
            step += np.bincount(gone, minlength=len(step)).astype(np.int32)
            step -= np.bincount(gone + width, minlength=len(step)).astype(np.int32)
        removed = np.cumsum(step)[:-1] > 0
        n_removed = np.concatenate([[0], np.cumsum(removed)])
        begins = np.zeros(len(t.data) + 1, bool)
        begins[t.at] = True
        opens = removed & ~np.concatenate([[False], removed[:-1]]) | removed & begins[:-1]
        n_opens = np.concatenate([[0], np.cumsum(opens)])
        kept = [t.data[a:b][~removed[a:b]].tobytes() for a, b in zip(t.at[:-1].tolist(), t.at[1:].tolist(), strict=True)]
        ids = pa.array(t.ids, pa.int64(), mask=t.ids == NO_ID)
        cols = [ids, pa.array(np.diff(t.at)), pa.array(np.diff(n_removed[t.at])), pa.array(np.diff(n_opens[t.at])), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            cols.append(pa.array(kept, pa.binary()))
            names.append("kept")
        return pa.RecordBatch.from_arrays([c.cast(pa.int64()) if pa.types.is_integer(c.type) else c for c in cols], names)

    return leading, by_run, join_runs, by_window, cut


def remove_repeats(spark: SparkSession, docs: DataFrame, width: int = WIDTH, gram: int = GRAM, with_text: bool = False, **sizes: int) -> DataFrame:
    """Remove each byte covered by a `width`-byte string that also starts in a document with a smaller doc_id.

    Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes (a cut may
    fall inside a character)."""
    leading, by_run, join_runs, by_window, cut = _radix(width, gram)
    x = Exchange(spark, docs, **sizes)
    x.ask(leading, at_least(2), ["u1"])
    x.ask(by_run, join_runs, ["i8", "u8", "u8"], (0,))
    x.ask(by_window, beaten, ["i8"], (1,))
    return x.result(lambda t: cut(t, with_text), RESULT + ", kept binary" * with_text, (1, 2))
