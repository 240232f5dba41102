"""Vectorised work on the bytes of many texts at once: words, hashes of words, n-grams and byte windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd, so that its powers have inverses modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
WORD_INVERSE = np.uint64(pow(int(WORD_BASE), -1, 1 << 64))
BYTE_CODES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

PIECE = 1 << 18
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 21:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return all_bytes[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes; a longer one stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each document's words begin among them."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~space[data]
    begins = np.zeros(n + 1, bool)
    begins[at] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | begins[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | begins[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands. Works in pieces of about PIECE bytes, or one word."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        a = int(starts[k])
        j = max(k + 1, int(np.searchsorted(ends, a + PIECE, "right")))
        s, e = starts[k:j] - a, ends[k:j] - a
        n = int(e[-1])
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODES[data[a : a + n]] * powers(BASE, n), out=total[1:])
        out[k:j] = mix((total[e] - total[s]) * powers(INVERSE, n + 1)[s] + (e - s).astype(np.uint64))
        k = j
    return out


def window_hashes(codes: np.ndarray, width: int, base: np.uint64 = WORD_BASE, inverse: np.uint64 = WORD_INVERSE) -> np.ndarray:
    """A hash of each run of `width` consecutive codes, the same wherever the run stands."""
    n = len(codes)
    if n < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * powers(base, n), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(inverse, n - width + 1))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n places lie in any of the windows [start, start + width)."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + width, minlength=n + 1)
    return np.cumsum(step)[:n] > 0
