"""Line dedup with a log-template tree of fixed depth.

A line goes to a leaf by its number of tokens and its leading tokens. Tokens with a digit count as variable, and so do leading
tokens that lines of that many tokens have at that place in fewer than `min_docs` documents. Within a leaf, a token at a place stays constant if lines of at least `min_docs`
documents have it there; every other token becomes a variable field. The line with its variable fields is its
template. Templates that occur in at least `min_docs` documents, with at least `constant_share` of constant
tokens, are boilerplate: all their lines are dropped.

The tree is built over the whole corpus at once, so results don't depend on the order of rows. Leaves,
tokens and templates are summed in each batch before they are shuffled, so a line that a third of all
documents hold costs one entry a batch.

Cases: null text has one empty line, as the empty text; lines of fewer than `min_tokens` tokens are kept (the query looks at all);
equal lines of one document count once for it, and all are dropped or kept together; repeated rows count as documents; a very long text is a batch of its own and needs memory in proportion to its tokens;
an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._bytes import mix, slices, word_hashes, words
from ._exchange import NO_ID, Exchange, Texts, answered, at_least, counted_once_a_document

DEPTH = 3
MIN_DOCS = 10
MIN_TOKENS = 3
CONSTANT_SHARE = 0.5
SLICE = 1 << 19
VARIABLE = np.uint64(0x5851F42D4C957F2D)
RESULT = "doc_id long, n_lines long, n_dropped long, n_chars_kept long, kept_sha256 string"


class Lines:
    """The lines of a slice of texts, and their tokens' places. Tokens get a code only where it is asked for."""

    def __init__(self, t: Texts, i: int, j: int, min_tokens: int) -> None:
        self.data, at = t.data[t.at[i] : t.at[j]], t.at[i : j + 1] - t.at[i]
        self.line_at, self.doc = lines_of(self.data, at)
        self.doc += i
        self.starts, self.ends, self.first = words(self.data, np.append(self.line_at, at[-1]))
        self.count = np.diff(self.first)
        self.used = np.flatnonzero(self.count >= max(1, min_tokens))

    def codes(self, line: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Codes of tokens, given by line and place in ascending order."""
        word = self.first[line] + place
        starts, ends = self.starts[word], self.ends[word]
        out = word_hashes(self.data, starts, ends)
        digits = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum((self.data >= 0x30) & (self.data <= 0x39), out=digits[1:])
        out[digits[ends] > digits[starts]] = VARIABLE
        return out


def lines_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each line begins and its text. Each text begins a line, and so does what follows each break."""
    breaks = np.flatnonzero(data == 0x0A)
    owner = np.searchsorted(at, breaks, "right") - 1
    return np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable"), np.sort(np.concatenate([np.arange(len(at) - 1), owner]), kind="stable")


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For n[0], n[1], ... tokens: the line of each, numbered from 0, and its place in it."""
    line = np.repeat(np.arange(len(n)), n)
    return line, np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def leading_keys(count: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, place, token) keys of the leading tokens of lines, 0 for variable ones; the line and the place of each."""
    line, place = spread(np.minimum(count, lead.shape[1]))
    code = lead[line, place]
    key = mix(mix(count[line].astype(np.uint64)) + mix(place.astype(np.uint64) + np.uint64(1)) ^ code)
    return np.where(code == VARIABLE, np.uint64(0), key), line, place


def leaf_keys(count: np.ndarray, lead: np.ndarray) -> np.ndarray:
    key = mix(count.astype(np.uint64))
    for k in range(lead.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + lead[:, k])
    return key


def template_keys(leaf: np.ndarray, count: np.ndarray, keys: np.ndarray, constant: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Template key of each line and whether it has enough constant tokens. keys: those of all tokens of the lines."""
    line, place = spread(count)
    parts = np.where(constant, keys, VARIABLE)
    total = np.add.reduceat(mix(parts + mix(place.astype(np.uint64))), np.cumsum(count) - count) if len(line) else np.zeros(0, np.uint64)
    return mix(total + leaf), np.bincount(line, weights=constant, minlength=len(count)) >= share * count


def _steps(depth: int, min_docs: int, min_tokens: int, share: float):
    def leads(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token counts of used lines, the codes of their leading tokens, and their texts."""
        counts, codes, docs = [], [], []
        for i, j in slices(t.at, SLICE):
            x = Lines(t, i, j, min_tokens)
            n = x.count[x.used]
            line, place = spread(np.minimum(n, depth))
            lead = np.zeros((len(n), depth), np.uint64)
            lead[line, place] = x.codes(x.used[line], place)
            counts.append(n)
            codes.append(lead)
            docs.append(x.doc[x.used])
        return _joined(counts, np.int64), np.concatenate(codes) if codes else np.zeros((0, depth), np.uint64), _joined(docs, np.int64)

    def leading(t: Texts):
        count, lead, doc = leads(t)
        keys, line, _ = leading_keys(count, lead)
        keys, n = counted_once_a_document(keys, doc[line])
        return keys, [n]

    def leaves(t: Texts):
        count, lead, doc = leads(t)
        keys, line, place = leading_keys(count, lead)
        lost = ~(answered(keys, t.bits(0)) & (keys != 0))
        lead[line[lost], place[lost]] = VARIABLE  # the leaf's wildcard child
        leaf = leaf_keys(count, lead)
        t.save(leaf=leaf)
        keys, n = counted_once_a_document(leaf, doc)
        return keys, [n]

    def in_leaves(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the lines in leaves that count: (leaf, place, token) keys of all tokens, token counts, texts, numbers among the batch's lines, and leaves."""
        leaf = t.saved(1)["leaf"]
        keep = answered(leaf, t.bits(1))
        keys, counts, docs, numbers, seen, before = [], [], [], [], 0, 0
        for i, j in slices(t.at, SLICE):
            x = Lines(t, i, j, min_tokens)
            own = keep[seen : seen + len(x.used)]
            of = x.used[own]
            line, place = spread(x.count[of])
            code = x.codes(of[line], place)
            key = mix(leaf[seen : seen + len(x.used)][own][line] + mix(place.astype(np.uint64) + np.uint64(1)) ^ code)
            keys.append(np.where(code == VARIABLE, np.uint64(0), key))
            counts.append(x.count[of])
            docs.append(x.doc[of])
            numbers.append(of + before)
            seen, before = seen + len(x.used), before + len(x.count)
        return _joined(keys, np.uint64), _joined(counts, np.int64), _joined(docs, np.int64), _joined(numbers, np.int64), leaf[keep]

    def tokens(t: Texts):
        keys, count, doc, _, _ = in_leaves(t)
        found, n = counted_once_a_document(keys, doc[spread(count)[0]])
        return found, [n]

    def templates(t: Texts):
        keys, count, doc, number, leaf = in_leaves(t)
        key, ok = template_keys(leaf, count, keys, answered(keys, t.bits(2)) & (keys != 0), share)
        t.save(key=key[ok], number=number[ok])
        keys, n = counted_once_a_document(key[ok], doc[ok])
        return keys, [n]

    def cut(t: Texts, with_text: bool) -> pa.RecordBatch:
        s = t.saved(3)
        _, doc = lines_of(t.data, t.at)
        drop = np.zeros(len(doc), bool)
        drop[s["number"][answered(s["key"], t.bits(3))]] = True
        n_lines, n_dropped, kept = [], [], []
        cuts = np.searchsorted(doc, np.arange(len(t.ids) + 1)).tolist()
        for d, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            text = t.data[t.at[d] : t.at[d + 1]].tobytes()
            lost = int(drop[a:b].sum())
            n_lines.append(b - a)
            n_dropped.append(lost)
            kept.append(b"\n".join(x for x, gone in zip(text.split(b"\n"), drop[a:b].tolist(), strict=True) if not gone) if lost else text)
        ids = pa.array(t.ids, pa.int64(), mask=t.ids == NO_ID)
        texts = [k.decode() for k in kept]
        cols = [ids, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array([len(k) for k in texts], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        names = ["doc_id", "n_lines", "n_dropped", "n_chars_kept", "kept_sha256"]
        if with_text:
            cols.append(pa.array(texts, pa.string()))
            names.append("kept")
        return pa.RecordBatch.from_arrays(cols, names)

    return leading, leaves, tokens, templates, cut


def drop_template_lines(
    spark: SparkSession, docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, constant_share: float = CONSTANT_SHARE, with_text: bool = False, **sizes: int
) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, n_chars_kept, kept_sha256 and, if asked for, the kept lines."""
    leading, leaves, tokens, templates, cut = _steps(depth, min_docs, min_tokens, constant_share)
    x = Exchange(spark, docs, **sizes)
    x.ask(leading, at_least(min_docs), ["u2"])
    x.ask(leaves, at_least(min_docs), ["u2"], (0,))
    x.ask(tokens, at_least(min_docs), ["u2"], (1,))
    x.ask(templates, at_least(min_docs), ["u2"], (1, 2))
    return x.result(lambda t: cut(t, with_text), RESULT + ", kept string" * with_text, (3,))
