"""Alignment of two tokenizers over the same bytes: a byte-level BPE (A) and a SentencePiece model (B).

Spark hands each task batches of a few MB. A space goes before each text, and the bytes are cut before white space that follows other characters, where neither
tokenizer's tokens can cross: the distinct chunks of a batch are encoded once. Their tokens tile one long line of bytes, which gives two interval
tables. DuckDB joins them in the task: an ASOF join finds the B token that holds a token's first byte, a range join
the others that it overlaps, an equality of ends the cuts between groups, and window sums number the groups. What chunks have is then summed over
the texts. A batch sends each pair of ids that it links once, with the number of its documents; Spark adds these up, and the highest count of each A id, and answers each
batch with the counts that it asked for.

Chunks are cut only where a look at both vocabularies shows that it is safe; else whole texts are chunks. A's ids come from its ranks, read from the same file,
for characters below U+0280, which all versions of Unicode class alike, and from its own library for all others.

Cases: texts that are null or empty, or whose joined tokens of A or B are not space + text (U+2581 in a text is one), have no tokens: zeros, and an empty groups_sha256; a null
doc_id is kept; repeated rows are documents each, so a pair's count counts both; a very long text is one document of one batch; many equal texts are one set of chunks;
an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ._bytes import mix, text_bytes, word_hashes
from ._exchange import NO_ID, Exchange, Texts

BATCH_BYTES = 4 << 20
PIECE_CHUNKS = 1 << 15
PIECE_BYTES = 1 << 19
SLICE = 1 << 20
#: The split of byte-level BPE into runs that its tokens don't cross: a fixed pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lead byte of U+0280.
RARE = 0xCA
#: White space beyond ASCII in UTF-8: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000. Fixed values.
SPACES_2 = np.array([0xC285, 0xC2A0])
SPACES_3 = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_of_character() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 characters stand for themselves, the others for U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Vocabulary:
    """The bytes of each id, one after another."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        stop = np.cumsum(n)
        return self.pool[np.repeat(self.begin[ids] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)]


class Tokenizers:
    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path_a)
        self.slow.encode_special_tokens = True
        back = byte_of_character()
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, before = spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
        tokens = [b""] * (max([*vocab.values(), *[x["id"] for x in spec["added_tokens"]]]) + 1)
        special = {x["content"] for x in spec["added_tokens"]}
        for token, i in vocab.items():
            tokens[i] = token.encode() if token in special else bytes(back[c] for c in token)
        self.a = Vocabulary(tokens)
        # Ranks tell what merges first if each merge makes a later id than the one before.
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab["".join(m)] for m in merges]
        self.usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and spec.get("normalizer") is None
        self.fast = None
        if self.usual and made == sorted(set(made)) and len(made) + 256 == len(vocab) - len(special & set(vocab)):
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={bytes(back[c] for c in t): i for t, i in vocab.items() if t not in special}, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b = Vocabulary([bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        usual = [p for i, p in enumerate(names) if not (self.pieces.is_byte(i) or self.pieces.is_control(i) or self.pieces.is_unknown(i))]
        self.space = self.pieces.piece_to_id("▁")
        probe = "a  b\n c  d\n\n  e \n"
        whole = self.pieces.encode(probe)
        self.by_chunk = self.usual and not any(re.search("[^▁]▁|\n", p) for p in usual) and [x for c in re.findall(r"(?:[ \n ]+)[^ \n ]*", " " + probe) for x in self._b([c])[0]] == whole

    def _a(self, chunks: list[str], common: list[bool]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.slow.encode_batch(chunks, add_special_tokens=False)]
        one = self.fast.encode_ordinary
        out = [one(c) if k else None for c, k in zip(chunks, common, strict=True)]
        rare = [i for i, k in enumerate(common) if not k]
        for i, e in zip(rare, self.slow.encode_batch([chunks[i] for i in rare], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _b(self, chunks: list[str]) -> list[list[int]]:
        """B puts a space before what it is given: chunks that begin with one give theirs, others lose the token of the one they got."""
        got = self.pieces.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [([self.space] if c == " " else x) if c[0] == " " else x[1:] for c, x in zip(chunks, got, strict=True)]

    def encode(self, chunks: list[str], common: list[bool]) -> tuple[list[list[int]], list[list[int]]]:
        return self._a(chunks, common), self._b(chunks)


_tokenizers: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One for each Python worker."""
    return _tokenizers.get((path_a, path_b)) or _tokenizers.setdefault((path_a, path_b), Tokenizers(path_a, path_b))


def with_spaces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before each text."""
    n = len(at) - 1
    out = np.full(len(data) + n, 0x20, np.uint8)
    text = np.ones(len(out), bool)
    text[at[:-1] + np.arange(n)] = False
    out[text] = data
    return out, at + np.arange(n + 1)


def chunk_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where chunks begin: at each text, and at a space or line feed after a character that is no white space."""
    gap = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    p = np.flatnonzero(((data[1:] == 0x20) | (data[1:] == 0x0A)) & ~gap[:-1]) + 1
    wide = p[data[p - 1] >= 0x80]
    if len(wide):
        d = lambda at: data[np.maximum(at, 0)].astype(np.int64)
        two = (d(wide - 2) << 8) | d(wide - 1)
        three = (d(wide - 3) << 16) | two
        p = np.setdiff1d(p, wide[np.isin(two, SPACES_2) | np.isin(three, SPACES_3)], assume_unique=True)
    return np.union1d(p, at[:-1])


LINKS = """WITH x AS (SELECT a.n, a.e, f.n AS first FROM a ASOF JOIN b f ON a.s >= f.s) SELECT x.n AS a, b.n AS b FROM x JOIN b ON b.n >= x.first AND b.s < x.e"""
GROUPS = """SELECT n, coalesce(sum(cut) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM (SELECT {0}.n, CAST({1}.e IS NOT NULL AS INT) AS cut FROM {0} LEFT JOIN {1} ON {0}.e = {1}.e) ORDER BY n"""


class Line:
    """DuckDB over the two interval tables of one line of bytes."""

    def __init__(self) -> None:
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})

    def __call__(self, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Linked tokens (of A, of B), and the group of each token of A and of B, all by number."""
        for name, size in (("a", size_a), ("b", size_b)):
            e = np.cumsum(size)
            self.con.register(name, pa.table({"n": np.arange(len(e)), "s": e - size, "e": e}))
        links = self.con.sql(LINKS).to_arrow_table()
        out = [links.column(c).to_numpy() for c in ("a", "b")] + [self.con.sql(GROUPS.format(*x)).to_arrow_table().column("g").to_numpy() for x in (("a", "b"), ("b", "a"))]
        for name in ("a", "b"):
            self.con.unregister(name)
        return tuple(out)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in lists], np.int64)
    return np.fromiter((i for x in lists for i in x), np.int64, int(n.sum())), n


def ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for n[0] places, and so on."""
    stop = np.cumsum(n)
    return np.repeat(begin - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)


class Batch:
    """The chunks of a batch: those of each text in order, and what each distinct one has."""

    def __init__(self, t: Texts, both: Tokenizers, line: Line) -> None:
        self.n_docs = len(t.ids)
        data, at = with_spaces(t.data, t.at)
        starts = chunk_starts(data, at) if both.by_chunk else at[:-1]
        ends = np.append(starts[1:], len(data))
        self.first = np.searchsorted(starts, at)
        _, where, self.of = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        self.of = self.of.astype(np.int32)
        s, e = starts[where], ends[where]
        parts, self.texts, i = [], [], 0
        while i < len(s):
            # A piece of all distinct chunks at a time, so that lists and joins stay small.
            j = min(max(i + 1, int(np.searchsorted(np.cumsum((e - s)[i:]), PIECE_BYTES, "right")) + i), i + PIECE_CHUNKS, len(s))
            parts.append(self._piece(data, s[i:j], e[i:j], both, line))
            i = j
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)] or [np.zeros(0, np.int64)] * 6
        self.n_a, self.n_b, self.same, self.n_groups, self.n_links, pairs = joined
        self.fine = np.diff(t.at) > 0
        if self.n_docs:
            self.fine &= np.add.reduceat(~self.same.astype(bool)[self.of], self.first[:-1]) == 0
        # Pairs of ids, each once, and the pairs of each chunk.
        self.pairs, self.pair_of = np.unique(pairs.astype(np.uint64), return_inverse=True)
        self.pair_of = self.pair_of.astype(np.int32)
        self.link_begin = np.cumsum(self.n_links) - self.n_links

    def _piece(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, both: Tokenizers, line: Line) -> tuple[np.ndarray, ...]:
        """Of some chunks: numbers of tokens of A and B, whether these say what the chunk does, numbers of groups and links, and the linked pairs chunk by chunk."""
        raw = [data[i:j].tobytes() for i, j in zip(s.tolist(), e.tolist(), strict=True)]
        common = np.maximum.reduceat(np.append(data[ranges(s, e - s)], 0), np.cumsum(e - s) - (e - s)) < RARE
        (a, n_a), (b, n_b) = map(_flat, both.encode([x.decode() for x in raw], common.tolist()))
        of_a, of_b = np.repeat(np.arange(len(s)), n_a), np.repeat(np.arange(len(s)), n_b)
        size_a, size_b = both.a.size[a], both.b.size[b]
        same = (np.bincount(of_a, size_a, len(s)) == e - s) & (np.bincount(of_b, size_b, len(s)) == e - s)
        if same.any():
            want = data[ranges(s[same], (e - s)[same])]
            odd = (both.a.joined(a[same[of_a]]) != want) | (both.b.joined(b[same[of_b]]) != want)
            if odd.any():
                same[np.flatnonzero(same)[np.unique(np.repeat(np.arange(int(same.sum())), (e - s)[same])[odd])]] = False
        keep_a, keep_b = same[of_a], same[of_b]
        a, b, of_a, of_b = a[keep_a], b[keep_b], of_a[keep_a], of_b[keep_b]
        link_a, link_b, group_a, group_b = line(size_a[keep_a], size_b[keep_b]) if len(a) else [np.zeros(0, np.int64)] * 4
        n_groups = self._texts(len(s), a, b, of_a, of_b, group_a, group_b)
        order = np.argsort(link_a, kind="stable")
        link_a, link_b = link_a[order], link_b[order]
        return n_a, n_b, same.astype(np.int64), n_groups, np.bincount(of_a[link_a], minlength=len(s)), (a[link_a] << 32) | b[link_b]

    def _texts(self, n: int, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> np.ndarray:
        """What stands in the digest for each chunk, each group closed by a semicolon; how many groups each has."""
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
        end = np.concatenate([np.where(last(group_a), 1, 0), np.where(last(group_b), 2, 0)])
        side = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
        order = np.lexsort((side, np.concatenate([group_a, group_b])))
        texts = pc.binary_join_element_wise(pa.array(np.concatenate([a, b])[order]).cast(pa.string()), pa.array([",", "|", ";"]).take(pa.array(end[order])), "")
        raw, at = text_bytes(texts)
        of = np.concatenate([of_a, of_b])[order]
        cut = at[np.searchsorted(of, np.arange(n + 1))].tolist()
        raw = raw.tobytes()
        self.texts += [raw[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
        return np.bincount(of_b, last(group_b), n).astype(np.int64)

    def uses(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text that has tokens, its distinct chunks: text, chunk, how often."""
        doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        fine = self.fine[doc]
        key, n = np.unique(doc[fine] * np.int64(max(1, len(self.n_a))) + self.of[fine], return_counts=True)
        return key // max(1, len(self.n_a)), key % max(1, len(self.n_a)), n

    def documents_of_pairs(self, doc: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """In how many texts each pair is linked; a slice of texts at a time."""
        total = np.zeros(len(self.pairs), np.int64)
        weight = np.concatenate([[0], np.cumsum(self.n_links[chunk])])
        cuts = np.searchsorted(doc, np.arange(self.n_docs + 1))
        i = 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(weight[cuts], weight[cuts[i]] + SLICE, "right")) - 1)
            d, c = doc[cuts[i] : cuts[j]], chunk[cuts[i] : cuts[j]]
            pair = self.pair_of[ranges(self.link_begin[c], self.n_links[c])]
            key = np.unique(np.repeat(d, self.n_links[c]) * np.int64(len(self.pairs)) + pair)
            if len(key):
                total += np.bincount(key % len(self.pairs), minlength=len(self.pairs))
            i = j
        return total

    def digests(self) -> list[str]:
        out = []
        for d, (i, j) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)):
            out.append(hashlib.sha256(b"".join(map(self.texts.__getitem__, self.of[i:j].tolist()))[:-1]).hexdigest() if self.fine[d] else "")
        return out


def _bucket(key: np.ndarray) -> np.ndarray:
    """Spreads keys over buckets; one to one, so that answers are whole."""
    return mix(key.copy())


def _steps(path_a: str, path_b: str):
    def linked(t: Texts):
        both = tokenizers(path_a, path_b)
        x = Batch(t, both, Line())
        doc, chunk, n = x.uses()
        total = lambda each: np.bincount(doc, each[chunk] * n, x.n_docs).astype(np.int64)
        docs_of = x.documents_of_pairs(doc, chunk)
        used = np.flatnonzero(docs_of)  # pairs of chunks that only texts without tokens have don't count
        key = _bucket(x.pairs[used])
        order = np.argsort(key)
        place = np.zeros(len(x.pairs), np.int64)
        place[used[order]] = np.arange(len(used))
        t.save(
            ids=t.ids, doc=np.diff(doc, prepend=0).astype(np.uint32), chunk=np.diff(chunk, prepend=0).astype(np.int32), n=n.astype(np.uint32), n_links=x.n_links.astype(np.uint32), pair=place[x.pair_of].astype(np.uint32),
            a=(x.pairs[used[order]] >> np.uint64(32)).astype(np.uint32), sums=np.stack([total(x.n_a), total(x.n_b), total(x.n_groups), total(x.n_links)]), sha=np.array(x.digests(), "S64"),
        )
        return key[order], [docs_of[used][order]]

    def highest(t: Texts):
        """The highest count of each A id, as far as this batch has its pairs: every pair of the corpus is in some batch."""
        key = _bucket(t.saved(0)["a"].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        k, count = key[order], t.longs(0)[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        return k[first], [np.maximum.reduceat(count, first) if len(k) else count]

    def result(t: Texts) -> pa.RecordBatch:
        s, count = t.saved(0), t.longs(0)
        key = _bucket(s["a"].astype(np.uint64))
        best = t.longs(1)[np.unique(key, return_inverse=True)[1]] == count if len(key) else np.zeros(0, bool)
        of = np.repeat(np.arange(len(s["n_links"])), s["n_links"])
        # Sums of whole numbers below 2**53 in one document; a float holds them.
        per_best = np.bincount(of, best[s["pair"]], len(s["n_links"])) if len(of) else np.zeros(len(s["n_links"]))
        per_count = np.bincount(of, count[s["pair"]], len(s["n_links"])) if len(of) else np.zeros(len(s["n_links"]))
        doc, chunk = np.cumsum(s["doc"], dtype=np.int64), np.cumsum(s["chunk"], dtype=np.int64)
        total = lambda each: np.bincount(doc, each[chunk] * s["n"], len(s["ids"])).astype(np.int64) if len(doc) else np.zeros(len(s["ids"]), np.int64)
        cols = [pa.array(s["ids"], pa.int64(), mask=s["ids"] == NO_ID), *map(pa.array, s["sums"]), pa.array(total(per_best)), pa.array(total(per_count)), pa.array([x.decode() for x in s["sha"].tolist()], pa.string())]
        return pa.RecordBatch.from_arrays(cols, [c.split(" ")[0] for c in RESULT.split(", ")])

    return linked, highest, result


def _sum(first: np.ndarray, vals: list[np.ndarray]) -> np.ndarray:
    return np.add.reduceat(vals[0], first)


def _most(first: np.ndarray, vals: list[np.ndarray]) -> np.ndarray:
    return np.maximum.reduceat(vals[0], first)


def align(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, batch_bytes: int = BATCH_BYTES, **sizes: int) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    linked, highest, result = _steps(path_a, path_b)
    x = Exchange(spark, docs, batch_bytes=batch_bytes, **sizes)
    x.ask(linked, _sum, ["i8"])
    x.ask(highest, _most, ["i8"], (0,))
    return x.result(result, RESULT, (0, 1))
