"""Token-id files: patched frame-of-reference blocks.

Every text is encoded, its end id appended, and the ids of a run of documents in ascending
doc_id order form one file. A file's ids are cut into blocks; a block stores its minimum, the
differences packed at the width that a percentile of them needs, and a list of the exceptions
that need more bits. An index holds the start of each block, so any document can be read by
decoding only its blocks. Files are written and read in pieces, whatever their size.

File (little-endian): 8 bytes magic; blocks; doc_id i64[n_docs]; is_null u8[n_docs]; end u64[n_docs];
block start u64[n_blocks + 1]; tail: n_docs, n_ids, n_blocks, place of the doc_ids u64; block size u32; pad u32; 8 bytes magic.
Block: min u32, width u8, pad u8, n_exceptions u16; packed low bits; positions u16[]; high bits u32[].

Encoding: a probe tells whether the tokenizer gives the words between ASCII white space the same ids wherever they stand. If so, the
distinct words of a slice of texts are looked up in a bounded table and the library sees those that are new; words are told apart by
a 64-bit hash and their length. If not, the library sees whole texts.

Cases: null text counts as empty (one end id); a null doc_id is written first and read back as
null; equal doc_ids keep one entry each, ordered by a hash of the text, then the text, and may stand in several files; a very long text is encoded in pieces cut at
white space (whole where the probe fails); an empty table gives no files and no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import SPACE, slices, text_bytes, word_hashes, words
from ._shared import Store, caches, release, shared_dir, spread, stored

MAGIC = b"QYPFOR02"
TAIL = struct.Struct("<QQQQII8s")
BLOCK = 512
PERCENTILE = 0.9
IDS_PER_FILE = 1 << 24
#: Ids that are packed, unpacked or held at once.
PIECE = 1 << 18
#: Bytes of text encoded at once: what a task needs beside its batch grows with it.
SLICE = 1 << 19
CACHED_WORDS = 1 << 19
CACHED_RUNS = 1 << 16
#: Words of ASCII and Latin-1 letters without apostrophes and angle brackets, and the runs in them after lower-casing.
SIMPLE = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+")
#: How byte-level tokenizers write the bytes that are no printable Latin-1 characters: fixed values.
BYTE_LEVEL = {b: 256 + n for n, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
RUN = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of some ids; the last one is filled up with its last id."""
    n = len(ids)
    n_blocks = -(-n // block)
    padded = np.empty(n_blocks * block, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    rows = padded.reshape(n_blocks, block)
    low = rows.min(1) if n_blocks else np.zeros(0, np.uint32)
    rest = rows - low[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    at = min(block - 1, int(percentile * block))
    width = np.partition(bits, at, axis=1)[:, at] if n_blocks else np.zeros(0, np.uint8)
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        spread = np.unpackbits(rest[of].astype("<u4").view(np.uint8).reshape(len(of), block, 4), axis=2, bitorder="little")[:, :, :w]
        for k, row in zip(of.tolist(), np.packbits(spread.reshape(len(of), -1), axis=1, bitorder="little"), strict=True):
            packed[k] = row.tobytes()
    where, place = np.nonzero(bits > width[:, None])
    high = (rest[where, place].astype(np.uint64) >> width[where].astype(np.uint64)).astype("<u4")
    cut = np.searchsorted(where, np.arange(n_blocks + 1))
    place = place.astype("<u2")
    blocks = []
    for k in range(n_blocks):
        a, b = cut[k], cut[k + 1]
        blocks.append(struct.pack("<IBBH", int(low[k]), int(width[k]), 0, int(b - a)) + packed[k] + place[a:b].tobytes() + high[a:b].tobytes())
    return blocks


class TokenWriter:
    """Writes one file piece by piece; `file` is writable. Only ids that don't fill a piece yet are held."""

    def __init__(self, file, block: int = BLOCK, percentile: float = PERCENTILE) -> None:
        self.file, self.block, self.percentile = file, block, percentile
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.sizes = array("Q")
        self.doc_ids: list[int | None] = []
        self.ends: list[np.ndarray] = []
        file.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= PIECE:
            self._write(self.n_held - self.n_held % self.block)

    def end_documents(self, doc_ids: list[int | None], ends: np.ndarray) -> None:
        """Documents that end at these places of the file."""
        self.doc_ids += doc_ids
        self.ends.append(ends.astype("<u8"))

    def _write(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for k in range(0, n, PIECE // self.block * self.block):
            blocks = pack_blocks(ids[k : min(n, k + PIECE // self.block * self.block)], self.block, self.percentile)
            self.sizes.extend(map(len, blocks))
            self.file.write(b"".join(blocks))
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._write(self.n_held)
        starts = np.zeros(len(self.sizes) + 1, "<u8")
        np.cumsum(np.frombuffer(self.sizes, np.uint64) if len(self.sizes) else np.zeros(0, np.uint64), out=starts[1:])
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        for part in (np.array([d or 0 for d in self.doc_ids], "<i8"), null, *self.ends, starts):
            self.file.write(part.tobytes())
        self.file.write(TAIL.pack(len(self.doc_ids), self.n_ids, len(self.sizes), len(MAGIC) + int(starts[-1]), self.block, 0, MAGIC))


class TokenFile:
    """Reads one file; `file` is seekable. ids(a, b) decodes only the blocks that hold places a to b."""

    def __init__(self, file) -> None:
        self.file = file
        file.seek(0, os.SEEK_END)
        tail_at = file.tell() - TAIL.size
        file.seek(max(0, tail_at))
        raw = file.read(TAIL.size)
        if tail_at < len(MAGIC) or raw[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token-id file")
        n, self.n_ids, self.n_blocks, at, self.block, _, _ = TAIL.unpack(raw)
        file.seek(at)
        ids, null = np.frombuffer(file.read(8 * n), "<i8"), np.frombuffer(file.read(n), np.uint8)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.ends = np.frombuffer(file.read(8 * n), "<u8").astype(np.int64)
        self.starts = np.frombuffer(file.read(8 * (self.n_blocks + 1)), "<u8").astype(np.int64)

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = self.n_ids if b is None else b
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, -(-b // self.block)
        self.file.seek(len(MAGIC) + int(self.starts[first]))
        raw = np.frombuffer(self.file.read(int(self.starts[last] - self.starts[first])), np.uint8)
        at = self.starts[first:last] - self.starts[first]
        head = raw[at[:, None] + np.arange(8)]
        low, width, n_exc = head[:, :4].copy().view("<u4")[:, 0], head[:, 4].astype(np.int64), head[:, 6:8].copy().view("<u2")[:, 0].astype(np.int64)
        out = np.zeros((last - first, self.block), np.uint32)
        for w in np.unique(width[width > 0]).tolist():
            of = np.flatnonzero(width == w)
            for part in np.array_split(of, -(-len(of) // 256)):
                spread = np.unpackbits(raw[at[part, None] + 8 + np.arange(self.block * w // 8)], axis=1, bitorder="little").reshape(len(part), self.block, w)
                full = np.zeros((len(part), self.block, 4), np.uint8)
                full[:, :, : -(-w // 8)] = np.packbits(spread, axis=2, bitorder="little")
                out[part] = full.view("<u4")[:, :, 0]
        if n_exc.any():
            row = np.repeat(np.arange(last - first), n_exc)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
            body = at + 8 + self.block * width // 8
            place = raw[(body[row] + 2 * k)[:, None] + np.arange(2)].copy().view("<u2")[:, 0]
            high = raw[(body[row] + 2 * n_exc[row] + 4 * k)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
            out[row, place] |= (high.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
        out += low[:, None]
        return out.reshape(-1)[a - first * self.block : b - first * self.block]


class Runs(dict):
    """Ids of runs of characters, as bytes, by the tokenizer's model alone: such a run is left as it is by normalisation and splitting."""

    def __init__(self, tokenizer) -> None:
        self.model = tokenizer.model.tokenize

    def __missing__(self, run: str) -> bytes:
        text = run if run.isascii() else run.encode().decode("latin-1").translate(BYTE_LEVEL)
        if len(self) >= CACHED_RUNS:
            self.clear()
        self[run] = ids = array("I", [t.id for t in self.model(text)]).tobytes()
        return ids


class WordTable:
    """Ids of words: sorted hashes, and where each word's ids lie in a pool. The first entry of the pool is the end id."""

    def __init__(self, end_id: int) -> None:
        self.end_id = end_id
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.array([self.end_id], np.uint32)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted distinct keys: their entries, and whether they have one."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        return at, known

    def put(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """Enter new keys, sorted."""
        count = np.array([len(x) // 4 for x in ids], np.int32)
        begin = np.cumsum(count, dtype=np.int64) - count + len(self.pool)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.count = np.insert(self.keys, at, keys), np.insert(self.begin, at, begin), np.insert(self.count, at, count)
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), np.uint32)])


class Encoder:
    def __init__(self, path: str, end_id: int = 1) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], np.uint32)
        # Probes tell whether texts may be taken apart at white space, and words into runs.
        probe = " Zwölf  Àb,c12\n\nd'ef\tIt's  42 (x)\r\n\x0b\x0cŁódź ́e 漢字 かな  !? <b>  ĲΣΑΣ  x  y\n"
        self.by_word = list(self._ids([probe])[0]) == [x for w in probe.encode().split() for x in self._ids([w.decode()])[0]]
        probe = '"Zwölf,ÀB12c.."x-Éa!!7%%de(f)#g]{h}ÿ×àí'
        self.runs = Runs(self.tokenizer)
        self.simple = self.by_word and b"".join(self.runs[r] for r in RUN.findall(probe.lower())) == self._ids([probe])[0].tobytes()
        self.table = WordTable(end_id)
        caches.extend([self.runs, self.table])

    def _ids(self, texts: list[str]) -> list[array]:
        return [array("I", e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if self.simple and SIMPLE.fullmatch(text):
            return b"".join(map(self.runs.__getitem__, RUN.findall(text.lower())))
        return self._ids([text])[0].tobytes()

    def __call__(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of some texts in pieces, each with the places in it at which texts end."""
        for i, j in slices(at, SLICE):
            own, cut = data[at[i] : at[j]], at[i : j + 1] - at[i]
            if not self.by_word:
                got = [x for d in range(j - i) for x in (np.frombuffer(self._ids([own[cut[d] : cut[d + 1]].tobytes().decode()])[0], np.uint32), self.end)]
                yield np.concatenate(got), np.cumsum([len(x) for x in got])[1::2]
            elif len(own) <= 2 * SLICE:
                yield self._encode(own, cut, True)
            else:
                for piece in _at_spaces(own):
                    yield self._encode(piece, np.array([0, len(piece)]), False)
                yield self.end, np.ones(1, np.int64)

    def _encode(self, data: np.ndarray, at: np.ndarray, ends: bool) -> tuple[np.ndarray, np.ndarray]:
        starts, stops, first = words(data, at)
        table = self.table
        keys, where, of = np.unique(word_hashes(data, starts, stops), return_index=True, return_inverse=True)
        if len(table.keys) > CACHED_WORDS:
            table.clear()
        _, known = table.places(keys)
        if not known.all():
            some = where[~known]
            raw = data.tobytes()
            table.put(keys[~known], [self._word(raw[a:b]) for a, b in zip(starts[some].tolist(), stops[some].tolist(), strict=True)])
        entry, _ = table.places(keys)
        begin, count = table.begin[entry][of], table.count[entry][of]
        if ends:
            begin, count = np.insert(begin, first[1:], 0), np.insert(count, first[1:], 1)
        stop = np.cumsum(count, dtype=np.int64)
        ids = table.pool[np.repeat(begin - (stop - count), count) + np.arange(int(stop[-1]) if len(stop) else 0)]
        return ids, stop[first[1:] + np.arange(len(at) - 1)] if ends else np.zeros(0, np.int64)


def _at_spaces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about SLICE bytes that begin at white space."""
    a = 0
    while a < len(data):
        b = min(len(data), a + SLICE)
        while b < len(data):
            spaces = np.flatnonzero(SPACE[data[b : b + SLICE]])
            if len(spaces):
                b += int(spaces[0])
                break
            b = min(len(data), b + SLICE)
        yield data[a:b]
        a = b


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One for each Python worker. Tasks call this by name: a dictionary that their own code named would be a new one in each task."""
    return _encoders.get((path, end_id)) or _encoders.setdefault((path, end_id), Encoder(path, end_id))


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write all documents in ascending doc_id order to token-id files in `folder`.

    Returns one row per file: part (the range of doc_ids, ascending), nth (within it), file, n_docs, n_ids.
    The rows are made by the writing tasks: store them before using them twice.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt, store = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), Store(folder)
        encode = encoder(tokenizer_path, end_id)
        release(keep=(encode.runs, encode.table))
        nth, out, w = 0, None, None

        def flush() -> pa.RecordBatch:
            w.close()
            return pa.RecordBatch.from_pydict({"part": [part], "nth": [nth], "file": [out.done()], "n_docs": [len(w.doc_ids)], "n_ids": [w.n_ids]})

        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            doc_ids, k = batch.column("doc_id").to_pylist(), 0
            for ids, ends in encode(data, at):
                if w is None:
                    out = store.writer(f"part-{part:06d}-{nth:05d}-{attempt}.pfor")
                    w = TokenWriter(out)
                if len(ends):
                    w.end_documents(doc_ids[k : k + len(ends)], ends + w.n_ids)
                    k += len(ends)
                w.add(ids)
                if w.n_ids >= IDS_PER_FILE and len(ends):
                    yield flush()
                    nth, w = nth + 1, None
        if w is not None:
            yield flush()
        release(False)

    order = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", order).sortWithinPartitions("doc_id", order, "text")
    return ordered.mapInArrow(write, "part long, nth long, file string, n_docs long, n_ids long")


def file_starts(files: DataFrame) -> DataFrame:
    """Adds start, the number of ids in all files before. Sums run over parts first: the only window
    without a key sees one row per writing task."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids")).withColumn("base", F.coalesce(F.sum("ids").over(before(Window.orderBy("part"))), F.lit(0))).select("part", "base")
    inner = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("nth"))), F.lit(0))
    return files.withColumn("inner", inner).join(parts, "part").select("file", (F.col("base") + F.col("inner")).alias("start"))


def read_tokens(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents read back from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids. A file is decoded in pieces; a
    document longer than one is summed over several."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open(name) as f:
                    t = TokenFile(f)
                    begins = np.concatenate([[0], t.ends[:-1]]) if len(t.ends) else t.ends
                    i = 0
                    while i < len(t.ends):
                        j = max(i + 1, int(np.searchsorted(t.ends, begins[i] + PIECE, "right")))
                        a, b = int(begins[i]), int(t.ends[j - 1])
                        if j > i + 1 or b - a <= PIECE or with_ids:
                            ids = t.ids(a, b)
                            raw = memoryview(ids.astype("<u4").tobytes())
                            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip((begins[i:j] - a).tolist(), (t.ends[i:j] - a).tolist(), strict=True)]
                        else:
                            crc = [0]
                            for k in range(a, b, PIECE):
                                crc[0] = zlib.crc32(t.ids(k, min(b, k + PIECE)).astype("<u4").tobytes(), crc[0])
                        cols = [pa.array(t.doc_ids[i:j], pa.int64()), pa.array(begins[i:j] + base, pa.int64()), pa.array(t.ends[i:j] - begins[i:j], pa.int64()), pa.array(crc, pa.int64())]
                        if with_ids:
                            cols.append(pa.ListArray.from_arrays(pa.array(np.append(begins[i:j], b) - a, pa.int32()), pa.array(ids.astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                        i = j
        release(False)

    return spread(files).mapInArrow(read, schema)


def tokenise(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write all documents, then read the files back."""
    folder = shared_dir(spark, "tokens")
    files = stored(write_tokens(docs, folder, tokenizer_path, end_id), spark, "token-files")
    return read_tokens(file_starts(files), folder)
