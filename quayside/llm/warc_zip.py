"""WARC records in ZIP packages, read by range.

A package is a ZIP archive whose members are stored, not deflated: `archive/data.warc.gz`, the records one after another, each a
gzip member of its own, and `indexes/index.cdxj`, a line with offset and length for each. The reader looks for the end of the central directory (with ZIP64's,
where there is one), parses the directory, finds where a member's bytes begin, reads the index, and then reads just the records
asked for. Nothing is extracted.

Records with equal payloads of at least `min_bytes` bytes are written once: the one with the largest page_id is a response, the others
are revisits that refer to it. Equality is that of SHA-256 and length.

Cases: null html is an empty payload; a null page_id is written with an id of its own kind, read back as null, and
counts as smaller than any other; a very long payload is a package of its own, held whole by its task; rows with equal page_id and payload are one response and revisits of it;
an empty table gives no packages and no rows; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Store, shared_dir, spread, stored

PACKAGE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LOCAL, CENTRAL = struct.Struct("<IHHHHHIIIHH"), struct.Struct("<IHHHHHHIIIHHHHHII")
END, END64, LOCATOR = struct.Struct("<IHHHHIIH"), struct.Struct("<IQHHIIQQQQ"), struct.Struct("<IIQI")
MAX32, MAX16 = 0xFFFFFFFF, 0xFFFF


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A URN that holds the page_id."""
    return f"<urn:uuid:{uuid.UUID(int=(1 << 64) * (page_id is not None) + ((page_id or 0) & (1 << 64) - 1))}>"


def page_of(urn: str) -> int | None:
    x = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    low = x & ((1 << 64) - 1)
    return None if x >> 64 == 0 else low - (1 << 64) * (low >> 63)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def package(records: list[bytes], index: list[dict], zip64: bool = False) -> list[bytes]:
    """The parts of a ZIP archive of stored members. ZIP64 fields are written where sizes need them, or always if asked for."""
    members = [(DATA, records), (INDEX, ["".join(json.dumps(x) + "\n" for x in index).encode()])]
    out: list[bytes] = []
    central: list[bytes] = []
    at = 0
    for name, parts in members:
        crc, size = 0, 0
        for p in parts:
            crc, size = zlib.crc32(p, crc), size + len(p)
        wide = zip64 or max(size, at) >= MAX32
        short = MAX32 if wide else size
        n = name.encode()
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        out += [LOCAL.pack(0x04034B50, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(n), len(extra)), n, extra, *parts]
        extra_c = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        central += [CENTRAL.pack(0x02014B50, 45 if wide else 20, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(n), len(extra_c), 0, 0, 0, 0, MAX32 if wide else at), n, extra_c]
        at += LOCAL.size + len(n) + len(extra) + size
    length = sum(map(len, central))
    wide = zip64 or at + length >= MAX32
    if wide:
        central += [END64.pack(0x06064B50, END64.size - 12, 45, 45, 0, 0, len(members), len(members), length, at), LOCATOR.pack(0x07064B50, 0, at + length, 1)]
    return [*out, *central, END.pack(0x06054B50, 0, 0, MAX16 if wide else len(members), MAX16 if wide else len(members), MAX32 if wide else length, MAX32 if wide else at, 0)]


class Package:
    """Reads a ZIP archive of stored members from a seekable file."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size
        self.members = dict(self._directory())

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def _directory(self) -> Iterator[tuple[str, tuple[int, int, int]]]:
        tail_at = max(0, self.size - END.size - MAX16)
        tail = self._at(tail_at, self.size - tail_at)
        k = tail.rfind(b"PK\x05\x06")
        while k >= 0 and k + END.size + struct.unpack_from("<H", tail, k + 20)[0] != len(tail):
            k = tail.rfind(b"PK\x05\x06", 0, k)  # the bytes of a comment
        if k < 0:
            raise ValueError("not a ZIP archive")
        _, _, _, _, count, length, offset, _ = END.unpack_from(tail, k)
        if MAX16 == count or MAX32 in (length, offset):
            where = LOCATOR.unpack(self._at(tail_at + k - LOCATOR.size, LOCATOR.size))
            if where[0] == 0x07064B50:
                _, _, _, _, _, _, _, count, length, offset = END64.unpack(self._at(where[2], END64.size))
        raw, p = self._at(offset, length), 0
        for _ in range(count):
            sign, _, _, flags, method, _, _, crc, packed, size, n, m, c, _, _, _, local = CENTRAL.unpack_from(raw, p)
            if sign != 0x02014B50:
                raise ValueError("bad central directory")
            name = raw[p + CENTRAL.size : p + CENTRAL.size + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[p + CENTRAL.size + n : p + CENTRAL.size + n + m]
            while len(extra) >= 4:
                kind, of = struct.unpack_from("<HH", extra)
                if kind == 1:
                    wide = iter(struct.unpack(f"<{of // 8}Q", extra[4 : 4 + of // 8 * 8]))
                    size, packed, local = (next(wide) if x == MAX32 else x for x in (size, packed, local))
                extra = extra[4 + of :]
            p += CENTRAL.size + n + m + c
            yield name, (local, packed, method)

    def range(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """Bytes of a stored member."""
        local, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        head = LOCAL.unpack(self._at(local, LOCAL.size))
        length = size - offset if length is None else length
        if head[0] != 0x04034B50 or offset < 0 or offset + length > size:
            raise ValueError(f"bad range of {name}")
        return self._at(local + LOCAL.size + head[9] + head[10] + offset, length)

    def index(self) -> list[dict]:
        return [json.loads(x) for x in self.range(INDEX).decode().split("\n") if x]


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def planned(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to, revisit. Only digests of payloads that occur twice or more are joined back; a join that
    one payload makes uneven is split by Spark, for it has nothing but a shuffle on either side."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    key = F.struct(F.octet_length("html").alias("n"), F.sha2("html", 256).alias("h"))
    keyed = rows.filter(F.octet_length("html") >= min_bytes).select(key.alias("_k"), "page_id")
    groups = keyed.groupBy("_k").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    found = rows.withColumn("_key", key).join(groups, F.col("_key") == F.col("_k"), "left")
    return found.select("page_id", "url", "html", F.col("_first").alias("refers_to"), (F.col("_k").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))).alias("revisit"), F.col("_k").isNotNull().alias("_shared"))


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Write all pages; a row (file, n_records) for each package, made by the writing tasks."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, part, attempt = Store(folder), TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        records, index, at, nth = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            name = store.publish(f"part-{part:06d}-{nth:05d}-{attempt}.wacz", package(records, index, zip64))
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": [len(index)]})

        for b in batches:
            for p, url, html, refers, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True):
                raw = gzip.compress(record(p, url, html.encode(), refers, revisit), 4, mtime=0)
                records.append(raw)
                index.append({"url": url, "offset": at, "length": len(raw)})
                at += len(raw)
                if at >= package_bytes:
                    yield flush()
                    records, index, at, nth = [], [], 0, nth + 1
        if index:
            yield flush()

    plan = planned(pages, min_bytes)
    # Of rows that agree in page_id and payload, one is the response. They are numbered, if there are any.
    twins = pages.groupBy("page_id", F.sha2(F.coalesce(F.col("html"), F.lit("")), 256)).count().filter("count > 1")
    if not twins.isEmpty():
        nth = F.row_number().over(Window.partitionBy("page_id", F.sha2("html", 256), "_shared").orderBy("url"))
        plan = plan.withColumn("revisit", F.col("revisit") | (F.col("_shared") & (nth > 1)))
    return plan.select("page_id", "url", "html", "refers_to", "revisit").mapInArrow(write, "file string, n_records long")


def read_packages(files: DataFrame, folder: str) -> DataFrame:
    """All records of the packages, each read by its range: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for b in batches:
            for name in b.column("file").to_pylist():
                with store.open(name) as f:
                    zipped = Package(f, store.size(name))
                    rows = []
                    for x in zipped.index():
                        fields, http, payload = parse(gzip.decompress(zipped.range(DATA, x["offset"], x["length"])))
                        revisit = fields["WARC-Type"] == "revisit"
                        known = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and digest(payload) != known:
                            raise ValueError(f"{name}: a payload does not match its digest")
                        rows.append((page_of(fields["WARC-Record-ID"]), x["url"], int(http["Content-Length"]), known, fields["WARC-Type"], page_of(fields["WARC-Refers-To"]) if revisit else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spread(files).mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to packages, then read the packages back."""
    folder = shared_dir(spark, "warc")
    files = stored(write_packages(pages, folder, min_bytes), spark, "warc-files")
    return read_packages(files, folder)
