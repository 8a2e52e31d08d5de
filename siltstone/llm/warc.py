"""WARC archives as seekable Zstandard bundles.

A bundle is one archive: records grouped into independent Zstandard frames of about FRAME bytes, then a
skippable frame with the seek table (compressed and plain size of each frame) as its footer. Any
Zstandard reader can expand a bundle whole; a reader with the footer expands one frame alone. Beside
its bytes, a bundle carries the map from record identifiers to (frame, offset within the frame,
length). Bundles are rows with a binary column, written by Spark's own writer to the shared folder, so
no task touches a file system and a lost task is simply run again; `export` gives their bytes a name.

Records follow WARC/1.1. Of records whose payloads are equal and have at least MIN_REVISIT bytes, the
one with the largest identifier is a response and the others are revisits (identical payload digest)
without a body; smaller payloads are always responses.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import map_arrow, stage

MIN_REVISIT = 1000
FRAME = 1 << 20
BUNDLE = 16 << 20
LEVEL = 3
#: Revisit rows (24 bytes each) that may be broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 250_000

# Fixed values of the seekable format and of WARC.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLE_SCHEMA = "data binary, ids array<long>, frames array<int>, offsets array<long>, lengths array<long>"
RECORD_SCHEMA = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string,"
    " refers_to long, bundle long, frame int, offset long, length long"
)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; with refers_to it is a revisit without a body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url.translate(_LINE_BREAKS)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


_LINE_BREAKS = {10: "%0A", 13: "%0D"}


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC header, HTTP head, HTTP body) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    header = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(header["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return header, http, body


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", c, d) for c, d in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC or flags & 0x7C:
        raise ValueError("no seek table at the end of the bundle")
    width = 12 if flags & 0x80 else 8
    table = data[len(data) - 9 - n * width : len(data) - 9]
    found, at = [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", table, i * width)
        found.append((at, c, d))
        at += c
    return found


def read_at(data: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record by its frame and place there; no other frame is expanded."""
    start, size, _ = read_seek_table(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[start : start + size])[offset : offset + length]


class _Bundle:
    def __init__(self, frame_bytes: int, level: int):
        self.zip = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frame_bytes = frame_bytes
        self.parts: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.plain = self.total = 0
        self.ids, self.frames, self.offsets, self.lengths = [], [], [], []

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.ids.append(page_id)
        self.frames.append(len(self.sizes))
        self.offsets.append(self.plain)
        self.lengths.append(len(raw))
        self.open.append(raw)
        self.plain += len(raw)
        self.total += len(raw)
        if self.plain >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.open:
            packed = self.zip.compress(b"".join(self.open))
            self.parts.append(packed)
            self.sizes.append((len(packed), self.plain))
            self.open, self.plain = [], 0

    def row(self) -> pa.RecordBatch:
        self._close()
        data = b"".join(self.parts) + seek_table(self.sizes)
        columns = [
            pa.array([data], pa.binary()),
            pa.array([self.ids], pa.list_(pa.int64())),
            pa.array([self.frames], pa.list_(pa.int32())),
            pa.array([self.offsets], pa.list_(pa.int64())),
            pa.array([self.lengths], pa.list_(pa.int64())),
        ]
        return pa.record_batch(columns, ["data", "ids", "frames", "offsets", "lengths"])


def _packer(frame_bytes: int, bundle_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = _Bundle(frame_bytes, level)
        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                bundle.add(page_id, record(page_id, url, payload, digest, refers))
                if bundle.total >= bundle_bytes:
                    yield bundle.row()
                    bundle = _Bundle(frame_bytes, level)
        if bundle.ids:
            yield bundle.row()

    return run


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pages (page_id, url, html) as id, url, payload, digest (SHA-1 hex), refers_to (null for responses).

    Equality of payloads is that of their SHA-256. Only keys and digests are shuffled to find revisits;
    their rows come back by a broadcast if a count has shown them to be few, else by a join. With
    repeated identifiers one of the rows stays the response: it is the identifier that decides, so rows
    that share the largest one are all responses. Null identifiers are always responses.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("same", F.when(F.length("payload") >= min_bytes, F.unhex(F.sha2("payload", 256))))
    keys = stage(rows.select("id", "same").where(F.col("same").isNotNull()), "payloads")
    groups = keys.groupBy("same").agg(F.max("id").alias("top"), F.min("id").alias("low"))
    repeated = groups.where(F.col("low") < F.col("top")).select("same", "top")
    revisits = keys.join(repeated, "same").where(F.col("id") < F.col("top")).distinct()
    revisits = stage(revisits.select(F.col("id").alias("rid"), F.col("same").alias("rsame"), "top"), "revisits")
    if revisits.count() <= broadcast_rows:
        revisits = F.broadcast(revisits)
    # An identifier may stand for several payloads, so the payload is part of the key.
    joined = rows.join(revisits, (F.col("id") == F.col("rid")) & (F.col("same") == F.col("rsame")), "left")
    return joined.select("id", "url", "payload", F.sha1("payload").alias("digest"), F.col("top").alias("refers_to"))


def write_bundles(
    pages: DataFrame, frame_bytes: int = FRAME, bundle_bytes: int = BUNDLE, level: int = LEVEL
) -> DataFrame:
    """Archives of all pages, written to the shared folder: one row per bundle (BUNDLE_SCHEMA)."""
    packed = map_arrow(with_revisits(pages), _packer(frame_bytes, bundle_bytes, level), BUNDLE_SCHEMA)
    return stage(packed, "bundles")


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, data, ids, frames, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                table, unzip = read_seek_table(data), zstandard.ZstdDecompressor()
                rows: list[tuple] = []
                opened, plain, held = None, b"", 0
                for page_id, frame, offset, length in zip(ids, frames, offsets, lengths):
                    if frame != opened:
                        start, size, _ = table[frame]
                        opened, plain = frame, unzip.decompress(data[start : start + size])
                    header, http, body = parse_record(plain[offset : offset + length])
                    rows.append(_row(page_id, header, http, body, with_payload) + (bundle, frame, offset, length))
                    held += len(body) if with_payload else 200
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _row(page_id: int | None, header: dict[str, str], http: bytes, body: bytes, with_payload: bool) -> tuple:
    kind, digest = header["WARC-Type"], header["WARC-Payload-Digest"].removeprefix("sha1:")
    refers = None
    full = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    if header["WARC-Record-ID"] != f"<urn:page:{'' if page_id is None else page_id}>":
        raise ValueError(f"record {page_id} is not where its index says")
    if kind == "revisit":
        refers = int(header["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">"))
    elif hashlib.sha1(body).hexdigest() != digest or len(body) != full:
        raise ValueError(f"record {page_id} does not match its digest")
    return page_id, header.get("WARC-Target-URI"), body if with_payload else None, full, digest, kind, refers


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    kinds += [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_bundles(bundles: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of every bundle (RECORD_SCHEMA), its digest checked; revisits have an empty payload."""
    rows = bundles.select(F.xxhash64("data").alias("bundle"), "data", "ids", "frames", "offsets", "lengths")
    return map_arrow(rows, _reader(with_payload), RECORD_SCHEMA)


def export(bundles: DataFrame, folder: str) -> list[str]:
    """Writes bundles one by one as .warc.zst files to a folder of the driver; for small archives."""
    import os

    names = []
    for i, row in enumerate(bundles.select("data").toLocalIterator()):
        names.append(os.path.join(folder, f"bundle-{i:05d}.warc.zst"))
        with open(names[-1], "wb") as f:
            f.write(row.data)
    return names


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as bundles and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, a null url leaves out the target, a null page_id is kept as null.
    Repeated rows give repeated records. An empty table gives no rows. Other columns are ignored.
    """
    read = read_bundles(write_bundles(pages), with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
         max(page_id) OVER (PARTITION BY html) AS top FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""
