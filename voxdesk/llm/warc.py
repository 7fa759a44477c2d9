"""WARC records in seekable Zstandard bundles.

A bundle is a row whose `content` is a complete file in the public seekable
format: independent frames, then a seek table in a skippable frame at the end. A
frame holds several records; `entries` maps a record to its frame and its offset
inside the decompressed frame, so one record is read by decompressing one frame.
"""

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxdesk.llm.common import Scratch, as_bytes, fresh

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

#: Payload classes of more than one record that are sent to every task at once.
BROADCAST_ROWS = 100_000

BUNDLE_TYPE = (
    "bundle string, content binary, entries array<struct<page_id: bigint, record: string, frame: int, "
    "offset: bigint, length: bigint>>"
)
ENTRY = pa.struct([("page_id", pa.int64()), ("record", pa.string()), ("frame", pa.int32()),
                   ("offset", pa.int64()), ("length", pa.int64())])
RECORD_TYPE = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
    "target_uri string, payload_ok boolean"
)


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(name: str, page_id: int | None, uri: str | None, payload: bytes, first: int | None) -> bytes:
    """One WARC/1.1 record; a revisit of record `first` has headers only."""
    kind = "response" if first is None else "revisit"
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: <urn:record:" + name.encode() + b">",
        b"WARC-Date: " + DATE.encode(),
        b"WARC-Payload-Digest: sha1:" + digest_of(payload).encode(),
        b"X-Payload-Length: %d" % len(payload),
    ]
    if page_id is not None:
        head.append(b"X-Page-ID: %d" % page_id)
    if uri is not None:
        head.append(b"WARC-Target-URI: " + uri.encode().replace(b"%", b"%25").replace(b"\r", b"%0D").replace(b"\n", b"%0A"))
    if first is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 b"X-Refers-To-Page-ID: %d" % first]
        payload = b""
    head += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    return b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict, bytes]:
    """(headers, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(b": ", 1) for line in lines[1:])
    return fields, rest[: int(fields[b"Content-Length"])]


class BundleWriter:
    """Collects records into frames and frames into one seekable file."""

    def __init__(self, name: str):
        self.name, self.packer = name, zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.entries: list[dict] = []
        self.open, self.open_bytes, self.bytes = [], 0, 0

    def add(self, page_id: int | None, record: str, data: bytes) -> None:
        self.entries.append({"page_id": page_id, "record": record, "frame": len(self.frames),
                             "offset": self.open_bytes, "length": len(data)})
        self.open.append(data)
        self.open_bytes += len(data)
        if self.open_bytes >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        packed = self.packer.compress(b"".join(self.open))
        self.frames.append(packed)
        self.sizes.append((len(packed), self.open_bytes))
        self.bytes += self.open_bytes
        self.open, self.open_bytes = [], 0

    def finish(self) -> pa.RecordBatch:
        if self.open:
            self._close_frame()
        table = b"".join(struct.pack("<II", *size) for size in self.sizes)
        table += struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        content = b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table
        return pa.RecordBatch.from_arrays(
            [pa.array([self.name]), pa.array([content], pa.binary()), pa.array([self.entries], pa.list_(ENTRY))],
            names=["bundle", "content", "entries"],
        )


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed length, length) of each frame, from the file's footer."""
    count, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    sizes = np.frombuffer(content[-9 - 8 * count : -9], "<u4").reshape(-1, 2).astype(np.int64)
    ends = np.cumsum(sizes[:, 0])
    return [(int(e - s), int(s), int(n)) for e, (s, n) in zip(ends, sizes, strict=True)]


def read_frame(content: bytes, frame: tuple[int, int, int]) -> bytes:
    start, packed, length = frame
    return zstandard.ZstdDecompressor().decompress(content[start : start + packed], max_output_size=length)


def read_record(content: bytes, frame: int, offset: int, length: int) -> tuple[dict, bytes]:
    """One record by its place, decompressing its frame alone."""
    return parse_record(read_frame(content, seek_table(content)[frame])[offset : offset + length])


def first_pages(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(digest, bytes, first) of the payloads that several pages have; first is the smallest page id."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    own = pages.select(F.col(id_col).alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    classes = own.groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    return classes.where("n > 1 AND first IS NOT NULL").select("digest", "bytes", "first")


def write_bundles(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """A record for every row of pages, in bundles written to the shared folder.

    The payload is the html in UTF-8, empty for null. Of records with equal
    payloads the one with the smallest page id is a response and those with
    larger ones revisit it; repeated rows of the smallest id are all responses.
    A row without an id revisits if any row of its payload has one. A null url
    gives a record without a target. No rows give no bundles.
    """
    digest, size, first = fresh(pages, "digest", "bytes", "first")
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    shared = scratch.store(first_pages(pages, id_col, html_col), "shared")
    shared = shared.toDF(digest, size, first)
    if shared.count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    rows = pages.withColumns({digest: F.sha1(payload), size: F.octet_length(payload)})
    named = rows.join(shared, [digest, size], "left").select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"),
        F.col(html_col).alias("html"), F.col(first).cast("bigint").alias("first"),
    )

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, count = TaskContext.get().partitionId(), 0, 0
        writer = BundleWriter(f"{task}-{made}")
        for batch in batches:
            columns = batch.column(0), batch.column(1), batch.column(3)
            for page, url, least, html in zip(*(c.to_pylist() for c in columns), as_bytes(batch.column(2)), strict=True):
                name = f"{task}-{count}"
                count += 1
                old = least if least is not None and (page is None or page > least) else None
                writer.add(page, name, record_bytes(name, page, url, html or b"", old))
                if writer.bytes >= BUNDLE_BYTES:
                    yield writer.finish()
                    made += 1
                    writer = BundleWriter(f"{task}-{made}")
        if writer.entries:
            yield writer.finish()

    return scratch.store(named.mapInArrow(bundles, BUNDLE_TYPE), "bundles")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """A row for every record in the bundles, read through seek tables and entries.

    payload_ok tells whether a response's payload has the digest and the length
    its headers state, and a revisit none.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                frames, at, data, out = seek_table(content), None, b"", []
                for e in entries:
                    if e["frame"] != at:
                        at = e["frame"]
                        data = read_frame(content, frames[at])
                    out.append(_row(*parse_record(data[e["offset"] : e["offset"] + e["length"]])))
                yield pa.RecordBatch.from_pylist(out, schema=_ROW)

    return bundles.select("content", "entries").mapInArrow(records, RECORD_TYPE)


_ROW = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload_ok", pa.bool_()),
])


def _row(fields: dict, payload: bytes) -> dict:
    number = lambda key: int(fields[key]) if key in fields else None
    kind = fields[b"WARC-Type"].decode()
    digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    stated, uri = number(b"X-Payload-Length"), fields.get(b"WARC-Target-URI")
    if kind == "response":
        ok = len(payload) == stated and digest_of(payload) == digest
    else:
        ok = not payload
    if uri is not None:
        uri = uri.replace(b"%0A", b"\n").replace(b"%0D", b"\r").replace(b"%25", b"%").decode()
    return {
        "page_id": number(b"X-Page-ID"),
        "payload_bytes": len(payload) if kind == "response" else stated,
        "payload_digest": digest_of(payload) if kind == "response" else digest,
        "record_type": kind, "refers_to": number(b"X-Refers-To-Page-ID"), "target_uri": uri, "payload_ok": ok,
    }
