"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is its frames one after the other and, at its end, a
seek table in a skippable frame (the public "seekable format": sizes of every frame, compressed and not). An index maps
each record's id to (bundle, frame, offset in the frame, length), so that one record is read by decompressing one frame.

Bundles are rows with a binary column, written by Spark's own Parquet writer: the archives lie wherever the cluster's
file system is, and executors need no other access to it. Each task writes the records that it reads in bundles of
bounded size.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_folder

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

BUNDLE_SCHEMA = "bundle_id string, archive binary, records array<struct<record_id:string, frame:int, offset:long, length:long>>"


class BundleWriter:
    """Collects records into frames and frames into one bundle."""

    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.zip = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[bytes, int]] = []
        self.held, self.held_bytes, self.records, self.size = [], 0, [], 0

    def add(self, record_id: str, record: bytes) -> None:
        if self.held and self.held_bytes + len(record) > self.frame_bytes:
            self.flush()
        self.records.append({"record_id": record_id, "frame": len(self.frames), "offset": self.held_bytes, "length": len(record)})
        self.held.append(record)
        self.held_bytes += len(record)

    def flush(self) -> None:
        if self.held:
            packed = self.zip.compress(b"".join(self.held))
            self.frames.append((packed, self.held_bytes))
            self.size += len(packed)
            self.held, self.held_bytes = [], 0

    def bytes(self) -> bytes:
        self.flush()
        table = b"".join(struct.pack("<II", len(packed), plain) for packed, plain in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        return b"".join(packed for packed, _ in self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer


class BundleReader:
    """Frames of a bundle by number, found through the seek table at its end."""

    def __init__(self, archive: bytes):
        n, flags, magic = struct.unpack_from("<IBI", archive, len(archive) - 9)
        if magic != SEEKABLE_MAGIC or flags & 0x7F:
            raise ValueError("no seek table at the end of this archive")
        entry = 12 if flags & 0x80 else 8
        at = len(archive) - 9 - n * entry
        if struct.unpack_from("<II", archive, at - 8) != (SKIPPABLE_MAGIC, n * entry + 9):
            raise ValueError("the seek table is damaged")
        self.archive, self.starts, place = memoryview(archive), [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", archive, at + k * entry)
            self.starts.append((place, packed, plain))
            place += packed
        self.unzip = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        place, packed, plain = self.starts[k]
        return self.unzip.decompress(bytes(self.archive[place : place + packed]), max_output_size=max(plain, 1))

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def warc_record(page_id: int, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """A response, or (with ``refers_to``) a revisit: its block keeps the HTTP head, whose length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join(' ' if c in chr(13) + chr(10) else c for c in url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, dict[str, str], bytes]:
    """(WARC headers, HTTP head, HTTP headers, payload) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return warc, http, headers, payload


def decide(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Pages with payload (binary), size, digest and refers_to (the largest page_id of equal payloads, else null).

    Only digests that occur again are joined back: counted with map-side combining, and a digest that a third of
    the pages share is a single row on the right, so adaptive execution may split the left side.
    """
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    base = base.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    again = base.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "last")
    joined = base.join(again, (F.col("digest") == F.col("d")) & (F.col("size") >= least_bytes), "left")
    return joined.select("page_id", "url", "payload", "size", "digest", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, frame_bytes: int = 256 << 10, bundle_bytes: int = 8 << 20, level: int = 3) -> None:
    """Write all pages as bundles to ``path``.

    A null html is an empty payload; a null page_id is written as record ``None`` and read back as null; repeated
    page_ids give a record each (equal payloads under one page_id are both responses). A record longer than a frame
    gets a frame of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, bundle = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes, level)
        schema = pa.schema([("bundle_id", pa.string()), ("archive", pa.binary()), ("records", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))])

        def done() -> pa.RecordBatch:
            nonlocal n, bundle
            out = pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{n:06d}"]), pa.array([bundle.bytes()], pa.binary()), pa.array([bundle.records], schema.field("records").type)], schema=schema)
            n, bundle = n + 1, BundleWriter(frame_bytes, level)
            return out

        for b in batches:
            columns = [b.column(k) for k in range(b.num_columns)]
            for i in range(b.num_rows):
                page_id, url, payload, size, digest, refers_to = (c[i].as_py() for c in columns)
                bundle.add(str(page_id), warc_record(page_id, url, payload, size, digest, refers_to))
                if bundle.size >= bundle_bytes:
                    yield done()
        if bundle.records:
            yield done()

    decide(pages, least_bytes).select("page_id", "url", "payload", "size", "digest", "refers_to").mapInArrow(run, BUNDLE_SCHEMA).write.parquet(path)


def index(spark, path: str) -> DataFrame:
    """Where each record lies: record_id, bundle_id, frame, offset, length."""
    return spark.read.schema(BUNDLE_SCHEMA).parquet(path).select("bundle_id", F.explode("records").alias("r")).select("r.record_id", "bundle_id", "r.frame", "r.offset", "r.length")


def read_archives(spark, path: str) -> DataFrame:
    """Every record, read through the index: page_id, payload_bytes, payload_digest, record_type, refers_to, stored_bytes.

    A response's payload is hashed again and must give the digest in its head.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: None if urn is None or "None" in urn else int(urn[len("<urn:page:") : -1])
        for b in batches:
            for i in range(b.num_rows):
                reader, rows, at, frame = BundleReader(b.column(1)[i].as_py()), [], -1, b""
                for r in b.column(2)[i].as_py():
                    if r["frame"] != at:
                        at, frame = r["frame"], reader.frame(r["frame"])
                    warc, _, http, payload = parse_record(frame[r["offset"] : r["offset"] + r["length"]])
                    digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if warc["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"record {r['record_id']} is damaged")
                    rows.append((number(warc["WARC-Record-ID"]), int(http["Content-Length"]), digest, warc["WARC-Type"], number(warc.get("WARC-Refers-To")), len(payload)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stored_bytes"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, stored_bytes long"
    return spark.read.schema(BUNDLE_SCHEMA).parquet(path).select("bundle_id", "archive", "records").mapInArrow(run, schema)


def archive_path(spark) -> str:
    """A fresh place for archives in the shared folder."""
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
