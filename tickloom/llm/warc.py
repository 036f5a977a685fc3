"""WARC in seekable Zstandard bundles (operator 7).

Writing: a payload's SHA-1 decides response or revisit (of equal payloads of MIN_REVISIT bytes or more, the largest
page_id is the response). Records are grouped into frames of about FRAME_BYTES, each an independent Zstandard frame;
about BUNDLE_BYTES of frames make a bundle, ended by the seek table of the seekable format in a skippable frame. A
bundle is one row (bundle, archive, index), where index maps a record's URN to its frame and the offset in it. Bundles
are written as a Parquet table in the shared folder, by Spark's commit protocol: a lost executor's task runs again and
nothing half-written is seen.

Reading: a bundle's footer gives the frames; ``read_archives`` decompresses all of them, ``read_record`` only the one
that the index names.

Equal payloads are grouped by digest with partial aggregation; only (digest, page_id) goes there. Digests that occur
more than once come back by a join that may be skewed, which adaptive execution splits; a bundle's rows never depend
on which records share a task.

Null html is an empty payload. Null page_ids sort first; rows that tie for the largest page_id are all responses.
Repeated rows are records of their own. Empty tables give no bundle and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, stash

MIN_REVISIT = 1000
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 16 << 20
LEVEL = 3
DATE = "2020-01-01T00:00:00Z"
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
BUNDLE_SCHEMA = "bundle string, archive binary, index array<struct<record: string, frame: int, offset: long, bytes: long>>"


def _urn(page_id) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def record(page_id, url, payload: bytes, refers_to, revisit: bool) -> bytes:
    """A WARC/1.1 record; a revisit carries the digest and length of the payload, not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_urn(page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_urn(refers_to)}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes):
    """(headers, block) of each record of a frame."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:stop].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        size = int(headers["Content-Length"])
        yield headers, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame of the seekable format: (compressed, decompressed) bytes of each frame, then the footer."""
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def frames_of(archive: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", archive[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    at, out = 0, []
    for c, d in struct.iter_unpack("<II", archive[-9 - 8 * n : -9]):
        out.append((at, c, d))
        at += c
    return out


def read_frame(archive: bytes, frame: tuple[int, int, int]) -> bytes:
    at, c, d = frame
    return zstandard.ZstdDecompressor().decompress(archive[at : at + c], max_output_size=max(d, 1))


def read_record(archive: bytes, index: list[dict], urn: str) -> tuple[dict, bytes]:
    """One record by its URN, decompressing one frame only."""
    entry = next(x for x in index if x["record"] == urn)
    data = read_frame(archive, frames_of(archive)[entry["frame"]])
    return next(parse_records(data[entry["offset"] : entry["offset"] + entry["bytes"]]))


class _Bundle:
    def __init__(self):
        self.frames, self.sizes, self.index, self.open, self.open_bytes, self.total = [], [], [], [], 0, 0

    def add(self, urn: str, data: bytes) -> None:
        self.index.append({"record": urn, "frame": len(self.frames), "offset": self.open_bytes, "bytes": len(data)})
        self.open.append(data)
        self.open_bytes += len(data)
        if self.open_bytes >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(self.open))
            self.sizes.append((len(packed), self.open_bytes))
            self.frames.append(packed)
            self.total += len(packed)
            self.open, self.open_bytes = [], 0

    def archive(self) -> bytes:
        self.close_frame()
        return b"".join(self.frames) + seek_table(self.sizes)


def _write_batches(it):
    part, n, bundle = TaskContext.get().partitionId(), 0, _Bundle()
    schema = pa.schema([("bundle", pa.string()), ("archive", pa.binary()), ("index", pa.list_(pa.struct([("record", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("bytes", pa.int64())])))])

    def done(b):
        return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:06d}"]), pa.array([b.archive()], pa.binary()), pa.array([b.index], schema.field(2).type)], schema=schema)

    for batch in it:
        for page_id, url, html, refers, revisit in zip(*(c.to_pylist() for c in batch.columns)):
            bundle.add(_urn(page_id), record(page_id, url, html, refers, revisit))
            if bundle.total >= BUNDLE_BYTES:
                yield done(bundle)
                n, bundle = n + 1, _Bundle()
    if bundle.index:
        yield done(bundle)


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _number(urn: str):
    text = urn.strip("<>").rpartition(":")[2]
    return int(text) if text else None


def _read_batches(it):
    for batch in it:
        for archive in batch.column(0).to_pylist():
            for frame in frames_of(archive):
                rows = []
                for h, block in parse_records(read_frame(archive, frame)):
                    http, _, body = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest, kind = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")), h["WARC-Type"]
                    if kind == "response" and (len(body) != size or hashlib.sha1(body).digest() != digest):
                        raise ValueError(f"{h['WARC-Record-ID']}: damaged payload")
                    rows.append((_number(h["WARC-Record-ID"]), size, digest.hex(), kind, _number(h["WARC-Refers-To"]) if kind == "revisit" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def write_archives(pages: DataFrame) -> DataFrame:
    """The writing operator: the table of bundles, written in the shared folder."""
    df = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    df = df.withColumn("_digest", F.when(F.octet_length("html") >= MIN_REVISIT, F.sha1("html")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    groups = df.where(F.octet_length("html") >= MIN_REVISIT).groupBy("_digest").agg(F.max("page_id").alias("_response"), F.count("*").alias("_n")).where("_n > 1")
    df = df.join(groups, "_digest", "left")
    revisit = F.col("_n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_response"))
    df = df.select("page_id", "url", "html", F.when(revisit, F.col("_response")).alias("refers_to"), revisit.alias("revisit"))
    return stash(batches(df).mapInArrow(_write_batches, BUNDLE_SCHEMA), "warc-bundles")


def read_archives(bundles: DataFrame) -> DataFrame:
    """The reading operator: one row a record, with payload digests verified against the payloads read."""
    return batches(bundles.select("archive")).mapInArrow(_read_batches, READ_SCHEMA)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))


#: DuckDB SQL for op7_warc.
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM g
"""
