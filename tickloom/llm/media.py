"""Media columns (operator 8): MPEG audio streams as binary columns.

``encode`` stores bytes losslessly as an MPEG-1 Layer III stream: an ID3v2 tag that tells the payload's length, a
frame with a variable-bitrate table (frame count, byte count, 100 seek points), then frames whose side information
declares no audio data, so that the payload fills what the standard leaves to ancillary data. Full frames have the
highest bit rate and the last one the lowest that holds the rest. Each frame has its CRC-16.

``parse`` reads any MPEG-1, 2 or 2.5 stream of layers I to III: it skips ID3v2 and ID3v1 tags, walks frame headers,
resynchronises after damage (a header counts if another header or the end follows its frame), reads the
variable-bitrate table, verifies the CRC of Layer I and III frames that have one, and returns exact durations (samples over
rate) and every frame's byte offset.

``to_media`` writes the streams as a table with a binary column in the shared folder, and what is read back from there is
parsed: no shuffle. A null text is empty and is stored as 192 spaces; repeated rows are stored one by one; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, stash, texts

UNIT = 192
# Fixed values of the MPEG audio standards: kilobits a second by header index, and sampling rates.
_RATES_1 = {1: [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448], 2: [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384], 3: [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]}
_RATES_2 = {1: [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256], 2: [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160], 3: [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}
_HERTZ = [44100, 48000, 32000]

HERTZ = 48000
SIDE = 17  # side information of a mono frame
HEAD = 4 + 2 + SIDE


def crc16(data: bytes) -> int:
    """The standard's CRC: polynomial 0x8005, first value 0xFFFF, high bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def header(data: bytes, at: int) -> tuple | None:
    """(frame bytes, samples, hertz, layer, mono, has CRC, MPEG-1, kilobits) of the header at a place, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b, c, d = data[at + 1], data[at + 2], data[at + 3]
    version, layer = b >> 3 & 3, 4 - (b >> 1 & 3)
    rate, hertz = c >> 4, c >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3:
        return None
    one = version == 3
    kbit = (_RATES_1 if one else _RATES_2)[layer][rate - 1]
    hz = _HERTZ[hertz] >> (0 if one else 1 if version == 2 else 2)
    samples = 384 if layer == 1 else 576 if layer == 3 and not one else 1152
    padding = c >> 1 & 1
    size = (12 * kbit * 1000 // hz + padding) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hz + padding
    return size, samples, hz, layer, d >> 6 == 3, not b & 1, one, kbit


def _head(kbit: int) -> bytes:
    """Header, CRC and empty side information of a mono Layer III frame."""
    first = bytes([0xFF, 0xFA, _RATES_1[3].index(kbit) + 1 << 4 | 1 << 2, 0xC0])
    side = bytes(SIDE)
    return first + crc16(first[2:] + side).to_bytes(2, "big") + side


_SIZES = {k: 144 * k * 1000 // HERTZ for k in _RATES_1[3]}
_HEADS = {k: _head(k) for k in _RATES_1[3]}
FULL = 320


def _synchsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def _tag(payload_bytes: int) -> bytes:
    body = b"\x03payload_bytes\x00" + str(payload_bytes).encode()
    frame = b"TXXX" + _synchsafe(len(body)) + b"\x00\x00" + body
    return b"ID3\x04\x00\x00" + _synchsafe(len(frame)) + frame


def encode(payload: bytes) -> bytes:
    """The stream that stores a payload."""
    full = _SIZES[FULL] - HEAD
    n, rest = divmod(len(payload), full)
    frames = np.zeros((n, _SIZES[FULL]), np.uint8)
    frames[:, :HEAD] = np.frombuffer(_HEADS[FULL], np.uint8)
    frames[:, HEAD:] = np.frombuffer(payload, np.uint8, n * full).reshape(n, full)
    last = b""
    if rest:
        kbit = next(k for k in _RATES_1[3] if _SIZES[k] - HEAD >= rest)
        last = (_HEADS[kbit] + payload[n * full :]).ljust(_SIZES[kbit], b"\0")
    count, table = n + bool(rest), 80
    size = _SIZES[table] + n * _SIZES[FULL] + len(last)
    starts = [_SIZES[table] + min(count * i // 100, n) * _SIZES[FULL] for i in range(100)]
    xing = b"Xing" + (7).to_bytes(4, "big") + count.to_bytes(4, "big") + size.to_bytes(4, "big") + bytes(min(255, s * 256 // size) for s in starts)
    return _tag(len(payload)) + (_HEADS[table] + xing).ljust(_SIZES[table], b"\0") + frames.tobytes() + last


_crc_seen: dict[bytes, int] = {}


def _covered(data: bytes, at: int, h: tuple) -> int:
    """How many bytes after a frame's CRC it covers: the side information of Layer III, the bit allocation of Layer I."""
    if h[3] == 3:
        return (17 if h[4] else 32) if h[6] else (9 if h[4] else 17)
    joint = data[at + 3] >> 6 == 1
    both = ((data[at + 3] >> 4 & 3) + 1) * 4 if joint else 32
    return 16 if h[4] else (32 + both) // 2


def _crc_ok(data: bytes, at: int, h: tuple) -> bool:
    """Whether the CRC of a frame of Layer I or III holds; frames without one, and Layer II (whose length of allocation
    depends on tables that nothing else here needs), pass."""
    if not h[5] or h[3] == 2:
        return True
    part = data[at + 2 : at + 4] + data[at + 6 : at + 6 + _covered(data, at, h)]
    if part not in _crc_seen:
        if len(_crc_seen) > 4096:
            _crc_seen.clear()
        _crc_seen[part] = crc16(part)
    return _crc_seen[part] == int.from_bytes(data[at + 4 : at + 6], "big")


def parse(data: bytes) -> dict:
    """What a stream holds: hertz, samples, frame offsets and sizes, bad CRCs, bytes skipped, tag and VBR fields."""
    at, end, tag, out = 0, len(data), b"", {"skipped": 0, "bad_crc": 0, "samples": 0, "hertz": 0, "offsets": [], "sizes": [], "kbits": set(), "vbr_frames": None, "vbr_bytes": None, "toc": None, "payload_bytes": None}
    if data[:3] == b"ID3" and end >= 10:
        size = int.from_bytes(data[6:10], "big")
        size = (size & 127) | (size >> 8 & 127) << 7 | (size >> 16 & 127) << 14 | (size >> 24 & 127) << 21
        tag, at = data[10 : 10 + size], 10 + size
        if m := re.search(rb"TXXX.{6}\x03payload_bytes\x00([0-9]+)", tag, re.S):
            out["payload_bytes"] = int(m[1])
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    insync = False
    while at + 4 <= end:
        h = header(data, at)
        if h and at + h[0] <= end and (insync or at + h[0] == end or header(data, at + h[0])):
            insync = True
            if not out["offsets"] and out["vbr_frames"] is None and h[3] == 3:
                mark = at + 4 + 2 * h[5] + ((17 if h[4] else 32) if h[6] else (9 if h[4] else 17))
                if data[mark : mark + 4] in (b"Xing", b"Info"):
                    flags, p = int.from_bytes(data[mark + 4 : mark + 8], "big"), mark + 8
                    out["vbr_frames"] = -1
                    for bit, name in ((1, "vbr_frames"), (2, "vbr_bytes")):
                        if flags & bit:
                            out[name], p = int.from_bytes(data[p : p + 4], "big"), p + 4
                    if flags & 4:
                        out["toc"] = list(data[p : p + 100])
                    out["bad_crc"] += not _crc_ok(data, at, h)
                    at += h[0]
                    continue
            out["bad_crc"] += not _crc_ok(data, at, h)
            out["offsets"].append(at)
            out["sizes"].append(h[0])
            out["samples"] += h[1]
            out["hertz"] = h[2]
            out["kbits"].add(h[7])
            at += h[0]
        else:
            insync = False
            found = data.find(b"\xff", at + 1, end)
            step = (found if found >= 0 else end) - at
            out["skipped"] += step
            at += step
    return out


def payload(data: bytes, found: dict) -> bytes:
    """What encode stored, from the stream and what parse found in it."""
    return b"".join([data[a + HEAD : a + n] for a, n in zip(found["offsets"], found["sizes"])])[: found["payload_bytes"]]


def feature(found: dict) -> str:
    """A short text of the features: exact duration as samples/hertz, frames, bit rates, checks, seek offsets of tenths."""
    o = found["offsets"]
    seek = ".".join(str(o[len(o) * i // 10]) for i in range(10)) if o else ""
    return f"mpeg;duration={found['samples']}/{found['hertz']};frames={len(o)};kbit={min(found['kbits'], default=0)}-{max(found['kbits'], default=0)};vbr={found['vbr_frames']};bad_crc={found['bad_crc']};skipped={found['skipped']};seek={seek}"


STREAM_SCHEMA = "doc_id long, n_bytes long, media binary"


def _encode_batches(it):
    for batch in it:
        media, sizes = [], []
        for text in batch.column(1).to_pylist():
            sizes.append(len(text))
            media.append(encode(text + b" " * (-len(text) % UNIT if text else UNIT)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, samples long, hertz int, seek_offsets array<long>"


def _feature_batches(it):
    for batch in it:
        rows = []
        for i, n, media in zip(*(batch.column(k).to_pylist() for k in range(3))):
            found = parse(media)
            data = payload(media, found)
            rows.append((i, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(found), len(found["offsets"]), found["samples"], found["hertz"], found["offsets"]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        names = [x.split()[0] for x in FEATURE_SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 12, types)], names=names)


def to_media(docs: DataFrame) -> DataFrame:
    """The storing operator: a written table with doc_id, n_bytes and the binary column media of every row."""
    return stash(batches(texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))).mapInArrow(_encode_batches, STREAM_SCHEMA), "media")


def read_media(media: DataFrame) -> DataFrame:
    """The reading operator: digests and features of a table that to_media made, with every frame's offset."""
    return batches(media.select("doc_id", "n_bytes", "media")).mapInArrow(_feature_batches, FEATURE_SCHEMA)


def op8_media(spark, sf_dir: str) -> DataFrame:
    return read_media(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
