"""MPEG audio columns: a writer that carries payload bytes in frame bodies, and a reader.

The reader skips ID3v2 and ID3v1 tags, finds frame headers again after damage, reads Xing, Info and
VBRI tables, verifies the CRC-16 of protected frames, and reports exact durations (in samples, with
the rate) and the offset of every frame.

The writer makes MPEG-1 Layer III, mono, 44.1 kHz, with CRC. Side information is all zero (no main
data, so a player hears silence) and the payload stands in the bytes after it, which the standard
leaves to ancillary data. A PRIV frame of the ID3v2 tag has the payload's length and CRC-32.

Null and empty texts give the payload of 64 zero bytes. Nothing else of a row is read, so equal
texts give equal values, and repeated rows or further columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import batches, tune

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by version, layer and index, and Hz by version.
_V1 = {1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), 2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), 3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)}
_V2 = {1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), 3: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
OWNER = b"payload\0"


@dataclass(frozen=True)
class Header:
    layer: int
    protected: bool
    kbps: int
    hz: int
    channels: int
    size: int
    samples: int
    side: int


@lru_cache(4096)
def header(word: int) -> Header | None:
    """The frame header in 32 bits, None where they are none (free format counts as none)."""
    version, layer, rate, hz = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or rate in (0, 15) or hz == 3 or word & 3 == 2:
        return None
    kbps, rate_hz = (_V1 if version == 3 else _V2)[layer][rate], _HZ[version][hz]
    pad, mono = word >> 9 & 1, word >> 6 & 3 == 3
    if layer == 1:
        size, samples = (12000 * kbps // rate_hz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        size = samples // 8 * 1000 * kbps // rate_hz + pad
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return Header(layer, not word >> 16 & 1, kbps, rate_hz, 1 if mono else 2, size, samples, side if layer == 3 else 0)


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """Polynomial 0x8005, from 0xFFFF, high bit first."""
    crc = 0xFFFF
    for b in data:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _frame_head(kbps: int) -> tuple[bytes, int]:
    """A protected frame's first bytes up to the end of its side information, and how many bytes follow."""
    word = 0x7FF << 21 | 3 << 19 | 1 << 17 | _V1[3].index(kbps) << 12 | 3 << 6
    h = struct.pack(">I", word)
    side = bytes(17)
    return h + struct.pack(">H", crc16(h[2:] + side)) + side, header(word).size - 6 - 17


_FRAMES = [_frame_head(k) for k in _V1[3][1:]]
_WIDE, _ROOM = _FRAMES[-1]
#: Frames for bytes of up to PLAIN kinds, at 192 kbit/s.
_LESS, PLAIN = _FRAMES[-4], 24


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def seek_points(offsets: list[int], start: int, total: int) -> bytes:
    """Where each hundredth of the frames begins, in 1/256 of the bytes from `start` on."""
    n = len(offsets)
    return bytes(min(255, 256 * (offsets[min(i * n // 100, n - 1)] - start) // total) for i in range(100)) if n and total else bytes(100)


def write(payload: bytes) -> bytes:
    """An MPEG audio file that carries the payload, with an ID3v2 tag and a Xing table."""
    frames, at = [], 0
    while at < len(payload):
        head, room = (_WIDE, _ROOM) if len(set(payload[at : at + _ROOM])) > PLAIN else _LESS
        if len(payload) - at < room:
            head, room = next(f for f in _FRAMES if f[1] >= len(payload) - at)
        frames.append(head + payload[at : at + room].ljust(room, b"\0"))
        at += room
    info = OWNER + struct.pack(">QI", len(payload), zlib.crc32(payload))
    tag = b"PRIV" + struct.pack(">IH", len(info), 0) + info
    tag = b"ID3\x03\0\0" + _syncsafe(len(tag)) + tag
    offsets = list(accumulate((len(f) for f in frames[:-1]), initial=len(_WIDE) + _ROOM))
    total = offsets[-1] + len(frames[-1])
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + seek_points(offsets, 0, total)
    return tag + _WIDE + xing.ljust(_ROOM, b"\0") + b"".join(frames)


@dataclass
class Audio:
    """What the reader finds. offsets: where each audio frame starts; bodies: their bytes after side information."""

    tags: dict[str, bytes] = field(default_factory=dict)
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    hz: int = 0
    channels: int = 0
    samples: int = 0
    rates: set[int] = field(default_factory=set)
    offsets: list[int] = field(default_factory=list)
    bodies: list[bytes] = field(default_factory=list)
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0
    resyncs: int = 0
    table_at: int = 0
    stop: int = 0
    points: list[int] = field(default_factory=list)  # VBRI's: where each group of frames begins

    @property
    def table_agrees(self) -> bool | None:
        """Whether the table's frames, bytes and seek points are those of the frames found; None without a table."""
        if not self.table:
            return None
        right = self.table_frames in (None, len(self.offsets)) and self.table_bytes in (None, self.stop - self.table_at)
        if self.toc:
            right &= self.toc == seek_points(self.offsets, self.table_at, self.stop - self.table_at)
        return right and set(self.points) <= {*self.offsets, self.table_at, self.stop}

    @property
    def seconds(self) -> float:
        return self.samples / self.hz if self.hz else 0.0


def _tags(data: bytes) -> tuple[dict[str, bytes], int]:
    found: dict[str, bytes] = {}
    at = 0
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        size = sum((b & 127) << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
        stop, p, version = min(at + 10 + size, len(data)), at + 10, data[at + 3]
        while version in (3, 4) and p + 10 <= stop and data[p : p + 4].isalnum():
            n = int.from_bytes(data[p + 4 : p + 8]) if version == 3 else sum((b & 127) << s for b, s in zip(data[p + 4 : p + 8], (21, 14, 7, 0), strict=True))
            found.setdefault(data[p : p + 4].decode("latin1"), data[p + 10 : min(p + 10 + n, stop)])
            p += 10 + n
        at = at + 10 + size + (10 if data[at + 5] & 16 else 0)
    return found, min(at, len(data))


def read(data: bytes) -> Audio:
    """Never fails on damaged bytes: what is no frame is skipped and counted."""
    out = Audio()
    out.tags, at = _tags(data)
    stop = len(data)
    locked = False
    while at + 4 <= stop:
        if stop - at == 128 and data[at : at + 3] == b"TAG":  # ID3v1 stands where a frame would start, not within one
            out.tags["ID3v1"], stop = data[at:], at
            break
        h = header(int.from_bytes(data[at : at + 4]))
        if h and at + h.size <= stop and not locked and at + h.size + 4 <= stop:
            after = data[at + h.size : at + h.size + 4]
            if not header(int.from_bytes(after)) and after[:3] != b"TAG":  # a chance pattern: the next header must follow
                h = None
        if not h or at + h.size > stop:
            out.resyncs += locked
            locked = False
            step = data.find(b"\xff", at + 1, stop)
            out.skipped += (step if step >= 0 else stop) - at
            at = step if step >= 0 else stop
            continue
        locked = True
        start = at + 4 + 2 * h.protected
        body = start + h.side
        if h.protected and h.layer == 3:
            good = crc16(data[at + 2 : at + 4] + data[start:body]) == int.from_bytes(data[at + 4 : at + 6])
            out.crc_good += good
            out.crc_bad += not good
        if not out.offsets and not out.table and data[body : body + 4] in (b"Xing", b"Info"):
            out.table, flags, p, out.table_at = data[body : body + 4].decode(), int.from_bytes(data[body + 4 : body + 8]), body + 8, at
            if flags & 1:
                out.table_frames, p = int.from_bytes(data[p : p + 4]), p + 4
            if flags & 2:
                out.table_bytes, p = int.from_bytes(data[p : p + 4]), p + 4
            if flags & 4:
                out.toc = data[p : p + 100]
        elif not out.offsets and not out.table and data[at + 36 : at + 40] == b"VBRI":
            out.table, out.table_at = "VBRI", at
            out.table_bytes, out.table_frames, entries, scale, width, _ = struct.unpack(">IIHHHH", data[at + 46 : at + 62].ljust(16, b"\0"))
            steps = data[at + 62 : min(at + 62 + entries * width, at + h.size)]
            out.points = list(accumulate((int.from_bytes(steps[i : i + width]) * scale for i in range(0, len(steps), max(width, 1))), initial=at))
        else:
            out.offsets.append(at)
            out.bodies.append(data[body : at + h.size])
            out.samples += h.samples
            out.rates.add(h.kbps)
            out.hz, out.channels = h.hz, h.channels
        at += h.size
    out.skipped += max(0, stop - at)
    out.stop = stop
    return out


def payload_of(audio: Audio) -> bytes:
    """The payload that `write` stored; ValueError where its length or CRC-32 does not agree."""
    info = audio.tags.get("PRIV", b"")
    if not info.startswith(OWNER):
        raise ValueError("no payload tag")
    if len(info) < len(OWNER) + 12:
        raise ValueError("damaged payload tag")
    size, crc = struct.unpack(">QI", info[len(OWNER) : len(OWNER) + 12])
    payload = b"".join(audio.bodies)[:size]
    if len(payload) != size or zlib.crc32(payload) != crc or audio.crc_bad:
        raise ValueError("damaged payload")
    return payload


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def store(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and the file (media binary) of each text."""
    tune(docs.sparkSession)

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(data):
            made = [padded(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([write(p) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_bytes bigint, media binary")


FEATURES = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, duration_samples bigint, sample_rate int, n_frames bigint, seek_offsets array<bigint>, reason string"


def features(media: DataFrame) -> DataFrame:
    """Reads the stored files back: doc_id, n_bytes and FEATURES. A null file has null features."""
    tune(media.sparkSession)
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(names)
        a = read(data)
        payload, reason = (None, None, None), None
        try:
            p = payload_of(a)
            payload = len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])
        except ValueError as why:
            reason = str(why)
        rates = f"{min(a.rates)}-{max(a.rates)}" if a.rates else ""
        agrees = "" if a.table_agrees is None else int(a.table_agrees)
        text = f"mp3;hz={a.hz};ch={a.channels};frames={len(a.offsets)};samples={a.samples};kbps={rates};table={a.table};table_frames={a.table_frames};table_agrees={agrees};crc_ok={a.crc_good};crc_bad={a.crc_bad};skipped={a.skipped};resyncs={a.resyncs}"
        return *payload, len(data), hashlib.sha256(data).hexdigest(), text, a.samples, a.hz, len(a.offsets), a.offsets, reason

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string()]
        for batch in batches(data):
            found = [one(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, {FEATURES}")
