"""Media columns of MPEG audio: lossless payload storage, resynchronising reader, seek offsets.

A payload is stored in the main data of Layer III frames whose side information declares
no audio, so that it is a valid stream of silence with ancillary bytes. An identifier tag
keeps the payload's size, a variable-bitrate table the frame count, size and seek points,
and every frame protects header and side information by a checksum.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import text_bytes

# Fixed values of the MPEG audio header: kbit/s by bitrate index (from 1), sampling rates in
# Hz by rate index, samples a frame by layer.
BITRATES = {
    ("1", 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    ("1", 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    ("1", 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    ("2", 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    ("2", 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    ("2", 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
VERSIONS = {0: "2.5", 2: "2", 3: "1"}
SAMPLES = {("1", 1): 384, ("1", 2): 1152, ("1", 3): 1152, ("2", 1): 384, ("2", 2): 1152, ("2", 3): 576}

OWNER = b"payload-bytes\x00"


@dataclass(frozen=True)
class Header:
    """A frame header's meaning."""

    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.channels == 1 else 32) if self.version == "1" else (9 if self.channels == 1 else 17)


@functools.lru_cache(maxsize=4096)
def header(word: bytes) -> Header | None:
    """The meaning of four bytes; None where they are no frame header of known size."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(word[1] >> 3 & 3), 4 - (word[1] >> 1 & 3)
    index, rate = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3:
        return None
    family = "1" if version == "1" else "2"
    kbps, hertz, padding = BITRATES[family, layer][index - 1], RATES[version][rate], word[2] >> 1 & 1
    samples = SAMPLES[family, layer]
    size = (12_000 * kbps // hertz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + padding
    return Header(version, layer, not word[1] & 1, kbps, hertz, 1 if word[3] >> 6 == 3 else 2, size, samples)


@functools.lru_cache(maxsize=4096)
def checksum(data: bytes) -> int:
    """CRC-16 of MPEG audio (polynomial 0x8005, start 0xFFFF)."""
    value = 0xFFFF
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
    return value


def _open_frame(index: int) -> bytes:
    """Header, checksum and empty side information of an MPEG-1 Layer III mono frame at 32 kHz."""
    word = bytes((0xFF, 0xFA, index << 4 | 2 << 2, 0xC0))
    side = bytes(17)
    return word + struct.pack(">H", checksum(word[2:] + side)) + side


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


_HEADS = [b""] + [_open_frame(i) for i in range(1, 15)]
_SIZES = [0] + [header(h[:4]).size for h in _HEADS[1:]]
_ROOM = [0] + [s - len(h) for s, h in zip(_SIZES[1:], _HEADS[1:], strict=True)]


def store(payload: bytes) -> bytes:
    """The payload as an MPEG-1 Layer III stream of variable bitrate.

    All frames are of the highest bitrate but the last, which is the smallest that holds the rest.
    """
    room, frames = _ROOM[14], []
    for at in range(0, len(payload), room):
        part = payload[at : at + room]
        k = 14 if len(part) == room else next(i for i in range(1, 15) if _ROOM[i] >= len(part))
        frames += (_HEADS[k], part, bytes(_ROOM[k] - len(part)))
    body = b"".join(frames)
    note = OWNER + struct.pack(">Q", len(payload))
    tag = b"PRIV" + struct.pack(">I", len(note)) + b"\x00\x00" + note
    tag = b"ID3\x03\x00\x00" + _synchsafe(len(tag)) + tag
    count, total = len(frames) // 3, _SIZES[9] + len(body)
    points = bytes(min(255, 256 * (_SIZES[9] + p * count // 100 * _SIZES[14]) // total) for p in range(100))
    table = b"Xing" + struct.pack(">III", 7, count, total) + points
    return tag + _HEADS[9] + table + bytes(_ROOM[9] - len(table)) + body


@dataclass
class Stream:
    """What a stream holds: frame places and lengths, tags, the table and what did not fit."""

    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    samples: int = 0
    seconds: Fraction = Fraction(0)
    checked: int = 0
    damaged: int = 0
    skipped: int = 0
    tags: list[str] = field(default_factory=list)
    declared: int | None = None
    payload_size: int | None = None
    table: tuple[str, int | None, int | None] | None = None


def _tag(data: bytes, at: int, out: Stream) -> int:
    """Reads an identifier tag at ``at``; where it ends."""
    size = sum((data[at + 6 + i] & 127) << s for i, s in enumerate((21, 14, 7, 0)))
    end = min(len(data), at + 10 + size + (10 if data[at + 5] & 16 else 0))
    out.tags.append(f"id3v2.{data[at + 3]}")
    p = at + 10
    while p + 10 <= end and data[p : p + 4].strip(b"\x00"):
        n = sum((data[p + 4 + i] & 127) << s for i, s in enumerate((21, 14, 7, 0))) if data[at + 3] >= 4 else struct.unpack(">I", data[p + 4 : p + 8])[0]
        content = data[p + 10 : min(end, p + 10 + n)]
        if data[p : p + 4] == b"PRIV" and content.startswith(OWNER) and len(content) == len(OWNER) + 8:
            out.payload_size = struct.unpack(">Q", content[len(OWNER) :])[0]
        p += 10 + n
    return end


def _table(data: bytes, at: int, h: Header) -> tuple[str, int | None, int | None] | None:
    """The variable-bitrate table in a frame: name, frames and bytes that it declares."""
    p = at + 4 + (2 if h.protected else 0) + h.side
    if data[p : p + 4] in (b"Xing", b"Info") and p + 16 <= at + h.size:
        flags, p, found = struct.unpack(">I", data[p + 4 : p + 8])[0], p + 8, []
        for bit in (1, 2):
            found.append(struct.unpack(">I", data[p : p + 4])[0] if flags & bit else None)
            p += 4 if flags & bit else 0
        return "xing", found[0], found[1]
    p = at + 36
    if data[p : p + 4] == b"VBRI" and p + 18 <= at + h.size:
        return "vbri", struct.unpack(">I", data[p + 14 : p + 18])[0], struct.unpack(">I", data[p + 10 : p + 14])[0]
    return None


def read(data: bytes) -> Stream:
    """Reads a stream, resynchronising wherever no frame header stands where one should.

    A header found while searching counts only if another of its kind follows at its
    frame's end, or the data or the closing tag begin there. A frame of variable-bitrate
    tables has no samples. The last 128 bytes are a closing tag only if the frames end where
    they begin, so that no frame's content is taken for one. Any bytes are accepted; what
    belongs to no frame or tag counts as skipped.
    """
    out, at, synced, end = Stream(), 0, True, len(data)
    closing = end - 128 if end >= 128 and data[end - 128 : end - 125] == b"TAG" else -1
    while at < end:
        if synced and at == closing:
            out.tags.insert(0, "id3v1")
            break
        if synced and data[at : at + 3] == b"ID3" and at + 10 <= end:
            at = _tag(data, at, out)
            continue
        h = header(data[at : at + 4])
        if h is not None and at + h.size <= end:
            after = header(data[at + h.size : at + h.size + 4])
            kind = after is not None and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate)
            if synced or kind or at + h.size in (end, closing):
                table = _table(data, at, h) if not out.offsets and out.table is None and h.layer == 3 else None
                if h.protected and h.layer == 3:
                    out.checked += 1
                    out.damaged += checksum(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) != struct.unpack(">H", data[at + 4 : at + 6])[0]
                if table is not None:
                    out.table = table
                else:
                    out.offsets.append(at)
                    out.headers.append(h)
                    out.samples += h.samples
                    out.seconds += Fraction(h.samples, h.rate)
                at, synced = at + h.size, True
                continue
        step = data.find(b"\xff", at + 1, end)
        step = end if step < 0 else step
        out.skipped += step - at
        at, synced = step, False
    return out


def payload(data: bytes, stream: Stream) -> bytes:
    """The payload that `store` put into a stream."""
    parts = (data[at + 4 + 2 * h.protected + h.side : at + h.size] for at, h in zip(stream.offsets, stream.headers, strict=True))
    whole = b"".join(parts)
    return whole if stream.payload_size is None else whole[: stream.payload_size]


def padded(text: bytes, unit: int = 64) -> bytes:
    """Bytes 0 appended up to a positive multiple of ``unit``."""
    return text + bytes(-len(text) % unit or (unit if not text else 0))


def media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as audio: rows ``id_col``, n_bytes (of the unpadded UTF-8), media (binary).

    Null counts as empty, which is one unit of zeros. Ids may be null or repeat; other
    columns are ignored; empty input, empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            texts = text_bytes(batch.column(1))
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(map(len, part), pa.int64()), pa.array([store(padded(t)) for t in part], pa.binary())], names=["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def inspect(frame: DataFrame, *, media_col: str = "media") -> DataFrame:
    """Adds what each stream holds to the frame's columns.

    payload (binary), frames, samples, seconds (double), seconds_exact (fraction as text),
    offsets (array of the frames' places, for seeking), checked and damaged (checksums),
    skipped (bytes of no frame), tags and vbr (the table: name, frames, bytes). Null media
    count as empty: no frames.
    """
    fields = "payload binary, frames bigint, samples bigint, seconds double, seconds_exact string, offsets array<bigint>, checked bigint, damaged bigint, skipped bigint, tags string, vbr string"
    added = [f.split()[0] for f in fields.split(", ")]
    clash = [c for c in frame.columns if c in added]
    if clash:
        raise ValueError(f"columns {clash} would be replaced")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema) + ", " + fields

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index(media_col)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for data in part.column(where).to_pylist():
                    data = data or b""
                    s = read(data)
                    rows.append((payload(data, s), len(s.offsets), s.samples, float(s.seconds), str(s.seconds), s.offsets, s.checked, s.damaged, s.skipped, "+".join(s.tags), "" if s.table is None else ":".join(map(str, s.table))))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                extra = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, *added])

    return frame.mapInArrow(scan, schema)
