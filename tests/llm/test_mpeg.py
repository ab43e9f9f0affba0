from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from vellum.llm import mpeg, queries


@pytest.mark.parametrize("size", [64, 128, 1408, 1472, 2816, 64 * 5000])
def test_round_trip(size):
    rng = random.Random(size)
    data = rng.randbytes(size)
    media = mpeg.store(data)
    s = mpeg.read(media)
    assert mpeg.payload(media, s) == data
    assert s.damaged == s.skipped == 0 and s.checked == len(s.offsets) + 1 and s.tags == ["id3v2.3"]
    assert s.seconds == Fraction(1152 * len(s.offsets), 32000) and s.table == ("xing", len(s.offsets), len(media) - s.offsets[0] + mpeg._SIZES[9])
    assert all(media[o] == 0xFF and o + h.size == e for o, h, e in zip(s.offsets, s.headers, [*s.offsets[1:], len(media)], strict=True))


def test_resynchronises_and_finds_damage():
    media = mpeg.store(bytes(range(256)) * 40)
    clean = mpeg.read(media)
    cut = clean.offsets[2]
    broken = media[:cut] + b"\xff\xfbnoise\xff\xff\xe0" * 9 + media[cut:]
    s = mpeg.read(broken)
    assert s.skipped == 9 * 10 and len(s.offsets) == len(clean.offsets) and mpeg.payload(broken, s) == mpeg.payload(media, clean)
    spoiled = bytearray(media)
    spoiled[clean.offsets[1] + 8] ^= 1  # side information
    assert mpeg.read(bytes(spoiled)).damaged == 1
    assert mpeg.read(media + b"TAG" + bytes(125)).tags == ["id3v1", "id3v2.3"]
    for junk in (b"", b"\xff", b"ID3", b"\xff" * 5000, bytes(5000), b"ID3\x03\x00\x00\x7f\x7f\x7f\x7f"):
        assert mpeg.read(junk).offsets == []
    rng = random.Random(1)
    for _ in range(200):
        mpeg.read(rng.randbytes(3000))


def test_checksum_and_headers():
    assert mpeg.checksum(b"123456789") == 0xAEE7  # CRC-16/CMS
    h = mpeg.header(bytes((0xFF, 0xFB, 0x90, 0x00)))
    assert (h.version, h.layer, h.kbps, h.rate, h.size, h.samples, h.channels) == ("1", 3, 128, 44100, 417, 1152, 2)
    assert mpeg.header(bytes((0xFF, 0xFD, 0x80, 0xC0))).size == 144 * 128000 // 44100
    assert mpeg.header(bytes((0xFF, 0xF3, 0x40, 0xC0))).size == 72 * 32000 // 22050


def test_query_values(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op6_mpeg_media(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id]
        data = text + bytes(-len(text) % 64 or (0 if text else 64))
        media = mpeg.store(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 1_000_000), (3, "a"), (None, "a")], "doc_id long, text string").withColumn("media", F.lit("clash"))
    rows = mpeg.inspect(mpeg.media(docs)).collect()
    assert sorted(len(r.payload) for r in rows) == [64, 64, 64, 64, 1_000_000] and all(r.damaged == 0 for r in rows)
    assert mpeg.inspect(mpeg.media(docs.limit(0))).collect() == []
    assert [r.frames for r in mpeg.inspect(spark.createDataFrame([(None,)], "media binary")).collect()] == [0]


def written(data):
    """The stream of a payload by an independent writer: bits from the standard's tables, the checksum bit by bit."""

    def crc(bits):
        state = 0xFFFF
        for bit in bits:
            state = (state << 1 ^ (0x8005 if (state >> 15) ^ bit else 0)) & 0xFFFF
        return state

    def frame(rate_index, content):
        kbps = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320][rate_index]
        size = 144 * kbps * 1000 // 32000
        head = 0xFFFA0000 | rate_index << 12 | 2 << 10 | mpeg._HEADS[1][3]
        side = bytes(len(mpeg._HEADS[1]) - 6)
        covered = head.to_bytes(4, "big")[2:] + side
        check = crc([byte >> (7 - k) & 1 for byte in covered for k in range(8)])
        body = head.to_bytes(4, "big") + check.to_bytes(2, "big") + side + content
        assert len(body) <= size
        return body + bytes(size - len(body))

    room = 1440 - len(mpeg._HEADS[14])
    parts = [data[i : i + room] for i in range(0, len(data), room)]
    sizes = [144 * k * 1000 // 32000 for k in (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)]
    frames = [frame(14 if len(p) == room else next(i + 1 for i, s in enumerate(sizes) if s - len(mpeg._HEADS[1]) >= len(p)), p) for p in parts]
    total = sizes[8] + sum(map(len, frames))
    seek = bytes(min(255, 256 * (sizes[8] + p * len(frames) // 100 * 1440) // total) for p in range(100))
    table = frame(9, b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + seek)
    note = b"payload-bytes\0" + len(data).to_bytes(8, "big")
    tag = b"PRIV" + len(note).to_bytes(4, "big") + b"\0\0" + note
    return b"ID3\x03\0\0\0\0" + bytes((len(tag) >> 7, len(tag) & 127)) + tag + table + b"".join(frames)


def test_an_independent_writer_gives_the_same_stream():
    for size in (64, 1344, 1408, 2816, 6400, 64 * 777):
        data = random.Random(size).randbytes(size)
        assert written(data) == mpeg.store(data)


def test_marks_in_the_payload_lose_no_byte():
    for n in range(1, 3000):
        data = mpeg.padded(b"TAG" * n)
        media = mpeg.store(data)
        s = mpeg.read(media)
        assert mpeg.payload(media, s) == data and s.skipped == s.damaged == 0 and s.tags == ["id3v2.3"]
    for mark in (b"TAG", b"ID3\x03\0\0\0\0\0\x7f", b"Xing\0\0\0\x07", b"VBRI", b"\xff\xfb\xe8\0" * 3, b"\xff" * 40):
        for size in (64, 1408, 2816, 2880):
            for at in range(max(0, size - 2900), size - len(mark), 1 if size < 1409 else 7):
                data = bytearray(size)
                data[at : at + len(mark)] = mark
                media = mpeg.store(bytes(data))
                s = mpeg.read(media)
                assert mpeg.payload(media, s) == data and s.skipped == s.damaged == 0
                tagged = media + b"TAG" + bytes(125)
                t = mpeg.read(tagged)
                assert t.tags == ["id3v1", "id3v2.3"] and t.offsets == s.offsets and t.skipped == 0


def test_query_gives_all_offsets(spark, sf_dir):
    for r in queries.op6_mpeg_media(spark, sf_dir).collect():
        assert f"frames={len(r.offsets)};" in r.feature and r.feature.endswith(f"last={r.offsets[-1]}") and r.offsets == sorted(set(r.offsets))
