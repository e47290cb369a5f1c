import hashlib
import random
import zlib

import pytest

from quarryline.llm import mpeg_audio as M


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000, 1024, 1500, 40_000])
def test_round_trip_of_any_bytes(size):
    payload = bytes(random.Random(size).choices([0xFF, 0xFA, 0xFB, 0xE0, 0x00, 0x54, 0x41, 0x47], k=size))
    read = M.read_stream(M.write_stream(payload))
    assert read.payload == payload and read.bad_checksums == read.skipped == 0
    assert read.table_frames == len(read.offsets) and read.samples == 1152 * len(read.offsets)


def test_a_tag_like_tail_is_payload():
    payload = bytes(1 << 12)
    stream = bytearray(M.write_stream(payload))
    stream[-128:-125] = b"TAG"
    assert len(M.read_stream(bytes(stream)).offsets) == len(M.read_stream(M.write_stream(payload)).offsets)


def test_resynchronisation_tags_and_checksums():
    payload = bytes(range(256)) * 20
    stream = M.write_stream(payload)
    first = M.read_stream(stream).offsets[0]
    noisy = stream[:first] + b"\xff\xfbjunk\xff\xe0" + stream[first:] + b"TAG" + bytes(125)
    read = M.read_stream(noisy)
    assert read.payload == payload and read.skipped == 8
    broken = bytearray(stream)
    broken[first + 8] ^= 1
    assert M.read_stream(bytes(broken)).bad_checksums == 1
    assert M.read_stream(b"no frame here").offsets == [] and M.read_stream(b"").payload == b""


@pytest.mark.parametrize("told", [b"3x0", b"", b"-4", b"9" * 30, "٣".encode()])
def test_a_foreign_tag_is_no_length(told):
    """A tag that names no number, as other writers may, leaves all free bytes."""
    stream = M.write_stream(bytes(range(200)))
    body = b"\x03payload\0" + told
    tag = b"TXXX" + M.synchsafe(len(body)) + b"\0\0" + body
    foreign = b"ID3\x04\0\0" + M.synchsafe(len(tag)) + tag + stream[M.read_tag(stream)[1] :]
    read = M.read_stream(foreign)
    assert read.payload == read.free and read.payload.startswith(bytes(range(200)))
    assert M.probed_row(foreign)[7] == 1


def test_headers_of_other_versions():
    assert M.read_header(bytes([0xFF, 0xFB, 0x90, 0x00])).length == 417
    assert M.read_header(bytes([0xFF, 0xF3, 0x80, 0xC0])).length == 208
    assert M.read_header(b"\xff\xff\xff\xff") is None


def test_rows(spark):
    texts = [None, "", "a", "é" * 100, "x" * 64, "long text " * 20_000, "a"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    out = M.probed(M.with_media(df)).orderBy("doc_id").collect()
    for t, r in zip(texts, out):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["bad_checksums"] == 0
    assert out[2]["feature"] == out[6]["feature"] and out[2]["media_sha256"] == out[6]["media_sha256"]
    assert M.probed(M.with_media(df.limit(0))).count() == 0
