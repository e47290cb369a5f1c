"""Media columns: MPEG audio streams, written and read frame by frame.

A payload travels in the ancillary data of MPEG-1 Layer III frames (mono,
32 kHz): each frame has a header, a CRC-16 and 17 bytes of side information
that say "no audio bits", so decoders play silence and all other bytes of the
frame are free.  The last frame takes the lowest bit rate that holds the
rest, so the stream is of variable bit rate.  An ID3v2 tag names the payload's
length, and the first frame holds a Xing table: frames, bytes and 100 seek
points.

The reader knows nothing of the writer.  It skips tags, looks for sync words,
accepts a header only if another valid header or the end follows where its
length says, verifies checksums, reads the Xing table and returns duration in
samples, the offset of every frame and the frames' free bytes.

Edge cases: a null text is empty; its payload is 64 zero bytes.  Bytes that
hold no frame give an empty reading; null bytes count as empty.  A tag of
another writer that names no number leaves all free bytes as the payload.
Equal texts give equal values; texts are stored whole, whatever their length.
Every row gives one row and an empty table none; columns named like outputs
are replaced, all others stay.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarryline.llm.common import DOUBLE, LONG, STRING, record, row_of

#: Fixed values of the format: kbit/s by index for Layer III, sample rates by index.
BIT_RATES = {3: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], 2: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}
SAMPLE_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
UNIT = 64


@lru_cache(1 << 12)
def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        for bit in range(7, -1, -1):
            top = (crc >> 15) ^ (byte >> bit & 1)
            crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    has_crc: bool
    bit_rate: int
    rate: int
    mono: bool
    length: int

    @property
    def shape(self) -> tuple[int, bool, int, bool]:
        """What all frames of a stream share."""
        return self.version, self.has_crc, self.rate, self.mono

    @property
    def samples(self) -> int:
        return 1152 if self.version == 3 else 576

    @property
    def side(self) -> int:
        if self.version == 3:
            return 17 if self.mono else 32
        return 9 if self.mono else 17


@lru_cache(1 << 12)
def read_header(four: bytes) -> Header | None:
    """A Layer III header, or None if the bytes aren't one."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, index = four[1] >> 3 & 3, four[1] >> 1 & 3, four[2] >> 2 & 3, four[2] >> 4
    if version == 1 or layer != 1 or rate == 3 or index in (0, 15) or four[3] & 3 == 2:
        return None
    kbit, hertz = BIT_RATES[3 if version == 3 else 2][index], SAMPLE_RATES[version][rate]
    samples = 1152 if version == 3 else 576
    return Header(version, not four[1] & 1, kbit, hertz, four[3] >> 6 == 3, samples // 8 * kbit * 1000 // hertz + (four[2] >> 1 & 1))


@lru_cache(32)
def frame_head(index: int) -> bytes:
    """Header, checksum and empty side information of a written frame."""
    header = bytes([0xFF, 0xFA, index << 4 | 2 << 2, 0xC0])
    side = bytes(17)
    return header + crc16(header[2:] + side).to_bytes(2, "big") + side


def room(index: int) -> int:
    head = frame_head(index)
    return read_header(head[:4]).length - len(head)


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write_stream(payload: bytes) -> bytes:
    """The payload as a variable bit rate stream with tag and seek table."""
    largest, rest = 14, payload
    frames = [frame_head(largest) + rest[a : a + room(largest)] for a in range(0, len(rest) - len(rest) % room(largest), room(largest))]
    tail = payload[len(frames) * room(largest) :]
    if tail:
        index = next(i for i in range(1, 15) if room(i) >= len(tail))
        frames.append(frame_head(index) + tail.ljust(room(index), b"\0"))
    table = next(i for i in range(1, 15) if room(i) >= 120)
    size = len(frame_head(table)) + room(table)
    offsets, total = [], size
    for f in frames:
        offsets.append(total)
        total += len(f)
    seek = bytes(min(255, offsets[k * len(offsets) // 100] * 256 // total) for k in range(100)) if offsets else bytes(100)
    xing = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + seek
    body = b"\0" + b"payload\0" + str(len(payload)).encode()
    tag = b"TXXX" + synchsafe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + synchsafe(len(tag)) + tag + frame_head(table) + xing.ljust(room(table), b"\0") + b"".join(frames)


@dataclass
class Reading:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    bad_checksums: int = 0
    skipped: int = 0
    bit_rates: set[int] = field(default_factory=set)
    table_frames: int | None = None
    table_bytes: int | None = None
    seek: bytes = b""
    free: bytes = b""

    @property
    def payload(self) -> bytes:
        """The free bytes, as far as the tag says; all of them where it says nothing or no number."""
        told = self.tags.get("payload", "")
        return self.free[: int(told)] if re.fullmatch("[0-9]{1,18}", told) else self.free


def read_tag(data: bytes) -> tuple[dict[str, str], int]:
    """Texts of an ID3v2.4 tag and where it ends."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    number = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at, tags = min(len(data), 10 + number(data[6:10])), 10, {}
    while at + 10 <= end and data[at : at + 4].strip(b"\0"):
        size = number(data[at + 4 : at + 8])
        body = data[at + 10 : min(end, at + 10 + size)]
        if data[at : at + 4] == b"TXXX" and body:
            name, _, value = body[1:].decode("latin-1" if body[0] == 0 else "utf-8", "replace").partition("\0")
            tags[name] = value.rstrip("\0")
        at += 10 + size
    return tags, end


SYNC = re.compile(rb"\xff[\xe0-\xff]")


def read_stream(data: bytes) -> Reading:
    out = Reading()
    out.tags, at = read_tag(data)
    end, free, locked, shape = len(data), [], False, None
    while at + 4 <= end:
        if at == end - 128 and data.startswith(b"TAG", at):  # an ID3v1 tag, as no frame covers it
            break
        header = read_header(data[at : at + 4])
        if header and shape and header.shape != shape:  # another kind of frame than the stream's is chance
            header = None
        follows = at + (header.length if header else 0)
        # A frame counts if it ends at the end or before another header; once in step, each follows the last.
        if header is None or follows > end or not (locked or follows == end or read_header(data[follows : follows + 4])):
            found = SYNC.search(data, at + 1, end)
            step = (found.start() if found else end) - at
            out.skipped, at, locked = out.skipped + step, at + step, False
            continue
        shape = header.shape
        locked = follows == end or read_header(data[follows : follows + 4]) is not None
        crc_end = 6 if header.has_crc else 4
        begin = at + crc_end + header.side
        if header.has_crc and crc16(data[at + 2 : at + 4] + data[at + 6 : begin]) != int.from_bytes(data[at + 4 : at + 6], "big"):
            out.bad_checksums += 1
        body = data[begin:follows]
        if not out.offsets and out.table_frames is None and body[:4] in (b"Xing", b"Info"):
            read_table(out, body)
        else:
            out.offsets.append(at)
            out.samples += header.samples
            out.rate = header.rate
            out.bit_rates.add(header.bit_rate)
            free.append(body)
        at = follows
    out.free = b"".join(free)
    return out


def read_table(out: Reading, body: bytes) -> None:
    flags, at = int.from_bytes(body[4:8], "big"), 8
    if flags & 1:
        out.table_frames, at = int.from_bytes(body[at : at + 4], "big"), at + 4
    if flags & 2:
        out.table_bytes, at = int.from_bytes(body[at : at + 4], "big"), at + 4
    if flags & 4:
        out.seek = body[at : at + 100]


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


#: Rows of a batch that are Python bytes at once; the rest stays in Arrow's buffers.
SLICE = 64
STORED = record(n_bytes=LONG, media=T.BinaryType())


def in_slices(values: pa.Array, kind: T.StructType, row: Callable[[object], tuple]) -> pa.Array:
    """One struct for every value."""
    fields = list(to_arrow_schema(kind))
    parts = []
    for a in range(0, len(values), SLICE):
        columns = zip(*map(row, values.slice(a, SLICE).to_pylist()), strict=True)
        parts.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(fields))


def stored_row(text: str | None) -> tuple[int, bytes]:
    n, payload = payload_of(text)
    return n, write_stream(payload)


@F.arrow_udf(STORED)
def store(texts: pa.Array) -> pa.Array:
    return in_slices(texts, STORED, stored_row)


PROBE = record(
    payload_bytes=LONG, payload_sha256=STRING, tail_crc32=LONG, media_bytes=LONG, media_sha256=STRING, feature=STRING,
    duration_ms=DOUBLE, n_frames=LONG, frame_offsets=T.ArrayType(LONG), bad_checksums=LONG,
)


def probed_row(data: bytes | None) -> tuple:
    """What the stored bytes hold; needs nothing but them."""
    data = data or b""
    r = read_stream(data)
    payload = r.payload
    exact = r.table_frames == len(r.offsets)
    feature = f"mpeg1-l3 samples={r.samples} rate={r.rate} frames={len(r.offsets)} table={'ok' if exact else 'bad'} rates={','.join(map(str, sorted(r.bit_rates)))} bad_crc={r.bad_checksums} skipped={r.skipped} last={r.offsets[-1] if r.offsets else -1}"
    duration = 1000 * r.samples / r.rate if r.rate else 0.0
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, duration, len(r.offsets), r.offsets, r.bad_checksums


@F.arrow_udf(PROBE)
def probe(media: pa.Array) -> pa.Array:
    return in_slices(media, PROBE, probed_row)


def with_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes and media (the stored stream)."""
    return docs.select(row_of(docs, ["n_bytes", "media"]).alias("row"), store(F.col(text)).alias("stored")).select("row.*", "stored.n_bytes", "stored.media")


def probed(rows: DataFrame) -> DataFrame:
    """Rows with a media column, read back."""
    return rows.select(row_of(rows, PROBE.names).alias("row"), probe(F.col("media")).alias("read")).select("row.*", "read.*")
