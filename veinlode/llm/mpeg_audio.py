"""MPEG audio as a media column.

A payload is stored as an MPEG-1 Layer III stream: an ID3v2.3 tag, one frame with a variable-bitrate table (frame
count, stream bytes and 100 seek points), then protected frames of 320 kbit/s at 32 kHz whose side information is
all zero, so a decoder plays silence and the main-data area carries the payload as ancillary bytes. The last frame
takes the lowest bitrate that holds the rest. An ID3v1 tag ends the stream. The reader trusts none of this: it skips
tags, searches for the next header whose successor is a header too, reads the table if there is one, checks the
CRC-16 of every protected frame, and gives exact durations in samples and the offset of every frame.

Defined cases: a null text counts as empty; an empty payload is 64 zero bytes; junk, cut-off frames and damaged
checksums are counted and never raise; equal texts give equal values; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinlode.llm.common import table

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index (0: free, 15: forbidden) and Hz by index.
_L1 = (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
_L2 = (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
_L3 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
_LOW1 = (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
_LOW = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
_HZ = (44100, 48000, 32000)
UNIT = 64


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbps: int
    hz: int
    mono: bool
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information (Layer III)."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


_seen: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """The four bytes of a frame header, or None if they aren't one."""
    if word in _seen:
        return _seen[word]
    if len(_seen) > 100_000:
        _seen.clear()
    _seen[word] = made = _header(word)
    return made


def _header(word: int) -> Header | None:
    version = {0: 2.5, 2: 2.0, 3: 1.0}.get(word >> 19 & 3)
    layer = 4 - (word >> 17 & 3)
    rate, hz = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version is None or layer == 4 or rate in (0, 15) or hz == 3 or word & 3 == 2:
        return None
    per_s = _HZ[hz] // {1.0: 1, 2.0: 2, 2.5: 4}[version]
    kbps = ((_L1, _L2, _L3)[layer - 1] if version == 1 else (_LOW1, _LOW, _LOW)[layer - 1])[rate]
    pad = word >> 9 & 1
    if layer == 1:
        length, samples = (12 * kbps * 1000 // per_s + pad) * 4, 384
    else:
        samples = 1152 if layer == 2 or version == 1 else 576
        length = samples // 8 * kbps * 1000 // per_s + pad
    return Header(version, layer, not word >> 16 & 1, kbps, per_s, word >> 6 & 3 == 3, length, samples)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()
_crcs: dict[bytes, int] = {}


def crc16(covered: bytes) -> int:
    """CRC-16 of header bytes 3 and 4 and the side information; results are kept as most frames repeat them."""
    c = _crcs.get(covered)
    if c is None:
        c = 0xFFFF
        for b in covered:
            c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
        if len(_crcs) > 10_000:
            _crcs.clear()
        _crcs[covered] = c
    return c


def _frame_head(index: int) -> bytes:
    """Header, checksum and empty side information of a protected 32 kHz stereo Layer III frame."""
    head = (0x7FF << 21 | 3 << 19 | 1 << 17 | index << 12 | 2 << 10).to_bytes(4, "big")
    return head + crc16(head[2:] + bytes(32)).to_bytes(2, "big") + bytes(32)


_HEADS = {i: _frame_head(i) for i in range(1, 15)}
_ROOM = {i: header(int.from_bytes(_HEADS[i][:4], "big")).length - 38 for i in range(1, 15)}


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def pack(payload: bytes) -> bytes:
    """Payload to MPEG audio. Its length is kept in a TXXX frame of the tag."""
    full = _ROOM[14]
    body = []
    for at in range(0, len(payload), full):
        part = payload[at : at + full]
        i = 14 if len(part) == full else next(k for k in range(1, 15) if _ROOM[k] >= len(part))
        body.append(_HEADS[i] + part + bytes(_ROOM[i] - len(part)))
    text = b"\0payload\0" + str(len(payload)).encode()
    frame = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    tag = b"ID3\x03\0\0" + _syncsafe(len(frame)) + frame
    size = sum(map(len, body)) + _ROOM[5] + 38
    ends = np.cumsum([_ROOM[5] + 38, *map(len, body)])
    toc = bytes(int(ends[min(k * len(body) // 100, len(body) - 1)]) * 255 // size for k in range(100)) if body else bytes(100)
    xing = b"Xing" + (7).to_bytes(4, "big") + len(body).to_bytes(4, "big") + size.to_bytes(4, "big") + toc
    first = _HEADS[5] + xing + bytes(_ROOM[5] - len(xing))
    return b"".join([tag, first, *body, b"TAG" + b"payload".ljust(125, b"\0")])


@dataclass
class Stream:
    """What the reader found."""

    tags: dict[str, str] = field(default_factory=dict)
    table: tuple[str, int, int] | None = None
    toc: bytes = b""
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    hz: int = 0
    kinds: set = field(default_factory=set)
    bad_crc: int = 0
    unprotected: int = 0
    junk: int = 0
    data: list[bytes] = field(default_factory=list)

    def payload(self) -> bytes:
        data = b"".join(self.data)
        n = self.tags.get("payload", "")
        return data[: int(n)] if n.isascii() and n.isdigit() else data


def _id3v2(raw: bytes, out: Stream) -> int:
    if len(raw) < 10 or raw[:3] != b"ID3" or max(raw[6:10]) > 127:
        return 0
    size = raw[6] << 21 | raw[7] << 14 | raw[8] << 7 | raw[9]
    end, p = min(len(raw), 10 + size), 10
    while p + 10 <= end and raw[p : p + 4].isalnum():
        n = int.from_bytes(raw[p + 4 : p + 8], "big")
        text = raw[p + 10 : min(end, p + 10 + n)]
        if raw[p : p + 4] == b"TXXX" and text.count(b"\0") >= 2:
            _, key, value = text.split(b"\0", 2)
            out.tags[key.decode("latin-1")] = value.decode("latin-1")
        elif text:
            out.tags[raw[p : p + 4].decode()] = text[1:].decode("latin-1")
        p += 10 + n
    return 10 + size + (10 if raw[5] & 16 else 0)


def _vbr(raw: bytes, p: int, h: Header, out: Stream) -> bool:
    at = p + 4 + 2 * h.protected + h.side
    if raw[at : at + 4] in (b"Xing", b"Info"):
        flags, q = int.from_bytes(raw[at + 4 : at + 8], "big"), at + 8
        n = [0, 0]
        for i in (0, 1):
            if flags >> i & 1:
                n[i], q = int.from_bytes(raw[q : q + 4], "big"), q + 4
        out.table = (raw[at : at + 4].decode(), *n)
        out.toc = raw[q : q + 100] if flags & 4 else b""
        return True
    at = p + 36
    if raw[at : at + 4] == b"VBRI":
        out.table = ("VBRI", int.from_bytes(raw[at + 14 : at + 18], "big"), int.from_bytes(raw[at + 10 : at + 14], "big"))
        return True
    return False


def parse(raw: bytes) -> Stream:
    """Read a stream of any MPEG version and layer; resynchronises after junk."""
    out = Stream()
    p, end = _id3v2(raw, out), len(raw)
    if raw[-128:-125] == b"TAG" and end >= 128:
        end -= 128
        out.tags["title"] = raw[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    locked: tuple | None = None
    while p + 4 <= end:
        h = header(int.from_bytes(raw[p : p + 4], "big"))
        fits = h is not None and p + h.length <= end
        if fits:  # a lone match is trusted only if it looks like the frame before it
            after, like = p + h.length, (h.version, h.layer, h.hz, h.protected, h.mono)
            fits = locked == like or after + 4 > end or header(int.from_bytes(raw[after : after + 4], "big")) is not None
        if not fits:
            nxt = raw.find(b"\xff", p + 1, end)
            out.junk += (nxt if nxt >= 0 else end) - p
            p, locked = (nxt if nxt >= 0 else end), None
            continue
        skip = 4
        if h.protected:
            skip = 6
            if h.layer == 3:
                skip += h.side
                out.bad_crc += crc16(raw[p + 2 : p + 4] + raw[p + 6 : p + skip]) != int.from_bytes(raw[p + 4 : p + 6], "big")
        else:
            out.unprotected += 1
            skip += h.side if h.layer == 3 else 0
        if locked or out.offsets or h.layer != 3 or not _vbr(raw, p, h, out):
            out.offsets.append(p)
            out.samples += h.samples
            out.hz = out.hz or h.hz
            out.kinds.add((h.version, h.layer, h.kbps))
            out.data.append(raw[p + skip : p + h.length])
        p, locked = p + h.length, like
    out.junk += max(0, end - p)
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % UNIT if raw else UNIT)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, media)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                made = [padded(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([pack(x) for _, x in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(write, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) to the payload's and the stream's facts: duration as samples over hz, all frame
    offsets, tags, the variable-bitrate table, and counts of frames that failed their checksum and of junk bytes."""
    made = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, samples long, hz int, frames long, bad_crc long, unprotected long, junk_bytes long, vbr_kind string, vbr_frames long, vbr_bytes long, title string, seek_offsets array<int>"
    kind = media.schema["doc_id"].dataType.simpleString()

    def facts(raw: bytes) -> tuple:
        s = parse(raw)
        data = s.payload()
        vbr = s.table or (None, None, None)
        return (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), s.samples, s.hz, len(s.offsets), s.bad_crc, s.unprotected, s.junk, *vbr, s.tags.get("title"), s.offsets)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())]
        names = ["doc_id", "n_bytes", *[x.split(" ")[0] for x in made.split(", ")]]
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                cols = list(zip(*map(facts, part.column("media").to_pylist())))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *[pa.array(c, t) for c, t in zip(cols, types)]], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(look, f"doc_id {kind}, n_bytes long, {made}")


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(store(table(spark, sf_dir, "documents")))
    seeks = F.crc32(F.array_join(F.col("seek_offsets").cast("array<string>"), ",").cast("binary"))
    ms = F.floor(F.col("samples") * 1000 / F.greatest(F.col("hz"), F.lit(1)))
    feature = F.format_string("frames=%d;samples=%d;hz=%d;ms=%d;vbr=%s/%d/%d;bad_crc=%d;junk=%d;seek=%d", "frames", "samples", "hz", ms, "vbr_kind", "vbr_frames", "vbr_bytes", "bad_crc", "junk_bytes", seeks)
    return r.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
