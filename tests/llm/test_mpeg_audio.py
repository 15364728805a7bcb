import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from veinlode.llm import mpeg_audio as m


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_round_trip(data):
    s = m.parse(m.pack(data))
    assert s.payload() == data and s.bad_crc == s.junk == s.unprotected == 0
    assert s.table == ("Xing", len(s.offsets), s.table[2]) and s.samples == 1152 * len(s.offsets)
    assert s.tags["title"] == "payload"


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000))
def test_any_bytes(data):
    s = m.parse(data)
    assert sum(map(len, s.data)) <= len(data)


def test_known_headers():
    h = m.header(0xFFFB9064)  # MPEG-1 Layer III, 128 kbit/s, 44.1 kHz, joint stereo
    assert (h.version, h.layer, h.kbps, h.hz, h.length, h.samples, h.protected) == (1.0, 3, 128, 44100, 417, 1152, False)
    assert m.header(0xFFF38064).samples == 576 and m.header(0xFFFFFFFF) is None and m.header(0xFFFD8004).layer == 2


def test_damage():
    data = bytes(range(256)) * 30
    raw = bytearray(m.pack(data))
    whole = m.parse(bytes(raw))
    raw[whole.offsets[2] + 20] ^= 1  # side information
    assert m.parse(bytes(raw)).bad_crc == 1
    cut = bytes(raw[: whole.offsets[1]]) + b"\xff\xfbjunk" + bytes(raw[whole.offsets[1] :])
    s = m.parse(cut)
    assert s.junk == 6 and len(s.offsets) == len(whole.offsets)
    vbri = bytearray(m._HEADS[14] + bytes(m._ROOM[14]))
    vbri[36:54] = b"VBRI" + bytes(6) + (999).to_bytes(4, "big") + (7).to_bytes(4, "big")
    assert m.parse(bytes(vbri) + m._HEADS[14] + bytes(m._ROOM[14])).table == ("VBRI", 7, 999)


def test_query_rows(spark):
    texts = [None, "", "a", "a", "é" * 40, "x" * 64, "long text " * 50000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in m.read(m.store(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert r.frames == r.vbr_frames == len(r.seek_offsets) and r.samples == 1152 * r.frames
    assert got[2][1:] == got[3][1:]
    assert m.read(m.store(docs.where("false"))).count() == 0
