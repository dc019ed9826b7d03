"""The MPEG reader and writer: exact round trips, resynchronisation, tags and checksums."""

import pytest

from quillspark.llm import mpeg


@pytest.mark.parametrize("payload", [b"", b"x", b"a" * 1021, b"b" * 1022, bytes(range(256)) * 40, b"TAG" + b"x" * 125, b"q" * 500 + b"TAG" + b"x" * 125])
def test_round_trip(payload):
    data = mpeg.write(payload)
    s = mpeg.parse(data)
    assert mpeg.read(data, s) == payload
    assert s.skipped == 0 and s.crc_bad == 0 and s.table == "Xing"
    assert s.table_frames == len(s.offsets)
    assert s.table_bytes == len(data) - data.index(b"\xff\xfb")


def test_every_place_of_a_tag_lookalike():
    for n in range(900, 1100, 7):
        payload = b"z" * n + b"TAG" + b"y" * 200
        assert mpeg.read(mpeg.write(payload)) == payload


def test_resynchronises_after_junk_and_reads_id3v1():
    data = mpeg.write(b"hello" * 1000)
    whole = mpeg.parse(data)
    tag = b"TAG" + b"t" * 125
    first = whole.offsets[1]
    s = mpeg.parse(b"\xff\xfbjunk" + data[:first] + b"\xff\xff\x00noise" + data[first:] + tag)
    assert len(s.offsets) == len(whole.offsets)
    assert s.samples == whole.samples == 1152 * len(whole.offsets)
    assert s.skipped > 0 and s.tags["ID3v1"] == tag


def test_damage_is_found():
    data = bytearray(mpeg.write(b"hello" * 1000))
    at = mpeg.parse(bytes(data)).offsets[2]
    data[at + 8] ^= 1  # side information, which the checksum covers
    assert mpeg.parse(bytes(data)).crc_bad == 1
    with pytest.raises(ValueError):
        mpeg.read(bytes(data))


def test_exact_duration_and_seek():
    s = mpeg.parse(mpeg.write(b"k" * 10_000))
    assert s.seconds == s.samples / 44100
    assert s.offset_at(0) == s.offsets[0] and s.offset_at(1152) == s.offsets[1] and s.offset_at(s.samples) is None


@pytest.mark.parametrize("data", [None, b"", b"x", b"\xff" * 50, b"TAG" + bytes(125), b"ID3"])
def test_nothing_to_read(data):
    s = mpeg.parse(data)
    assert s.offsets == [] and s.samples == 0 and mpeg.feature_of(s).startswith("none")


def test_header_lengths():
    assert mpeg.header_of(bytes((0xFF, 0xFB, 0x90, 0x00))).size == 417  # 128 kbit/s, 44.1 kHz
    assert mpeg.header_of(bytes((0xFF, 0xFB, 0x92, 0x00))).size == 418
    assert mpeg.header_of(bytes((0xFF, 0xF3, 0x80, 0x00))).samples == 576  # MPEG-2 Layer III
    assert mpeg.header_of(bytes((0xFF, 0xFF, 0x90, 0x00))).size % 4 == 0  # Layer I
    assert mpeg.header_of(bytes((0xFF, 0xFB, 0xF0, 0x00))) is None


def test_crc16_vector():
    assert mpeg.crc16(b"123456789") == 0xAEE7  # CRC-16 with polynomial 0x8005, initial 0xFFFF, not reflected


def test_query_columns(spark):
    rows = [(1, "héllo", "x"), (2, None, "x"), (3, "", "x"), (3, "", "y"), (None, "a" * 70_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    out = mpeg.media_features(mpeg.with_media(docs)).collect()
    assert len(out) == 5
    for r in out:
        text = {1: "héllo", None: "a" * 70_000}.get(r["doc_id"], "")
        assert mpeg.read(bytes(r["media"])) == mpeg.payload_of(text)[1]
        assert r["n_bytes"] == len(text.encode()) and r["crc_bad"] == 0
    assert mpeg.with_media(docs.limit(0)).count() == 0


@pytest.mark.parametrize("mode", [0, 1, 3])
def test_layer_2_checksums(mode):
    """A frame whose allocation and selection are made bit by bit, and its CRC by long division."""
    import random

    r = random.Random(mode)
    head = bytes((0xFF, 0xFC, 0x80, mode << 6 | (1 << 4 if mode == 1 else 0)))  # 128 kbit/s, 44.1 kHz, protected
    channels, bound = (1 if mode == 3 else 2), (8 if mode == 1 else 32)
    nbal = [4] * 11 + [3] * 12 + ([2] * 4 if mode != 3 else [2] * 7)  # one channel of 128 kbit/s has the larger table
    bits, used = "", 0
    for band, n in enumerate(nbal):
        for _ in range(channels if band < bound else 1):
            v = r.randrange(1 << n)
            bits += f"{v:0{n}b}"
            used += bool(v) * (1 if band < bound else channels)
    bits += "".join(r.choice("01") for _ in range(2 * used))
    protected = f"{int.from_bytes(head[2:], 'big'):016b}" + bits
    c = 0xFFFF
    for b in protected:
        c = (c << 1 ^ (0x8005 if (c >> 15) ^ int(b) else 0)) & 0xFFFF
    h = mpeg.header_of(head)
    body = bits + "".join(r.choice("01") for _ in range(8 * (h.size - 6) - len(bits)))
    frame = head + c.to_bytes(2, "big") + int(body, 2).to_bytes(h.size - 6, "big")
    assert mpeg.checksum(h, frame) is True
    assert mpeg.checksum(h, frame[:7] + bytes((frame[7] ^ 16,)) + frame[8:]) is False
    s = mpeg.parse(frame * 3)
    assert (len(s.offsets), s.crc_good, s.crc_bad, s.samples) == (3, 3, 0, 3 * 1152)
