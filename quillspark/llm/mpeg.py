"""MPEG audio columns: a frame-level reader, and a writer which carries bytes losslessly.

The reader resynchronises on frame headers, parses ID3v2, ID3v1, Xing, Info and
VBRI tables, verifies the CRC-16 of protected frames, and returns the exact
duration in samples and the byte offset of each frame. The writer puts a
payload into the ancillary data of MPEG-1 Layer III frames: variable bitrate,
protected by CRC-16, behind an ID3v2 tag with the payload's length and a Xing
table for seeking.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import read_table

# Fixed values of the format: kbit/s by (MPEG-1?, layer) and index, sample rates of MPEG-1 (halved for 2, quartered for 2.5).
_KBPS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = (44100, 48000, 32000)


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbps: int
    rate: int
    padding: int
    mode: int
    extension: int

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 1 else 576

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12_000 * self.kbps // self.rate + self.padding) * 4
        return self.samples // 8 * 1000 * self.kbps // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mode == 3 else 32) if self.version == 1 else (9 if self.mode == 3 else 17)

    def follows(self, other: Header) -> bool:
        """Bitrate, padding and protection may change within a stream; these may not."""
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


@lru_cache(1 << 16)
def header_of(raw: bytes) -> Header | None:
    """The header in 4 bytes; None if they are none. Free-format frames have no length of their own and are not read."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2.0, 3: 1.0}.get(raw[1] >> 3 & 3)
    layer = 4 - (raw[1] >> 1 & 3)
    at, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or layer == 4 or at in (0, 15) or rate == 3 or raw[3] & 3 == 2:
        return None
    divisor = {1.0: 1, 2.0: 2, 2.5: 4}[version]
    kbps = _KBPS[version == 1, layer][at]
    return Header(version, layer, not raw[1] & 1, kbps, _RATES[rate] // divisor, raw[2] >> 1 & 1, raw[3] >> 6, raw[3] >> 4 & 3)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(1 << 16)
def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, initial value 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 ^ _CRC[(c >> 8) ^ b]) & 0xFFFF
    return c


# Fixed values of Layer II: (bits of a subband's allocation, subbands) in order, by table.
_ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "low": ((4, 4), (3, 7), (2, 19)),
}


def _allocation(h: Header) -> list[int]:
    """Bits of the allocation of each subband of a Layer II frame."""
    if h.version != 1:
        name = "low"
    else:
        each = h.kbps // (1 if h.mode == 3 else 2)
        few = "d" if h.rate == 32000 else "c"
        name = few if each <= 48 else "a" if h.rate == 48000 or each <= 80 else "b"
    return [bits for bits, n in _ALLOCATION[name] for _ in range(n)]


def _crc_bits(data: bytes, begin: int, end: int, c: int = 0xFFFF) -> int:
    """CRC-16 of the bits from ``begin`` up to ``end``."""
    for i in range(begin, end):
        bit = data[i >> 3] >> (7 - (i & 7)) & 1
        c = (c << 1 ^ (0x8005 if (c >> 15) ^ bit else 0)) & 0xFFFF
    return c


def _protected_layer2(h: Header, frame: bytes) -> int | None:
    """Where the protected bits of a Layer II frame end: behind the scale-factor selection; None if the frame is too short."""
    channels, at, used = (1 if h.mode == 3 else 2), 48, 0
    bound = 4 * (h.extension + 1) if h.mode == 1 else 32
    for band, bits in enumerate(_allocation(h)):
        for _ in range(channels if band < bound else 1):
            if at + bits > 8 * len(frame):
                return None
            value = int.from_bytes(frame[at >> 3 : (at >> 3) + 2].ljust(2, b"\0"), "big") >> (16 - (at & 7) - bits) & (1 << bits) - 1
            used += bool(value) * (1 if band < bound else channels)
            at += bits
    return at + 2 * used if at + 2 * used <= 8 * len(frame) else None


def checksum(h: Header, frame: bytes) -> bool | None:
    """Whether the frame's CRC-16 holds; None if it has none."""
    if not h.protected:
        return None
    stored = int.from_bytes(frame[4:6], "big")
    if h.layer == 3:
        return stored == crc16(frame[2:4] + frame[6 : 6 + h.side])
    if h.layer == 2:
        end = _protected_layer2(h, frame)
        return end is not None and stored == _crc_bits(frame, 48, end, _crc_bits(frame, 16, 32))
    bound = 4 * (h.extension + 1) if h.mode == 1 else 32
    bits = 4 * (bound * (1 if h.mode == 3 else 2) + (32 - bound))
    return stored == crc16(frame[2:4] + frame[6 : 6 + bits // 8])


@dataclass
class Stream:
    """What a file holds. Offsets are from its first byte; the table's own frame is no audio."""

    header: Header | None = None
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    kbps: Counter = field(default_factory=Counter)
    tags: dict[str, bytes] = field(default_factory=dict)
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: list[int] = field(default_factory=list)
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0

    @property
    def samples(self) -> int:
        return len(self.offsets) * (self.header.samples if self.header else 0)

    @property
    def seconds(self) -> float:
        return self.samples / self.header.rate if self.header else 0.0

    def offset_at(self, sample: int) -> int | None:
        """The byte offset of the frame which holds a sample; None outside of the stream."""
        return self.offsets[sample // self.header.samples] if self.header and 0 <= sample < self.samples else None


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, at: int, tags: dict[str, bytes]) -> int:
    """Read one tag at ``at``; returns where it ends, or ``at`` if there is none."""
    head = data[at : at + 10]
    if len(head) < 10 or head[:3] != b"ID3" or head[3] == 0xFF or max(head[6:10]) > 127:
        return at
    end = at + 10 + _synchsafe(head[6:10]) + 10 * (head[5] >> 4 & 1)
    pos, last = at + 10, min(end, len(data))
    if head[3] >= 3:
        while pos + 10 <= last and data[pos]:
            size = _synchsafe(data[pos + 4 : pos + 8]) if head[3] == 4 else int.from_bytes(data[pos + 4 : pos + 8], "big")
            if size > last - pos - 10:
                break
            tags.setdefault(data[pos : pos + 4].decode("latin-1"), data[pos + 10 : pos + 10 + size])
            pos += 10 + size
    return min(end, len(data))


def _table(s: Stream, h: Header, frame: bytes) -> bool:
    """Read a Xing, Info or VBRI table; False if the frame has none."""
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        s.table, flags, at = frame[at : at + 4].decode(), int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        for bit, name in ((1, "table_frames"), (2, "table_bytes")):
            if flags & bit:
                setattr(s, name, int.from_bytes(frame[at : at + 4], "big"))
                at += 4
        if flags & 4:
            s.toc = list(frame[at : at + 100])
        return True
    if frame[36:40] == b"VBRI":
        s.table = "VBRI"
        s.table_bytes = int.from_bytes(frame[46:50], "big")
        s.table_frames = int.from_bytes(frame[50:54], "big")
        n, scale, width = (int.from_bytes(frame[i : i + 2], "big") for i in (54, 56, 58))
        s.toc = [scale * int.from_bytes(frame[62 + width * i : 62 + width * (i + 1)], "big") for i in range(n)]
        return True
    return False


def parse(data: bytes | None) -> Stream:
    """Read a whole file. Null, empty and frameless data give a stream without frames.

    A header counts if the next one stands where its frame ends, or the data
    or an ID3v1 tag do; anything else is skipped byte by byte and counted. A
    last frame which is cut off is skipped too.
    """
    s = Stream()
    if not data:
        return s
    pos, end = 0, len(data)
    # the same bytes within a frame are no tag, so this is only looked at where a frame or junk ends
    last_tag = end - 128 if end >= 128 and data[end - 128 : end - 125] == b"TAG" else -1
    while (past := _id3v2(data, pos, s.tags)) > pos:
        pos = past
    locked = False
    while pos + 4 <= end:
        if pos == last_tag:
            s.tags["ID3v1"] = data[pos:]
            pos = end
            break
        h = header_of(data[pos : pos + 4])
        if h is None or h.size < 4 or pos + h.size > end or (s.header and not h.follows(s.header)):
            good = False
        elif locked or pos + h.size in (end, last_tag):
            good = True
        else:
            after = header_of(data[pos + h.size : pos + h.size + 4])
            good = after is not None and after.follows(h)
        if not good:
            locked = False
            if (past := _id3v2(data, pos, s.tags)) > pos:
                pos = past
                continue
            found = data.find(b"\xff", pos + 1, end)
            found = end if found < 0 else found
            found = last_tag if pos < last_tag < found else found
            s.skipped += found - pos
            pos = found
            continue
        frame = data[pos : pos + h.size]
        if s.header is None:
            s.header = h
            if h.layer == 3 and _table(s, h, frame):
                pos += h.size
                locked = True
                continue
        if (ok := checksum(h, frame)) is not None:
            s.crc_good += ok
            s.crc_bad += not ok
        s.offsets.append(pos)
        s.sizes.append(h.size)
        s.kbps[h.kbps] += 1
        pos += h.size
        # after a good frame its successor needs no look-ahead, unless it is no header
        locked = True
    s.skipped += max(0, end - pos)
    return s


_INFO = bytes((0xFF, 0xFB, 0xE0, 0xC0))  # MPEG-1 Layer III, no CRC, 320 kbit/s, 44.1 kHz, mono
_SIDE = 17
_ROOM = {k: 144_000 * kbps // 44100 - 6 - _SIDE for k, kbps in enumerate(_KBPS[True, 3]) if k}


@lru_cache(None)
def _front(index: int) -> bytes:
    head = bytes((0xFF, 0xFA, index << 4, 0xC0))
    side = bytes(_SIDE)  # no main data, so that all that follows is ancillary
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


def write(payload: bytes) -> bytes:
    """The payload as an MPEG file; ``read`` gives it back. An empty payload makes a file of no audio frames."""
    most, parts = _ROOM[14], []
    for at in range(0, len(payload), most):
        chunk = payload[at : at + most]
        index = 14 if len(chunk) == most else next(k for k, room in _ROOM.items() if room >= len(chunk))
        parts.append(_front(index) + chunk + bytes(_ROOM[index] - len(chunk)))
    text = b"\0length\0" + str(len(payload)).encode()
    body = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    size = len(body)
    tag = b"ID3\3\0\0" + bytes(size >> s & 127 for s in (21, 14, 7, 0)) + body
    whole = 1044 + sum(map(len, parts))
    toc, n = bytearray(), len(parts)
    for i in range(100):
        before = 1044 * (1 + min(n, i * n // 100)) if n else 0
        toc.append(min(255, 256 * before // whole))
    info = _INFO + bytes(_SIDE) + b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + whole.to_bytes(4, "big") + bytes(toc)
    return b"".join((tag, info + bytes(1044 - len(info)), *parts))


def read(data: bytes, stream: Stream | None = None) -> bytes:
    """The payload of a file made by ``write``, from its frames; raises if a checksum fails or bytes are missing."""
    s = stream or parse(data)
    if "TXXX" not in s.tags or not s.tags["TXXX"].startswith(b"\0length\0"):
        raise ValueError("no payload tag")
    length = int(s.tags["TXXX"][8:])
    out = b"".join(data[a + 6 + _SIDE : a + n] for a, n in zip(s.offsets, s.sizes, strict=True))
    if s.crc_bad or len(out) < length:
        raise ValueError("damaged payload")
    return out[:length]


def feature_of(s: Stream) -> str:
    """A digest of what was read, equal for equal files."""
    h = s.header
    rates = ",".join(f"{k}x{n}" for k, n in sorted(s.kbps.items()))
    return (
        f"mpeg={h.version:g} layer={h.layer} hz={h.rate} " if h else "none "
    ) + f"frames={len(s.offsets)} samples={s.samples} kbps={rates} crc={s.crc_good}/{s.crc_bad} table={s.table}:{s.table_frames} skipped={s.skipped} last={s.offsets[-1] if s.offsets else -1}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes (null: none) and their number, zero-filled to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) of every row: the text's payload as an MPEG file. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                got = [payload_of(x.as_py()) for x in b.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([write(p) for _, p in got], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds samples, seconds, frame_offsets, crc_bad and feature to a table with a column of MPEG files.

    Null and damaged files have what could be read of them: no frames, zero
    samples, or skipped bytes. Columns of the same names are replaced.
    """
    extra = (("samples", pa.int64()), ("seconds", pa.float64()), ("frame_offsets", pa.list_(pa.int64())), ("crc_bad", pa.int64()), ("feature", pa.string()))
    names = {n for n, _ in extra}
    kept = media.select(*[F.col(f"`{c}`") for c in media.columns if c not in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse(x.as_py()) for x in b.column(media_col)]
            cols = {f.name: b.column(f.name) for f in b.schema}
            for (name, kind), values in zip(extra, zip(*[(s.samples, s.seconds, s.offsets, s.crc_bad, feature_of(s)) for s in got]) if got else [[]] * 5, strict=True):
                cols[name] = pa.array(values, kind)
            yield pa.RecordBatch.from_pydict(cols)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, samples long, seconds double, frame_offsets array<long>, crc_bad long, feature string")


def level_of(payload: bytes) -> str:
    """Mean and root mean square of the payload as unsigned 8-bit samples, and how often it crosses the middle."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={x.sum() / len(x):.4f} rms={(int((x * x).sum()) / len(x)) ** 0.5:.4f} crossings={crossings}"


_DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, samples long, seconds double, frame_offsets array<long>"
)


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text stored as MPEG audio, read back and described."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
        for b in batches:
            out = []
            for x in b.column("media"):
                media = x.as_py()
                s = parse(media)
                payload = read(media, s)
                out.append(
                    (
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-64:]),
                        len(media),
                        hashlib.sha256(media).hexdigest(),
                        f"{feature_of(s)} {level_of(payload)}",
                        s.samples,
                        s.seconds,
                        s.offsets,
                    )
                )
            cols = [pa.array(v, k) for v, k in zip(zip(*out) if out else [[]] * 9, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), *cols],
                [f.split()[0] for f in _DIGEST.split(", ")],
            )

    return with_media(read_table(spark, sf_dir, "documents")).mapInArrow(digest, _DIGEST)
