"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, exact durations and seek offsets.

The writer stores bytes losslessly as the ancillary data of silent MPEG-1 layer III frames: units of 192 bytes,
up to four in a frame, so that frames vary in bitrate; a tag holds the length and a table frame the count, size and seek
points. The reader knows nothing of the writer. It parses leading and closing tags, finds frame headers again after any damage,
checks the checksums of layers I and III, reads either kind of table, and gives the exact number of samples, without an encoder's
delay and padding where the table states them, and the offset of every frame. Layer II's checksums, which need its allocation
tables, free format, compressed tags and APE tags are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

UNIT = 192
# Fixed values of the MPEG audio standards: kbit/s by (MPEG-1?, layer), samples a second by version, samples a frame by (MPEG-1?, layer).
_RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}
#: Bitrate index of the frame that holds 1, 2, 3 or 4 units.
_UNITS_RATE = {1: 6, 2: 10, 3: 12, 4: 14}


@dataclass(frozen=True)
class Header:
    """One frame header: bytes of the frame and of its side information, and what it says of the sound."""

    version: int
    layer: int
    protected: bool
    kbps: int
    hertz: int
    channels: int
    length: int
    samples: int
    side: int


def parse_header(raw: bytes) -> Header | None:
    """The header in four bytes; None where they are none (free format, which states no length, is not supported)."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    rate, pick = raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or pick == 3 or raw[3] & 3 == 2:
        return None
    first = version == 3
    kbps, hertz, samples = _RATES[first, layer][rate], _HERTZ[version][pick], _SAMPLES[first, layer]
    pad, mono = raw[2] >> 1 & 1, raw[3] >> 6 == 3
    length = (12_000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return Header(version, layer, not raw[1] & 1, kbps, hertz, 1 if mono else 2, length, samples, side if layer == 3 else 0)


def crc16(data: bytes) -> int:
    """The checksum of a protected frame: polynomial 8005 hex, from FFFF hex, high bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass
class AudioInfo:
    """What a stream holds. offsets: where each sound frame begins; samples: of these frames together, the table frame not counted.

    delay and padding: samples that the encoder added at either end; cut: bytes of a last frame that the data ends within.
    """

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    samples: int = 0
    table: tuple[int, int, bytes] | None = None
    checked: int = 0
    damaged: int = 0
    skipped: int = 0
    delay: int = 0
    padding: int = 0
    cut: int = 0

    @property
    def hertz(self) -> int:
        return self.headers[0].hertz if self.headers else 0

    @property
    def duration(self) -> float:
        return max(0, self.samples - self.delay - self.padding) / self.hertz if self.hertz else 0.0


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _parse_tag(data: bytes) -> tuple[dict[str, str], int]:
    """(text frames of a leading ID3v2 tag of version 2, 3 or 4, bytes that it takes)."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    version, flags = data[3], data[5]
    size = _syncsafe(data[6:10])
    body, tags = data[10 : 10 + size], {}
    if flags & 0x80 and version < 4:  # unsynchronised: a zero byte stands after each FF
        body = body.replace(b"\xff\x00", b"\xff")
    whole = _syncsafe if version >= 4 else lambda raw: int.from_bytes(raw, "big")
    at, name_size, head = (0, 3, 6) if version == 2 else (0, 4, 10)
    if flags & 0x40 and version > 2:  # an extended header; only version 3 leaves its own size field out of the size
        at = whole(body[:4]) + 4 * (version == 3)
    while at + head <= len(body) and body[at : at + 1].isalnum():
        name = body[at : at + name_size].decode("ascii", "replace")
        length = int.from_bytes(body[at + 3 : at + 6], "big") if version == 2 else whole(body[at + 4 : at + 8])
        content = body[at + head : at + head + length]
        if version >= 4 and body[at + 9] & 2:
            content = content.replace(b"\xff\x00", b"\xff")
        if name.startswith("T") and content:
            text = content[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(content[0], "utf-8"), "replace")
            key, _, value = text.partition("\0") if name in ("TXXX", "TXX") else (name, "", text)
            tags[key] = value.rstrip("\0")
        at += head + length
    return tags, 10 + size + 10 * (version == 4 and flags >> 4 & 1)


def _closing_tag(raw: bytes) -> dict[str, str]:
    """Fields of the 128 bytes of an ID3v1 tag that hold anything."""
    places = {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97), "comment": (97, 127)}
    found = {k: raw[a:b].split(b"\0")[0].decode("latin-1").rstrip() for k, (a, b) in places.items()}
    return {k: v for k, v in found.items() if v}


_headers: dict[bytes, Header | None] = {}
_sums: dict[bytes, int] = {}


def _alike(a: Header, b: Header | None) -> bool:
    """Whether frames of one stream may have these headers."""
    return b is not None and (a.version, a.layer, a.hertz) == (b.version, b.layer, b.hertz)


def _covered(data: bytes, at: int, head: Header) -> bytes:
    """The bits that a protected frame's checksum covers, whole bytes in layers I and III; none in layer II."""
    body = at + 6
    if head.layer == 3:
        return data[at + 2 : at + 4] + data[body : body + head.side]
    if head.layer == 1:  # four bits of allocation for each subband and channel; joint stereo shares those from a bound on
        mode, bound = data[at + 3] >> 6, 4 * ((data[at + 3] >> 4 & 3) + 1)
        nibbles = 32 * head.channels if mode != 1 else 32 + bound
        return data[at + 2 : at + 4] + data[body : body + nibbles // 2]
    return b""


def parse_audio(data: bytes) -> AudioInfo:
    """Every frame of *data*. A header counts if it follows a like frame, or its own frame ends with the data, at a like frame or at a closing tag.

    What is none is skipped, and a last frame that the data cuts short isn't counted. Any bytes give a result.
    """
    tags, at = _parse_tag(data)
    info, n = AudioInfo(tags), len(data)
    at = min(at, n)
    if n - at >= 128 and data[n - 128 : n - 125] == b"TAG":
        info.tags |= {k: v for k, v in _closing_tag(data[n - 128 :]).items() if k not in tags}
        n -= 128
    expected = -1  # where a frame would follow the last one
    while at + 4 <= n:
        raw = data[at : at + 4]
        if raw in _headers:
            head = _headers[raw]
        else:
            head = _headers[raw] = parse_header(raw)
            if len(_headers) > 100_000:
                _headers.clear()
        if head is not None:
            end = at + head.length
            if end > n:
                if info.headers and _alike(info.headers[-1], head):
                    info.cut = n - at
                    return info
                head = None
            elif end < n and not (at == expected and _alike(info.headers[-1], head)) and not _alike(head, parse_header(data[end : end + 4])):
                head = None
        if head is None:
            later = data.find(b"\xff", at + 1, n)
            later = n if later < 0 else later
            info.skipped += later - at
            at = later
            continue
        body = at + 4 + 2 * head.protected
        first = not info.offsets and info.table is None
        if first and data[body + head.side : body + head.side + 4] in (b"Xing", b"Info"):
            _parse_table(info, data[body + head.side : end])
        elif first and data[at + 36 : at + 40] == b"VBRI":
            _parse_fraunhofer(info, data[at + 36 : end])
        else:
            if head.protected and (covered := _covered(data, at, head)):
                if covered not in _sums:
                    if len(_sums) > 100_000:
                        _sums.clear()
                    _sums[covered] = crc16(covered)
                info.checked += 1
                info.damaged += int.from_bytes(data[at + 4 : at + 6], "big") != _sums[covered]
            info.offsets.append(at)
            info.headers.append(head)
            info.samples += head.samples
            expected = end
        at = end
    info.skipped += n - at
    return info


def _parse_table(info: AudioInfo, raw: bytes) -> None:
    """Frames, bytes and 100 seek points of a variable-bitrate table, and the delay and padding that an encoder may state after it."""
    flags, at = int.from_bytes(raw[4:8], "big"), 8
    frames = size = 0
    points = b""
    if flags & 1:
        frames, at = int.from_bytes(raw[at : at + 4], "big"), at + 4
    if flags & 2:
        size, at = int.from_bytes(raw[at : at + 4], "big"), at + 4
    if flags & 4:
        points, at = raw[at : at + 100], at + 100
    at += 4 * bool(flags & 8)
    if raw[at : at + 4] in (b"LAME", b"Lavf", b"Lavc", b"L3.9"):
        both = int.from_bytes(raw[at + 21 : at + 24], "big")
        info.delay, info.padding = both >> 12, both & 4095
    info.table = frames, size, points


def _parse_fraunhofer(info: AudioInfo, raw: bytes) -> None:
    """The same of the other kind of table: its entries are the bytes of equal numbers of frames, as big-endian numbers times a scale."""
    if len(raw) >= 26:
        info.delay = int.from_bytes(raw[6:8], "big")
        size, frames = int.from_bytes(raw[10:14], "big"), int.from_bytes(raw[14:18], "big")
        entries, width = int.from_bytes(raw[18:20], "big"), int.from_bytes(raw[22:24], "big")
        info.table = frames, size, raw[26 : 26 + entries * width]
    else:
        info.table = 0, 0, b""


def _frame_start(units: int) -> bytes:
    head = bytes([0xFF, 0xFA, _UNITS_RATE[units] << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


_STARTS = {u: _frame_start(u) for u in _UNITS_RATE}


def write_audio(raw: bytes) -> bytes:
    """*raw*, padded with blanks to a positive multiple of 192 bytes, as an MPEG audio stream."""
    payload = raw + b" " * (-len(raw) % UNIT if raw else UNIT)
    units = len(payload) // UNIT
    parts, full = [], units // 4
    if full:
        frames = np.zeros((full, 960), np.uint8)
        frames[:, :23] = np.frombuffer(_STARTS[4], np.uint8)
        frames[:, 23 : 23 + 4 * UNIT] = np.frombuffer(payload, np.uint8, full * 4 * UNIT).reshape(full, 4 * UNIT)
        parts.append(frames.tobytes())
    if rest := units % 4:
        size = 3 * _RATES[True, 3][_UNITS_RATE[rest]]
        parts.append((_STARTS[rest] + payload[full * 4 * UNIT :]).ljust(size, b"\0"))
    sound, count = b"".join(parts), full + bool(rest)
    total = 192 + len(sound)
    points = bytes(min(255, (192 + min(k * count // 100, count - 1) * 960) * 256 // total) for k in range(100))
    table = (bytes([0xFF, 0xFB, 5 << 4 | 1 << 2, 0xC0]) + bytes(17) + b"Xing" + struct.pack(">III", 7, count, total) + points).ljust(192, b"\0")
    body = b"\x03bytes\0" + str(len(raw)).encode()
    tag = b"TXXX" + struct.pack(">I", len(body)) + b"\0\0" + body
    size = len(tag)
    return b"ID3\x04\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + tag + table + sound


def audio_payload(data: bytes, info: AudioInfo) -> bytes:
    """The stored units of a stream that write_audio() made."""
    return b"".join([data[at + 23 : at + 23 + (h.length - 23) // UNIT * UNIT] for at, h in zip(info.offsets, info.headers, strict=True)])


def describe(info: AudioInfo) -> str:
    """One line of features: format, frames, exact samples and duration, bitrates, table, checksums and seek offsets."""
    rates = sorted({h.kbps for h in info.headers})
    frames, size, points = info.table or (0, 0, b"")
    seek = crc32(np.asarray(info.offsets, ">i8").tobytes())
    return (
        f"hz={info.hertz};frames={len(info.offsets)};samples={info.samples};seconds={info.duration:.6f};kbps={','.join(map(str, rates))};"
        f"table={frames},{size},{crc32(points):08x};checked={info.checked};damaged={info.damaged};skipped={info.skipped};cut={info.cut};seek={seek:08x}"
    )


def texts_to_audio(docs: DataFrame) -> DataFrame:
    """*docs* (text, ...) with the text replaced by media, the stream that stores its UTF-8 bytes.

    Null texts are empty ones; texts of any length are stored whole. Other columns, nulls in them too, pass through, but a column
    named media is replaced. Rows and their number never change, repeated ones too; an empty table gives an empty table.
    """
    docs = docs.drop("media")
    at = docs.columns.index("text")
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                media = [write_audio((t.as_py() or "").encode("utf-8", "replace")) for t in part.column(at)]
                columns = [part.column(j) for j in range(part.num_columns) if j != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(media, pa.binary())], [*[f.name for f in rest], "media"])

    return docs.mapInArrow(run, StructType([*rest, StructField("media", BinaryType())]))


def probe_audio(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, seconds, samples, frames, offsets, tags, damaged, skipped) of each stream in the column media.

    Null or empty streams, and bytes that hold no frame, give zeros and empty lists.
    """
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_audio(m.as_py() or b"") for m in batch.column(1)]
            columns = [[x.duration for x in found], [x.samples for x in found], [len(x.offsets) for x in found], [x.offsets for x in found], [list(x.tags.items()) for x in found], [x.damaged for x in found], [x.skipped for x in found]]
            kinds = [pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.map_(pa.string(), pa.string()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], [key, "seconds", "samples", "frames", "offsets", "tags", "damaged", "skipped"])

    return media.select(key, "media").mapInArrow(run, f"`{key}` {kind}, seconds double, samples long, frames long, offsets array<long>, tags map<string,string>, damaged long, skipped long")


def audio_digests(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored streams (doc_id, media).

    Null media are empty streams. A stream that texts_to_audio() didn't write has no length tag, so its n_bytes is null, and what lies where
    the units would be counts as payload. Equal streams give equal values; repeated rows and rows without doc_id have a row each;
    other columns don't matter; an empty table gives an empty table.
    """
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m in batch.column(1):
                data = m.as_py() or b""
                info = parse_audio(data)
                payload, length = audio_payload(data, info), info.tags.get("bytes", "")
                rows.append((int(length) if length.isdecimal() else None, len(payload), sha256(payload).hexdigest(), crc32(payload[-16:]), len(data), sha256(data).hexdigest(), describe(info)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
