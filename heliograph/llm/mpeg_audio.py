"""MPEG audio columns: frame headers, tags, seek tables, checksums and durations.

``parse`` reads the bytes of an MPEG-1, 2 or 2.5 stream of layer I, II or III:
it skips and reads ID3v2, ID3v1 and APEv2 tags, finds frames by their headers
and finds them again after damage, reads Xing/Info and VBRI tables, verifies
the CRC of protected frames, and gives the exact number of samples and the
byte offset of every audio frame.

``store`` is the inverse for arbitrary bytes: each 192-byte unit travels in one
protected layer III frame (32 kHz, mono, 48 kbit/s, 216 bytes) behind side
information that declares no coded samples, so the frames are legal and silent
and their ancillary bytes hold the unit unchanged.  An Info frame with a seek
table and an ID3v2 tag with the unpadded length go before them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from heliograph.llm.columns import add_columns

UNIT = 192

# Fixed values of the format: kbit/s by (MPEG-1?, layer), indices 1 to 14.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    mode: int
    extension: int
    samples: int
    size: int

    @property
    def channels(self) -> int:
        return 1 if self.mode == 3 else 2

    @property
    def side_bytes(self) -> int:
        """Side information of layer III."""
        if self.version == "1":
            return 17 if self.channels == 1 else 32
        return 9 if self.channels == 1 else 17

    def same_stream(self, other: Header) -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


@lru_cache(maxsize=4096)
def header(word: bytes) -> Header | None:
    """The header in four bytes; None if they are not one (free format included)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version = {3: "1", 2: "2", 0: "2.5"}.get(word[1] >> 3 & 3)
    layer = 4 - (word[1] >> 1 & 3)
    bitrate, rate = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or bitrate in (0, 15) or rate == 3 or word[3] & 3 == 2:
        return None
    kbps = BITRATES[version == "1", layer][bitrate - 1]
    hertz = RATES[rate] // {"1": 1, "2": 2, "2.5": 4}[version]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != "1" else 1152
    slot = 4 if layer == 1 else 1
    size = (samples // 8 // slot * kbps * 1000 // hertz + (word[2] >> 1 & 1)) * slot
    return Header(version, layer, not word[1] & 1, kbps, hertz, word[3] >> 6, word[3] >> 4 & 3, samples, size)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFF00) ^ _CRC[(c >> 8) ^ b]
    return c


def checksum(h: Header, frame: bytes) -> bool | None:
    """Whether the frame's CRC holds; None without one, and for layer II, whose
    covered length depends on its allocation tables."""
    if not h.protected or h.layer == 2 or len(frame) < 6:
        return None
    if h.layer == 3:
        covered = h.side_bytes
    else:
        bound = 4 * h.extension + 4 if h.mode == 1 else 32
        covered = 16 if h.channels == 1 else (bound * 2 + 32 - bound) // 2
    return crc16(frame[2:4] + frame[6 : 6 + covered]) == int.from_bytes(frame[4:6], "big")


@dataclass
class Audio:
    header: Header | None = None
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    samples: int = 0
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0
    resyncs: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: list[int] = field(default_factory=list)
    variable: bool = False
    truncated: bool = False

    @property
    def duration_us(self) -> int:
        """Exact up to the rounding to whole microseconds (downwards)."""
        return self.samples * 1_000_000 // self.header.rate if self.header else 0


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(raw: bytes) -> list[str]:
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 0, "latin-1")
    return raw[1:].decode(kind, errors="replace").rstrip("\0").split("\0")


def _id3v2(data: bytes, out: Audio) -> int:
    """Reads the tag at the start; gives the position after it."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 127:
        return 0
    end = min(10 + _synchsafe(data[6:10]) + (10 if data[5] & 0x10 else 0), len(data))
    major, at = data[3], 10
    if data[5] & 0x40 and at + 4 <= end:
        at += _synchsafe(data[at : at + 4]) if major == 4 else 4 + int.from_bytes(data[at : at + 4], "big")
    head = 6 if major == 2 else 10
    while at + head <= end and data[at] != 0:
        name = data[at : at + (3 if major == 2 else 4)].decode("latin-1")
        raw = data[at + 3 : at + 6] if major == 2 else data[at + 4 : at + 8]
        size = _synchsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        body = data[at + head : min(at + head + size, end)]
        if name in ("TXXX", "TXX"):
            parts = _text(body)
            out.tags[f"TXXX:{parts[0]}"] = "\0".join(parts[1:])
        elif name.startswith("T"):
            out.tags[name] = "/".join(_text(body))
        else:
            out.tags.setdefault(name, str(len(body)))
        at += head + size
    return end


def _id3v1(data: bytes, end: int, tags: dict[str, str]) -> int:
    for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
        if value := data[end - 128 + a : end - 128 + b].split(b"\0")[0].decode("latin-1").strip():
            tags[f"ID3v1:{name}"] = value
    return end - 128


def _ape(data: bytes, end: int, tags: dict[str, str]) -> int:
    size, flags = struct.unpack("<I", data[end - 20 : end - 16])[0], struct.unpack("<I", data[end - 12 : end - 8])[0]
    tags["APE"] = str(struct.unpack("<I", data[end - 16 : end - 12])[0])
    return max(0, end - size - (32 if flags >> 31 else 0))


def _framed(data: bytes, start: int, mark: int, end: int) -> bool:
    """Whether frames run without a gap from ``mark`` or before it to ``end``."""
    walked, at = _walk(data, start, end, Audio()), end
    for offset, size in zip(reversed(walked.offsets), reversed(walked.sizes), strict=True):
        if at <= mark or offset + size != at:
            break
        at = offset
    return at <= mark


def _tail_tags(data: bytes, start: int, out: Audio) -> int:
    """Reads tags at the end; gives the position where audio ends.

    A mark inside frames that run on to the end is their content, not a tag.
    """
    end = len(data)
    for word, length, read in ((b"TAG", 128, _id3v1), (b"APETAGEX", 32, _ape)):
        mark = end - length
        if mark >= 0 and data.startswith(word, mark) and not _framed(data, start, mark, end):
            end = read(data, end, out.tags)
    return end


def _seek_table(h: Header, frame: bytes, out: Audio) -> bool:
    """Reads a Xing, Info or VBRI table from the first frame, if that is one."""
    at = 4 + (2 if h.protected else 0) + h.side_bytes
    if h.layer == 3:
        for place in (at, 4 + h.side_bytes):
            if frame[place : place + 4] in (b"Xing", b"Info"):
                out.table, at = frame[place : place + 4].decode(), place + 8
                flags = int.from_bytes(frame[place + 4 : at], "big")
                if flags & 1:
                    out.table_frames, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
                if flags & 2:
                    out.table_bytes, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
                if flags & 4:
                    out.toc = list(frame[at : at + 100])
                return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.table = "VBRI"
        out.table_bytes, out.table_frames = struct.unpack(">II", frame[46:54])
        entries, scale, width, _ = struct.unpack(">HHHH", frame[54:62])
        body = frame[62 : 62 + entries * width]
        out.toc = [int.from_bytes(body[i : i + width], "big") * scale for i in range(0, len(body) - width + 1, width)] if width else []
        return True
    return False


def parse(data: bytes) -> Audio:
    """Everything above from one stream.  Empty or foreign bytes give no frames.

    Before the first frame and after damage, a header counts only if another
    one of the same stream, or the end of the audio, follows at its size.
    Bytes between frames are counted as skipped; a last frame cut short is not
    counted and marks the stream as truncated.
    """
    out, head = Audio(), Audio()
    start = _id3v2(data, head)
    end = _tail_tags(data, start, out)
    for name, value in head.tags.items():
        if name.startswith("T"):
            out.tags[name] = value
        else:
            out.tags.setdefault(name, value)
    return _walk(data, start, end, out)


def _walk(data: bytes, at: int, end: int, out: Audio) -> Audio:
    locked = lost = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h is not None and out.header is not None and not h.same_stream(out.header):
            h = None
        if h is not None and not locked:
            after = header(data[at + h.size : at + h.size + 4]) if at + h.size + 4 <= end else None
            if at + h.size != end and (after is None or not after.same_stream(h)):
                h = None
        if h is None:
            if not lost:
                out.resyncs += out.header is not None
            lost, locked = True, False
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            out.skipped += step - at
            at = step
            continue
        if at + h.size > end:
            out.truncated = True
            break
        frame = data[at : at + h.size]
        lost, locked = False, True
        good = checksum(h, frame)
        out.crc_good += good is True
        out.crc_bad += good is False
        if out.header is None:
            out.header = h
            if _seek_table(h, frame, out):
                at += h.size
                continue
        out.variable |= h.kbps != out.header.kbps
        out.offsets.append(at)
        out.sizes.append(h.size)
        out.samples += h.samples
        at += h.size
    return out


# MPEG-1, layer III, protected; 48 kbit/s, 32 kHz, no padding; mono
_WORD = bytes([0xFF, 0xFA, 0x38, 0xC0])
_SIDE = bytes(17)
_HEAD = _WORD + crc16(_WORD[2:] + _SIDE).to_bytes(2, "big") + _SIDE
_FRAME = header(_WORD).size
_FILL = bytes(_FRAME - len(_HEAD) - UNIT)


def _tag(n: int) -> bytes:
    body = b"\x03payload-bytes\0" + str(n).encode()
    frame = b"TXXX" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + b"\0\0" + body
    return b"ID3\x04\0\0" + bytes([0, 0, len(frame) >> 7, len(frame) & 127]) + frame


def pad(text: bytes) -> bytes:
    """Blanks up to a positive multiple of the unit."""
    return text + b" " * ((-len(text)) % UNIT if text else UNIT)


def store(payload: bytes, n: int) -> bytes:
    """A stream that holds ``payload`` (a multiple of the unit), of which ``n`` bytes count."""
    units = len(payload) // UNIT
    toc = bytes(min(255, (i * units // 100 + 1) * 256 // (units + 1)) for i in range(100))
    info = b"Info" + (7).to_bytes(4, "big") + units.to_bytes(4, "big") + ((units + 1) * _FRAME).to_bytes(4, "big") + toc
    parts = [_tag(n), _HEAD, info, bytes(_FRAME - len(_HEAD) - len(info))]
    for i in range(0, len(payload), UNIT):
        parts += (_HEAD, payload[i : i + UNIT], _FILL)
    return b"".join(parts)


def load(data: bytes, audio: Audio | None = None) -> tuple[bytes, int]:
    """The payload that ``store`` put in, and its unpadded length, both read from the stream."""
    audio = audio or parse(data)
    first = len(_HEAD)
    payload = b"".join([data[i + first : i + first + UNIT] for i in audio.offsets])
    return payload, int(audio.tags.get("TXXX:payload-bytes", len(payload)))


def feature(audio: Audio) -> str:
    """Format, counts, duration and places of the first, middle and last frame."""
    h, at = audio.header, audio.offsets
    if h is None:
        return "none"
    seek = f"{at[0]},{at[len(at) // 2]},{at[-1]}" if at else ""
    return (
        f"mpeg{h.version}-layer{h.layer};hz={h.rate};ch={h.channels};frames={len(at)};samples={audio.samples};us={audio.duration_us};"
        f"crc={audio.crc_good}/{audio.crc_good + audio.crc_bad};resyncs={audio.resyncs};table={audio.table}:{audio.table_frames}:{audio.table_bytes};seek={seek}"
    )


PARSED = {
    "audio_version": "string", "audio_layer": "int", "sample_rate": "int", "channels": "int", "frames": "bigint", "samples": "bigint", "duration_us": "bigint", "variable_rate": "boolean",
    "crc_good": "bigint", "crc_bad": "bigint", "skipped_bytes": "bigint", "resyncs": "bigint", "truncated": "boolean", "seek_table": "string", "table_frames": "bigint", "table_bytes": "bigint",
    "tags": "map<string,string>", "seek_offsets": "array<bigint>",
}


def _parsed(column: pa.Array) -> list[pa.Array]:
    rows = []
    for value in column:
        raw = value.as_py()
        a = parse(raw) if raw is not None else None
        h = a.header if a else None
        rows.append(
            (None,) * len(PARSED) if a is None else (
                h and h.version, h and h.layer, h and h.rate, h and h.channels, len(a.offsets), a.samples, a.duration_us, a.variable, a.crc_good, a.crc_bad, a.skipped, a.resyncs, a.truncated,
                a.table or None, a.table_frames, a.table_bytes, list(a.tags.items()), a.offsets,
            )
        )
    kinds = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<bigint>": pa.list_(pa.int64())}[k] for k in PARSED.values()]
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]


def parse_column(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with the columns ``PARSED`` of a binary column; null media gives nulls.

    Bytes without a frame give null format columns and zero counts.  Columns of
    the same names are replaced, others pass through; equal rows stay.
    """
    return add_columns(df, media_col, PARSED, _parsed)


def store_column(df: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """``df`` with a stream that holds the padded UTF-8 bytes of each text (null: empty)."""

    def make(column: pa.Array) -> list[pa.Array]:
        media = []
        for value in column:
            raw = (value.as_py() or "").encode()
            media.append(store(pad(raw), len(raw)))
        return [pa.array(media, pa.binary())]

    return add_columns(df, text_col, {out: "binary"}, make)


DIGEST = {"n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}


def _digests(column: pa.Array) -> Iterator[tuple]:
    for value in column:
        media = value.as_py()
        if media is None:
            yield (None,) * len(DIGEST)
            continue
        audio = parse(media)
        payload, n = load(media, audio)
        yield n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(audio)


def digest_column(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with digests of what is read back from a column of stored streams."""

    def make(column: pa.Array) -> list[pa.Array]:
        rows = list(_digests(column))
        return [pa.array([r[i] for r in rows], pa.int64() if k == "bigint" else pa.string()) for i, k in enumerate(DIGEST.values())]

    return add_columns(df, media_col, DIGEST, make)
