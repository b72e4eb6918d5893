"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, durations and seek offsets.

The writer stores a payload losslessly in silent MPEG-1 layer III frames: header, CRC-16 and side information
describe an empty granule pair, and the rest of each frame is ancillary data, which decoders skip. The unit of the
format is the frame's byte. The reader takes any MPEG audio bytes: it skips tags, finds frames again after damage,
and checks what carries a checksum.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the MPEG audio header.
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
PAD_UNIT = 576


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2, or 25 for 2.5
    layer: int
    protected: bool
    bitrate: int
    rate: int
    channels: int
    samples: int
    length: int
    side: int  # bytes of side information after header and checksum; 0 but for layer III

    @property
    def body(self) -> int:
        return 4 + 2 * self.protected + self.side


_headers: dict[int, Header | None] = {}


def parse_header(word: int) -> Header | None:
    """The header in four bytes, or None if they are no header of known length."""
    if word in _headers:
        return _headers[word]
    found = None
    version_id, layer_id, rate_id, bit_id = word >> 19 & 3, word >> 17 & 3, word >> 10 & 3, word >> 12 & 15
    if word >> 21 == 0x7FF and version_id != 1 and layer_id and rate_id != 3 and bit_id not in (0, 15) and word & 3 != 2:
        low, layer = version_id != 3, 4 - layer_id
        kbps, rate, pad = BITRATES[2 if low else 1, layer][bit_id], RATES[version_id][rate_id], word >> 9 & 1
        samples = 384 if layer == 1 else 576 if layer == 3 and low else 1152
        length = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
        mono = word >> 6 & 3 == 3
        side = 0 if layer != 3 else (9 if mono else 17) if low else 17 if mono else 32
        if length > 4 + side + 2:
            found = Header({3: 1, 2: 2, 0: 25}[version_id], layer, not word >> 16 & 1, kbps, rate, 1 if mono else 2, samples, length, side)
    if len(_headers) < 4096:
        _headers[word] = found
    return found


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        table.append(value)
    return table


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The frame checksum: over the last two header bytes and the side information."""
    value = 0xFFFF
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ _CRC[value >> 8 ^ byte]
    return value


@dataclass
class Audio:
    """What a column of MPEG audio holds about one value."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)  # of audio frames, the table's frame left out
    headers: list[Header] = field(default_factory=list)
    skipped: int = 0  # bytes between frames
    resyncs: int = 0
    crc_checked: int = 0
    crc_failed: int = 0
    vbr: dict = field(default_factory=dict)

    @property
    def duration(self) -> Fraction:
        """Seconds, exactly."""
        by_rate: dict[int, int] = {}
        for h in self.headers:
            by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
        return sum((Fraction(n, rate) for rate, n in by_rate.items()), Fraction(0))


def syncsafe(value: int) -> bytes:
    return bytes(value >> s & 0x7F for s in (21, 14, 7, 0))


def _unsyncsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def read_tags(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of a leading ID3v2 tag, and where the audio begins."""
    tags: dict[str, str] = {}
    begin = 0
    if data[:3] == b"ID3" and len(data) >= 10 and all(b < 128 for b in data[6:10]):
        size = min(_unsyncsafe(data[6:10]), len(data) - 10)
        at, begin = 10, 10 + size + (10 if data[5] & 0x10 else 0)
        while at + 10 <= 10 + size and data[at] != 0:
            name = data[at : at + 4].decode("latin-1")
            n = _unsyncsafe(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8])
            body = data[at + 10 : at + 10 + n]
            if name[0] == "T" and body:
                text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace")
                key, sep, value = text.partition("\0")
                tags[f"TXXX:{key}" if name == "TXXX" else name] = value.rstrip("\0") if name == "TXXX" and sep else text.rstrip("\0")
            at += 10 + n
    return tags, min(begin, len(data))


def read_trailer(tag: bytes) -> dict[str, str]:
    """Fields of an ID3v1 tag of 128 bytes."""
    fields = (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97))
    found = {f"ID3v1:{name}": tag[a:b].split(b"\0")[0].decode("latin-1").strip() for name, a, b in fields}
    return {k: v for k, v in found.items() if v}


def _vbr_table(frame: bytes, header: Header) -> dict:
    """The table in the first frame: Xing or Info after the side information, or VBRI at byte 36."""
    at = 4 + header.side
    for at in (4 + header.side, header.body):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            kind, flags, at = frame[at : at + 4].decode(), int.from_bytes(frame[at + 4 : at + 8]), at + 8
            found: dict = {"kind": kind}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    found[name] = int.from_bytes(frame[at : at + 4])
                    at += 4
            if flags & 4:
                found["toc"] = list(frame[at : at + 100])
            return found
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, count, entries, scale, width, each = struct.unpack(">IIHHHH", frame[46:62])
        entries = min(entries, (len(frame) - 62) // width if width else 0)  # no further than the frame reaches
        values = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width]) * scale for i in range(entries)]
        return {"kind": "VBRI", "bytes": size, "frames": count, "toc": values, "frames_per_entry": each}
    return {}


def parse(data: bytes) -> Audio:
    """Tags, frames, table and checksums of one value.

    A frame counts when its header is valid and another header of the same version, layer and rate, or the end of
    the audio, follows it; else the next byte that can begin such a pair is sought. The audio ends with the value, or
    at an ID3v1 tag in its last 128 bytes where no frame that counts reaches into them: bytes inside a frame are
    never a tag, whatever they look like.
    """
    audio = Audio()
    audio.tags, at = read_tags(data)
    end, trailer = len(data), len(data) - 128
    if trailer < at or data[trailer : trailer + 3] != b"TAG":
        trailer = end
    lost = False

    def header_at(pos: int) -> Header | None:
        return parse_header(int.from_bytes(data[pos : pos + 4])) if pos + 4 <= end else None

    h = header_at(at)
    first = True
    while at < end:
        if at == trailer or lost and at > trailer:
            audio.tags |= read_trailer(data[trailer:])
            break
        follows = None
        if h is not None and at + h.length <= end:
            follows = header_at(at + h.length)
            agrees = at + h.length in (end, trailer) or follows is not None and (follows.version, follows.layer, follows.rate) == (h.version, h.layer, h.rate)
            if not agrees and not lost and audio.headers and (audio.headers[-1].version, audio.headers[-1].layer, audio.headers[-1].rate) == (h.version, h.layer, h.rate):
                agrees = True  # the frame before vouches for it; the damage lies behind
        else:
            agrees = False
        if agrees:
            if h.protected and h.layer == 3:
                audio.crc_checked += 1
                given = data[at + 4] << 8 | data[at + 5]
                audio.crc_failed += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) != given
            table = _vbr_table(data[at : at + h.length], h) if first and h.layer == 3 else {}
            if table:
                audio.vbr = table
            else:
                audio.offsets.append(at)
                audio.headers.append(h)
            first, lost = False, False
            at += h.length
            h = follows
        else:
            audio.resyncs += not lost
            lost = True
            nxt = data.find(b"\xff", at + 1, trailer)
            nxt = max(at + 1, trailer) if nxt < 0 else nxt
            audio.skipped += nxt - at
            at = nxt
            h = header_at(at)
    return audio


def payload_of(data: bytes, audio: Audio) -> bytes:
    """The ancillary bytes of all frames, cut to the length that the writer's tag names."""
    parts = [data[o + h.body : o + h.length] for o, h in zip(audio.offsets, audio.headers, strict=True)]
    return b"".join(parts)[: int(audio.tags.get("TXXX:payload_bytes", "0"))]


def _frame_head(bit_id: int) -> bytes:
    """Header, checksum and side information of a silent mono MPEG-1 layer III frame at 32 kHz."""
    word = (0x7FF << 21 | 3 << 19 | 1 << 17 | 0 << 16 | bit_id << 12 | 2 << 10 | 3 << 6).to_bytes(4)
    side = bytes(17)
    return word + crc16(word[2:] + side).to_bytes(2) + side


_HEADS = {b: _frame_head(b) for b in range(1, 15)}
_LENGTHS = {b: parse_header(int.from_bytes(_HEADS[b][:4])).length for b in _HEADS}


def write(payload: bytes) -> bytes:
    """A payload as MPEG audio: an ID3v2 tag with its length, a Xing table, then frames that carry it.

    All frames have the highest bitrate but the last, which has the lowest that fits: a variable bitrate.
    """
    text = b"\x03payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + syncsafe(len(text)) + b"\0\0" + text
    out = [b"ID3\x04\0\0" + syncsafe(len(tag)) + tag]
    head, room = _HEADS[14], _LENGTHS[14] - len(_HEADS[14])
    full = len(payload) // room
    frames = []
    if full:
        grid = np.empty((full, _LENGTHS[14]), np.uint8)
        grid[:, : len(head)] = np.frombuffer(head, np.uint8)
        grid[:, len(head) :] = np.frombuffer(payload, np.uint8, full * room).reshape(full, room)
        frames.append(grid.tobytes())
    rest = payload[full * room :]
    if rest:
        bit_id = next(b for b in _HEADS if _LENGTHS[b] - len(_HEADS[b]) >= len(rest))
        frames.append(_HEADS[bit_id] + rest + bytes(_LENGTHS[bit_id] - len(_HEADS[bit_id]) - len(rest)))
    count, size = full + bool(rest), sum(map(len, frames))
    table_id = 5  # the smallest frame that holds the table
    total = size + _LENGTHS[table_id]
    starts = [_LENGTHS[table_id] + min(i * count // 100, count) * _LENGTHS[14] for i in range(100)]
    toc = bytes(min(255, s * 256 // total) for s in starts)
    table = b"Xing" + (7).to_bytes(4) + count.to_bytes(4) + total.to_bytes(4) + toc
    out.append(_HEADS[table_id] + table + bytes(_LENGTHS[table_id] - len(_HEADS[table_id]) - len(table)))
    return b"".join(out + frames)


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, filled with bytes 255 to a positive multiple of PAD_UNIT, and their length before."""
    data = (text or "").encode()
    return data + b"\xff" * (max(1, -(-len(data) // PAD_UNIT)) * PAD_UNIT - len(data)), len(data)


def store_media(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and the media column that holds each text's padded bytes, one row for each row.

    A null text counts as empty; repeated rows give equal rows; an empty table gives an empty one; other columns are
    ignored; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lengths, media = [], []
                for text in part.column(1):
                    payload, n = padded(text.as_py())
                    lengths.append(n)
                    media.append(write(payload))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def describe_media(media: DataFrame) -> DataFrame:
    """Reads a media column back: digests of the stored form and of its payload, and the features of the audio.

    ``media`` has doc_id, n_bytes and media. duration_us is the exact duration rounded down to microseconds; the
    exact fraction stands in the feature. Values that are no audio, null ones included, give no frame, an empty
    payload and duration 0; repeated rows give equal rows; an empty table an empty one.
    """
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        "n_frames long, duration_us long, crc_failed long, resyncs long, seek_offsets array<long>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            rows = []
            for n_bytes, value in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = value.as_py() or b""
                audio = parse(data)
                payload = payload_of(data, audio)
                seek = hashlib.sha256(np.array(audio.offsets, "<i8").tobytes()).hexdigest()[:16]
                d = audio.duration
                feature = f"frames={len(audio.offsets)};duration={d.numerator}/{d.denominator};crc={audio.crc_checked - audio.crc_failed}/{audio.crc_checked};vbr={audio.vbr.get('kind', '-')}:{audio.vbr.get('frames', 0)}:{audio.vbr.get('bytes', 0)};skipped={audio.skipped};seek={seek}"
                rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(audio.offsets), int(d * 1_000_000), audio.crc_failed, audio.resyncs, audio.offsets))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
