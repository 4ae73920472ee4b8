"""Operator 4, media columns: the Ogg container.

Written streams hold a packet per 576 samples of 8 bits in an own mapping ("PCM8"), multiplexed with a stream of notes; the
reader checks page checksums, reassembles packets from lacing values, separates logical streams by serial number and derives
timestamps from granule positions. A page that fails its checksum is left out and told of, and the search goes on at the next
capture pattern.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_rows, out_batches, text_or_empty

FRAME, RATE = 576, 8000
SAMPLES, NOTES = 0x50434D38, 0x4E4F5445
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, from 0: zlib's, mirrored."""
    raw = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_MIRROR), "big")


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = b"OggS" + struct.pack("<BBqIIIB", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return b"".join((head[:22], struct.pack("<I", checksum(head + body)), head[26:], body))


def paged(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """The pages of a logical stream; the first packet has a page of its own, and long packets go on over pages."""
    out, lacing, body, held, went_on, last = [], bytearray(), [], 0, False, -1

    def flush(flags: int = 0) -> None:
        nonlocal lacing, body, went_on, last
        out.append(page(serial, len(out), last, flags | went_on | (2 if not out else 0), bytes(lacing), b"".join(body)))
        went_on, lacing, body, last = bool(lacing) and lacing[-1] == 255, bytearray(), [], -1

    for k, (packet, granule) in enumerate(zip(packets, granules, strict=True)):
        sizes, at = [255] * (len(packet) // 255) + [len(packet) % 255], 0
        if len(lacing) + len(sizes) > 255 >= len(sizes):
            flush()
        while sizes:
            n = min(len(sizes), 255 - len(lacing))
            took = sum(sizes[:n])
            lacing += bytes(sizes[:n])
            body.append(packet[at : at + took])
            at, sizes = at + took, sizes[n:]
            if sizes:
                flush()
        last = granule
        held = k
        if k == 0 and len(packets) > 1:
            flush()
    if packets:
        flush(4)
    return out


def encode(payload: bytes, n_bytes: int) -> bytes:
    """An Ogg file of two logical streams: the payload as 8-bit samples, and a note with its length before padding."""
    head = b"PCM8" + struct.pack("<IHI", RATE, 8, FRAME)
    packets = [head, *(payload[i : i + FRAME] for i in range(0, len(payload), FRAME))]
    samples = paged(SAMPLES, packets, [0, *range(FRAME, len(payload) + 1, FRAME)])
    notes = paged(NOTES, [b"NOTE" + struct.pack("<Q", n_bytes)], [0])
    return b"".join([samples[0], *notes, *samples[1:]])


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of the page on which each packet ends; -1 if it isn't the last there
    pages: int = 0
    lost: int = 0
    ended: bool = False
    next: int | None = None
    open: list[bytes] = field(default_factory=list)


def demultiplex(data: bytes) -> tuple[dict[int, Stream], list[tuple[int, int, str]]]:
    """(streams by serial number, (start, end, reason) of bytes that are no sound page)."""
    streams: dict[int, Stream] = {}
    bad, at = [], 0

    def skip(to: int, why: str) -> None:
        nonlocal at
        bad.append((at, to, why))
        at = to

    def following(step: int) -> int:
        to = data.find(b"OggS", at + step)
        return to if to > 0 else len(data)

    while at < len(data):
        if data[at : at + 4] != b"OggS":
            skip(following(1), "no capture pattern")
            continue
        if at + 27 > len(data) or at + 27 + data[at + 26] > len(data):
            skip(following(4), "cut header")
            continue
        version, flags, granule, serial, number, check, n = struct.unpack_from("<BBqIIIB", data, at + 4)
        lacing = data[at + 27 : at + 27 + n]
        begin, end = at + 27 + n, at + 27 + n + sum(lacing)
        if version or end > len(data) or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != check:
            skip(following(4), "checksum" if end <= len(data) else "cut page")
            continue
        s = streams.setdefault(serial, Stream())
        if s.next is not None and number != s.next:
            s.lost += number - s.next
            s.open = []
        drop = bool(flags & 1) and not s.open  # the rest of a packet whose beginning is lost
        if not flags & 1:
            s.open = []
        s.next, s.pages, s.ended = number + 1, s.pages + 1, bool(flags & 4)
        done = 0
        for size in lacing:
            s.open.append(data[begin : begin + size])
            begin += size
            if size < 255:
                if not drop:
                    s.packets.append(b"".join(s.open))
                    s.granules.append(-1)
                    done += 1
                s.open, drop = [], False
        if done and granule >= 0:
            s.granules[-1] = granule
        at = end
    return streams, bad


def timestamps(stream: Stream, rate: int, samples_of) -> list[float]:
    """Seconds at which each packet ends: granule positions where given, else counted back from the next one by samples."""
    ends, following = [0] * len(stream.packets), None
    for k in range(len(stream.packets) - 1, -1, -1):
        if stream.granules[k] >= 0:
            ends[k] = stream.granules[k]
        elif following is not None:
            ends[k] = ends[following] - samples_of(stream.packets[following])
        following = k
    return [e / rate for e in ends]


def decode(media: bytes) -> tuple[bytes, int, str]:
    """(payload, its length before padding, features) from stored bytes; an error if a page is unsound or lost."""
    streams, bad = demultiplex(media)
    s, notes = streams.get(SAMPLES), streams.get(NOTES)
    if bad or not s or not notes or s.lost or not s.ended:
        raise ValueError(f"unsound Ogg: {bad[:3]}")
    rate, bits, frame = struct.unpack_from("<IHI", s.packets[0], 4)
    payload = b"".join(s.packets[1:])
    (n_bytes,) = struct.unpack_from("<Q", notes.packets[0], 4)
    ends = timestamps(s, rate, lambda p: len(p) if p[:4] != b"PCM8" else 0)
    x = np.frombuffer(payload, np.uint8)
    signed = x.astype(np.int16) - 128
    total, energy = int(signed.sum(dtype=np.int64)), int((signed.astype(np.int64) ** 2).sum())
    crossings = int(np.count_nonzero((signed[1:] < 0) != (signed[:-1] < 0)))
    feature = f"streams={len(streams)};pages={s.pages};packets={len(s.packets) - 1};rate={rate};bits={bits};seconds={ends[-1]:.6f};mean={total / len(x):.4f};power={energy / len(x):.4f};crossings={crossings}"
    return payload, n_bytes, feature


def padded(raw: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of the frame."""
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def add_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and media: each whole text as a binary Ogg column. A null text is empty; null and repeated ids and repeated rows each
    give a row; equal texts give equal media; a text of any length is one value, made in one task; an empty table gives none;
    other columns are not read."""
    schema = pa.schema([("id", pa.int64()), ("media", pa.binary())])

    def rows(batches):
        for i, text in in_rows(batches):
            raw = text.encode("utf-8")
            yield i, encode(padded(raw), len(raw))

    found = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return found.mapInArrow(lambda b: out_batches(rows(b), schema), "id long, media binary").withColumnRenamed("id", id_col)


def read_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, from stored media alone.

    A null media column gives nulls; unsound media end the job with an error that says where. Null and repeated ids and repeated
    rows each give a row, media of any length are read whole by one task each, and an empty table gives none."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = ["long", "long", "string", "long", "long", "string", "string"]
    schema = pa.schema([("id", pa.int64()), *((n, pa.int64() if k == "long" else pa.string()) for n, k in zip(names, kinds, strict=True))])

    def rows(batches):
        for i, media in in_rows(batches):
            if media is None:
                yield (i, *[None] * 7)
                continue
            payload, n, feature = decode(media)
            yield i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

    found = df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    return found.mapInArrow(lambda b: out_batches(rows(b), schema), "id long, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))).withColumnRenamed("id", id_col)
