"""Media columns: Ogg (operator 7).

A payload is stored as an Ogg physical stream of two multiplexed logical streams: stream 0 carries
the samples, stream 1 a description of them. A packet is 576 samples, one byte each; a page's
granule position is the number of samples that end in it. Reading verifies every page's checksum
and sequence number, reassembles packets from lacing values across pages, separates the streams by
serial number, and derives times from granule positions.

Defined results: a null or empty text is stored as one packet of 576 bytes 255; equal texts have
equal values; a damaged page raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkfolio.llm.common import map_texts

#: Samples (bytes) of a packet, packets of a page, and samples a second.
PACKET, PAGE_PACKETS, RATE = 576, 85, 48_000
HEAD = struct.Struct("<4sBBqIIIB")
FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
SOUND, NOTES = 0x5344, 0x4E54


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, high bit first, zero start: zlib's on bits in reverse."""
    crc = zlib.crc32(page.translate(FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(FLIP), "big")


def page(serial: int, number: int, granule: int, flags: int, laces: bytes, body: bytes) -> bytes:
    head = lambda crc: HEAD.pack(b"OggS", 0, flags, granule, serial, number, crc, len(laces))
    crc = page_checksum(head(0) + laces + body)
    return head(crc) + laces + body


def lacing(n: int) -> bytes:
    """Lacing values of a packet of n bytes; the last is below 255 and ends it."""
    return b"\xff" * (n // 255) + bytes([n % 255])


def write_ogg(payload: bytes, packet: int = PACKET, rate: int = RATE) -> bytes:
    """payload, a multiple of packet bytes, as an Ogg stream beside a stream of notes."""
    note = struct.pack("<4sIIQ", b"NOTE", packet, rate, len(payload))
    out = [page(SOUND, 0, 0, 2, lacing(8), struct.pack("<4sI", b"PCM8", rate)), page(NOTES, 0, 0, 2, lacing(len(note)), note)]
    laces, body, number, granule, at = bytearray(), bytearray(), 1, 0, 0
    one = lacing(packet)
    per = max(1, 255 // len(one))
    n = len(payload) // packet
    while at < n:
        more = min(per, n - at)
        granule = (at + more) * packet
        last = at + more == n
        out.append(page(SOUND, number, granule, 4 * last, one * more, payload[at * packet : granule]))
        if number % 64 == 0:  # the other stream's pages lie between
            out.append(page(NOTES, number // 64, granule, 0, lacing(8), struct.pack("<Q", granule)))
        number, at = number + 1, at + more
    del laces, body
    out.append(page(NOTES, number // 64 + 1 if number % 64 else number // 64, granule, 4, lacing(0), b""))
    return b"".join(out)


def read_ogg(media: bytes) -> dict[int, dict]:
    """Logical streams by serial number: packets, pages, and (granule position, packets so far) of each page where a packet ends."""
    streams: dict[int, dict] = {}
    at, end = 0, len(media)
    while at < end:
        if at + HEAD.size > end:
            raise ValueError("page header cut short")
        sign, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        if sign != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        laces = media[at + HEAD.size : at + HEAD.size + n]
        start = at + HEAD.size + n
        stop = start + sum(laces)
        if len(laces) < n or stop > end:
            raise ValueError("page cut short")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : stop]) != crc:
            raise ValueError(f"checksum differs in page {number} of stream {serial}")
        s = streams.get(serial)
        if s is None:
            if not flags & 2:
                raise ValueError("stream has no first page")
            s = streams[serial] = {"packets": [], "open": [], "pages": 0, "marks": [], "ended": False, "next": number}
        if number != s["next"] or s["ended"]:
            raise ValueError(f"page {number} of stream {serial} out of sequence")
        if bool(flags & 1) != bool(s["open"]):
            raise ValueError("continued packet has no start")
        s["next"], s["pages"], s["ended"] = number + 1, s["pages"] + 1, bool(flags & 4)
        x = start
        for v in laces:
            s["open"].append(media[x : x + v])
            x += v
            if v < 255:
                s["packets"].append(b"".join(s["open"]))
                s["open"] = []
        if granule >= 0:
            s["marks"].append((granule, len(s["packets"])))
        at = stop
    for serial, s in streams.items():
        if s["open"] or not s["ended"]:
            raise ValueError(f"stream {serial} has no end")
    return streams


def samples_of(media: bytes) -> tuple[bytes, str]:
    """The stored samples, read back, and their features as text."""
    streams = read_ogg(media)
    sound = streams[SOUND]
    payload = b"".join(sound["packets"][1:])
    _, rate = struct.unpack("<4sI", sound["packets"][0])
    _, _, _, length = struct.unpack("<4sIIQ", streams[NOTES]["packets"][0])
    last = sound["marks"][-1][0]
    if len(payload) != length or last != length:
        raise ValueError("granule position and samples differ")
    x = np.frombuffer(payload, np.uint8)
    total, square = int(x.sum(dtype=np.int64)), int(np.square(x, dtype=np.uint16).sum(dtype=np.int64))
    mean = total / len(x)
    power = (max(0.0, square / len(x) - mean * mean)) ** 0.5
    return payload, f"streams={len(streams)};pages={sound['pages']};packets={len(sound['packets']) - 1};seconds={last / rate:.6f};mean={mean:.4f};rms={power:.4f};peak={int(x.max())};first_end={sound['marks'][1][0] / rate:.6f}"


def store_as_ogg(docs: DataFrame, keys: list[str], with_media: bool = False) -> DataFrame:
    """keys of docs with the digests of the text's stored form, and that form itself if asked for."""

    def start():
        def work(texts: list[str]) -> dict[str, pa.Array]:
            rows = []
            for t in texts:
                raw = t.encode()
                media = write_ogg(raw + b"\xff" * (-len(raw) % PACKET or (0 if raw else PACKET)))
                back, feature = samples_of(media)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, media))
            cols = list(zip(*rows, strict=True))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            made = {k: pa.array(v, pa.string() if isinstance(v[0], str) else pa.int64()) for k, v in zip(names, cols, strict=False)}
            return made | ({"media": pa.array(cols[-1], pa.binary())} if with_media else {})

        return work

    schema = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_texts(docs, keys, start, schema + ", media binary" * with_media)
