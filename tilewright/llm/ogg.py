"""Media columns: payloads stored in Ogg containers, and their features read back.

``mux`` lays packets of two logical streams into checksummed pages: stream 1
holds 8-bit mono samples, ``PACKET`` to a packet, stream 2 a comment packet
that names the sample rate. A page takes as many lacing values as it can, so
packets go on over pages. ``demux`` walks the pages, verifies each checksum
and the order of pages, reassembles packets from the lacing values, takes the
logical streams apart and derives the time of each packet from the granule
positions.

Defined results: a null text is an empty payload, padded like any other; equal
texts give equal media; a very long text is more pages; rows that repeat an id
keep their rows; ids may be of any type, and null; a page with a
wrong checksum, a gap or a broken lacing raises ``OggError``; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.words import id_kind

UNIT = 576
PAD = b"\xff"
RATE = 8000
#: Samples of a packet: seven lacing values, which don't divide the values of a page.
PACKET = 3 * UNIT
PAGE_LACING = 255
SAMPLES, COMMENTS = 1, 2
_HEADER = struct.Struct("<4sBBqIIIB")
_NO_GRANULE = -1
#: Each byte with its bits reversed: the container's checksum takes bits from the top, zlib's from the bottom.
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """The bytes are not a sound container."""


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 04c11db7, from the top bit, starting at 0 and not inverted."""
    low = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, number: int, kind: int, granule: int, packets: list[bytes]) -> bytes:
    return _laced(serial, number, kind, granule, b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets), b"".join(packets))


def _laced(serial: int, number: int, kind: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    page = _HEADER.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + struct.pack("<I", checksum(page)) + page[26:]


def mux(payload: bytes, rate: int = RATE) -> bytes:
    """The payload as packets of samples, with a comment stream beside it."""
    head = b"PCM8" + struct.pack("<IBQ", rate, 1, len(payload))
    pages = [_page(SAMPLES, 0, 2, 0, [head]), _page(COMMENTS, 0, 2, 0, [b"rate=%d" % rate]), _page(COMMENTS, 1, 4, 0, [])]
    one = lambda n: b"\xff" * (n // 255) + bytes([n % 255])
    whole, rest = divmod(len(payload), PACKET)
    lacing = one(PACKET) * whole + (one(rest) if rest else b"")
    at = done = 0
    for n, i in enumerate(range(0, len(lacing), PAGE_LACING)):
        some = lacing[i : i + PAGE_LACING]
        size, ended = sum(some), len(some) - some.count(255)
        done += ended
        granule = min(done * PACKET, len(payload)) if ended else _NO_GRANULE
        kind = (1 if i and lacing[i - 1] == 255 else 0) | (4 if i + PAGE_LACING >= len(lacing) else 0)
        pages.append(_laced(SAMPLES, n + 1, kind, granule, some, payload[at : at + size]))
        at += size
    return b"".join(pages)


@dataclass
class Stream:
    """One logical stream: its packets, the end time of each page in samples, and what is still open."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[tuple[int, int]] = field(default_factory=list)  # (packets so far, granule)
    number: int = -1
    partial: bytes = b""
    ended: bool = False


def demux(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number."""
    streams: dict[int, Stream] = {}
    at, size = 0, len(media)
    while at < size:
        if size - at < _HEADER.size:
            raise OggError("a page is cut short")
        magic, version, kind, granule, serial, number, crc, n = _HEADER.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        body = at + _HEADER.size + n
        lacing = media[at + _HEADER.size : body]
        end = body + sum(lacing)
        if len(lacing) < n or end > size:
            raise OggError("a page is cut short")
        page = media[at:end]
        if checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError(f"wrong checksum at byte {at}")
        if bool(kind & 2) == (serial in streams):
            raise OggError("a stream begins twice or not at all")
        s = streams.setdefault(serial, Stream())
        if number != s.number + 1 or s.ended or bool(kind & 1) != bool(s.partial):
            raise OggError(f"page {number} of stream {serial} is out of place")
        s.number, s.ended = number, bool(kind & 4)
        start, length = body, 0
        for value in lacing:
            length += value
            if value < 255:
                s.packets.append(s.partial + media[start : start + length])
                s.partial, start, length = b"", start + length, 0
        if length:
            s.partial += media[start : start + length]
        if granule != _NO_GRANULE:
            s.granules.append((len(s.packets), granule))
        at = end
    if any(s.partial or not s.ended for s in streams.values()):
        raise OggError("a stream does not end")
    return streams


def samples(streams: dict[int, Stream]) -> tuple[bytes, int, float]:
    """(payload, rate, seconds) of the sample stream; its granules must agree with its packets."""
    s = streams[SAMPLES]
    if s.packets[0][:4] != b"PCM8":
        raise OggError("unknown sample format")
    rate, _, length = struct.unpack("<IBQ", s.packets[0][4:])
    payload = b"".join(s.packets[1:])
    sizes = np.cumsum([0, *(len(p) for p in s.packets[1:])])
    if len(payload) != length or any(g != sizes[max(0, n - 1)] for n, g in s.granules):
        raise OggError("granule positions don't agree with the samples")
    return payload, rate, s.granules[-1][1] / rate


def page_times(streams: dict[int, Stream]) -> list[float]:
    """End time of each page of samples, in seconds."""
    rate = samples(streams)[1]
    return [g / rate for _, g in streams[SAMPLES].granules]


def padded(raw: bytes) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of ``UNIT``."""
    return raw + PAD * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text stored as a media column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(x.as_py() or "").encode() for x in batch.column(1)]
            media = pa.array((mux(padded(r)) for r in raw), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {id_kind(docs, doc_id)}, n_bytes long, media binary"
    )


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes say: payload and media digests, and a feature string of level, peak and zero crossings."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "seconds", "n_pages", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string()]

    def one(n_bytes, stored: bytes) -> tuple:
        streams = demux(stored)
        payload, _, seconds = samples(streams)
        x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
        rms = float(np.sqrt(np.mean(np.square(x, dtype=np.float64))))
        crossings = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
        feature = f"rms={rms:.4f};peak={int(np.abs(x).max())};crossings={crossings};seconds={seconds:.3f}"
        return (
            n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
            len(stored), hashlib.sha256(stored).hexdigest(), seconds, sum(s.number + 1 for s in streams.values()), feature,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(n.as_py(), m.as_py()) for n, m in zip(batch.column(1), batch.column(2))]
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run,
        f"doc_id {id_kind(media, 'doc_id')}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, seconds double, n_pages long, feature string",
    )
