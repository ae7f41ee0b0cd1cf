"""Containers: round trips, damage, features."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tilewright.llm import ogg as O


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    r = random.Random(1)
    for n in (0, 1, 27, 500):
        data = r.randbytes(n)
        assert O.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 84, 576 * 84 + 1, 200_000])
def test_round_trip(n):
    raw = random.Random(n).randbytes(n)
    payload = O.padded(raw)
    assert payload[:n] == raw and len(payload) % 576 == 0 and len(payload) >= 576 and set(payload[n:]) <= {255}
    streams = O.demux(O.mux(payload))
    back, rate, seconds = O.samples(streams)
    assert back == payload and rate == 8000 and seconds == len(payload) / 8000
    assert streams[O.COMMENTS].packets == [b"rate=8000"]
    assert O.page_times(streams)[-1] == seconds


def test_packets_over_pages_and_lacing():
    # A packet of 255 bytes needs a closing zero; a packet may go on over pages.
    whole = O._page(9, 0, 2, 5, [b"a" * 255, b"", b"b" * 256])
    assert O.demux(whole + O._page(9, 1, 4, 6, []))[9].packets == [b"a" * 255, b"", b"b" * 256]
    first = bytearray(O._HEADER.pack(b"OggS", 0, 2, -1, 9, 0, 0, 1) + b"\xff" + b"c" * 255)
    first[22:26] = O.checksum(bytes(first)).to_bytes(4, "little")
    assert O.demux(bytes(first) + O._page(9, 1, 5, 7, [b"d" * 3]))[9].packets == [b"c" * 255 + b"ddd"]


def test_damage_is_found():
    media = O.mux(O.padded(b"hello" * 1000))
    for at in range(0, len(media), 97):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(O.OggError):
            O.demux(bytes(bad))
    for cut in (10, len(media) // 2, len(media) - 1):
        with pytest.raises(O.OggError):
            O.demux(media[:cut])


def test_query_rows(spark):
    rows = [(1, "Hello", "x"), (2, "Hello", "x"), (3, None, "x"), (None, "é" * 600, "x"), (1, "Hello", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = O.features(O.encode(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        payload = O.padded(text.encode())
        media = O.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(text.encode()), len(payload), len(media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
    assert len({r.feature for r in got if r.doc_id in (1, 2)}) == 1
    assert O.features(O.encode(docs.limit(0))).count() == 0


def test_packets_of_samples_go_on_over_pages():
    payload = O.padded(random.Random(2).randbytes(400_000))
    media = O.mux(payload)
    at, seen = 0, []
    while at < len(media):
        _, _, kind, granule, serial, number, _, n = O._HEADER.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        if serial == O.SAMPLES and number:
            seen.append((bool(kind & 1), lacing[-1] == 255, granule, sum(lacing)))
        at += 27 + n + sum(lacing)
    assert sum(size for *_, size in seen) == len(payload) and sum(goes_on for goes_on, *_ in seen) >= 5
    assert all(later[0] == before[1] for before, later in zip(seen, seen[1:])) and not seen[-1][1]
    upto = 0
    for _, _, granule, size in seen:
        upto += size
        assert granule == (len(payload) if upto == len(payload) else upto // O.PACKET * O.PACKET)
