"""Heads of pictures and arrays: right sizes and rows, from few bytes."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pytest

from tilewright.sources import headers as H


def png(w, h):
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    raw = b"".join(b"\0" + bytes(3 * w) for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def jpeg(w, h, frame=0xC0, before=b"", thumbnail=False):
    """Markers of a JPEG: comments and application data before the frame, which may hold a picture themselves."""
    segment = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    inner = jpeg(3, 4) if thumbnail else b""
    tables = segment(0xC4, b"\0" * 30) + segment(0xDB, b"\1" * 65)
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + inner) + before + b"\xff\xff" + segment(0xFE, b"x" * 700) + tables + segment(frame, struct.pack(">BHHB", 8, h, w, 3) + b"\0" * 9) + segment(0xDA, b"\0" * 10) + b"data\xff\xd9"


def bmp(w, h):
    return struct.pack("<2sIHHI", b"BM", 54, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, 0, 0, 0, 0, 0) + bytes(abs(h) * w * 3)


PICTURES = {
    "a.png": (png(31, 7), ("png", 31, 7)),
    "b.jpg": (jpeg(640, 480), ("jpeg", 640, 480)),
    "c/d.jpg": (jpeg(70, 90, 0xC2, b"\xff\x01", True), ("jpeg", 70, 90)),
    "e.bmp": (bmp(10, -20), ("bmp", 10, 20)),
    "f.gif": (b"GIF89a" + struct.pack("<HH", 5, 6) + bytes(20), ("gif", 5, 6)),
    "g.bmp": (b"BM" + bytes(12) + struct.pack("<IHH", 12, 8, 9) + bytes(20), ("bmp", 8, 9)),
    "h.jpg": (jpeg(640, 480), ("jpeg", 640, 480)),
    "broken.jpg": (jpeg(9, 9)[:700], (None, None, None)),
    "short.png": (png(5, 5)[:20], (None, None, None)),
    "empty.jpg": (b"", (None, None, None)),
    "text.txt": (b"hello", (None, None, None)),
}


def test_sizes(spark, tmp_path):
    for name, (data, _) in PICTURES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    sizes = H.image_sizes(spark, str(tmp_path))
    assert {r.path: (r.format, r.width, r.height) for r in sizes.collect()} == {n: want for n, (_, want) in PICTURES.items()}
    assert tuple(H.largest(sizes).first()) == (640, 480) and tuple(H.most_frequent(sizes).first()) == (640, 480, 2)
    assert sizes.rdd.getNumPartitions() < len(PICTURES)


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_a_head_is_enough():
    big = jpeg(4000, 3000) + bytes(5_000_000)
    head = H.Prefix(Bytes(big))
    assert H.picture_size(head) == ("jpeg", 4000, 3000) and head.seen <= 2048
    head = H.Prefix(Bytes(png(600, 500)))
    assert H.picture_size(head) == ("png", 600, 500) and head.seen == 512


def npy(x, version=None):
    out = io.BytesIO()
    np.lib.format.write_array(out, x, version, allow_pickle=False)
    return out.getvalue()


def test_arrays(spark, tmp_path):
    r = np.random.default_rng(2)
    made = {
        "a.npy": r.normal(size=(40, 3)), "b.npy": r.integers(0, 200, (40, 3)).astype("<i2"), "c.npy": np.asfortranarray(r.normal(size=(5, 4))),
        "d.npy": r.normal(size=7).astype(">f4"), "e.npy": np.array(3.5), "f.npy": np.empty((0, 3)), "g.npy": r.normal(size=(6, 2, 3)),
    }
    for i, (name, x) in enumerate(made.items()):
        (tmp_path / name).write_bytes(npy(x, [(1, 0), (2, 0), (3, 0)][i % 3]))
    got = lambda **k: {(x.path, x.start): np.array(x["values"]).reshape(x["shape"]) for x in H.arrays(spark, str(tmp_path), **k).collect()}
    assert {n for n, _ in got()} == set(made) and all(np.array_equal(v, made[n].astype(float)) for (n, _), v in got().items())
    assert {n for n, _ in got(dtype="float64")} == {"a.npy", "c.npy", "e.npy", "f.npy", "g.npy"} and {n for n, _ in got(dtype="int16")} == {"b.npy"}
    assert {n for n, _ in got(shape="*,3")} == {"a.npy", "b.npy", "f.npy"} and {n for n, _ in got(shape="6,*,*")} == {"g.npy"}
    for rows, cut in (("2:5", slice(2, 5)), ("4:", slice(4, None)), (":3", slice(0, 3)), ("100:200", slice(100, 200))):
        for (n, _), v in got(rows=rows, shape="*,*").items():
            assert np.array_equal(v, made[n][cut].astype(float)), (n, rows)
    parts = got(split_bytes=200, shape="40,3")
    for n in ("a.npy", "b.npy"):
        pieces = [v for (name, _), v in sorted(parts.items(), key=lambda x: x[0]) if name == n]
        assert len(pieces) > 1 and np.array_equal(np.concatenate(pieces), made[n].astype(float))
    assert np.array_equal(np.concatenate([v for (n, _), v in sorted(got(split_bytes=200, rows="9:31", dtype="float64", shape="40,*").items())]), made["a.npy"][9:31])
    (tmp_path / "z.npy").write_bytes(npy(r.normal(size=(9, 9)))[:300])
    with pytest.raises(Exception, match="cut short"):
        got(shape="9,9")


def test_only_the_wanted_bytes_are_read(tmp_path, monkeypatch):
    (tmp_path / "a.npy").write_bytes(npy(np.zeros((10_000, 50))))
    (tmp_path / "b.npy").write_bytes(npy(np.zeros((10_000, 50), "f4")))
    seen = []
    access = H.records._random_access

    def counted(path):
        f = access(path)

        class Seen(Bytes):
            def __enter__(self):
                return self

            def __exit__(self, *a):
                f.close()

            def read_at(self, n, at):
                data = f.read_at(n, at)
                seen.append(len(data))
                return data

        return Seen(b"")

    monkeypatch.setattr(H.records, "_random_access", counted)
    reader = H.ArrayFileReader({"path": str(tmp_path), "dtype": "float64", "rows": "5000:5010"})
    rows = [x for p in reader.partitions() for x in reader.read(p)]
    assert [(x[0], x[2], x[3]) for x in rows] == [("a.npy", [10, 50], 5000)]
    assert sum(seen) <= 10 * 50 * 8 + 2 * 512
