"""Sources read files that the tests write in the public formats."""

from __future__ import annotations

import io
import json
import struct
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.sources import coco, files, records, wire


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    """(number, value): bytes, integers and 4-byte floats."""
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


def feature(values):
    if isinstance(values[0], bytes):
        return message((1, message(*((1, v) for v in values))))
    if isinstance(values[0], float):
        return message((2, message((1, struct.pack(f"<{len(values)}f", *values)))))
    return message((3, message((1, b"".join(map(varint, values))))))


def example(**features):
    return message((1, message(*((1, message((1, k.replace("__", "/").encode()), (2, feature(v)))) for k, v in features.items()))))


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    records.register(spark)


def test_checksum_value():
    assert records.crc32c(b"123456789") == 0xE3069283


def tfrecord(*payloads):
    out = b""
    for p in payloads:
        head = struct.pack("<Q", len(p))
        out += head + struct.pack("<I", records.masked_crc(head)) + p + struct.pack("<I", records.masked_crc(p))
    return out


def test_tfrecord(spark, tmp_path):
    a = example(image__encoded=[b"\xff\xd8a"], image__class__label=[7], image__filename=[b"a.jpg"])
    b = example(image__encoded=[b"\xff\xd8b"], image__class__label=[-1], image__height=[10], image__width=[20], image__object__bbox__xmin=[0.5], image__object__bbox__ymin=[0.25], image__object__bbox__xmax=[1.0], image__object__bbox__ymax=[0.5], image__object__class__label=[3])
    (tmp_path / "x.tfrecord").write_bytes(tfrecord(a, b))
    (tmp_path / "y.tfrecord").write_bytes(tfrecord(a))
    table = spark.read.format("tfrecord").load(str(tmp_path))
    assert table.rdd.getNumPartitions() == 2 and table.count() == 3
    rows = {r.name: r for r in records.tf_classification(table.where("file = 'x.tfrecord'")).collect()}
    assert rows["a.jpg"].label == 7 and rows["x.tfrecord_1"].label == -1 and bytes(rows["a.jpg"].content) == b"\xff\xd8a"
    found = records.tf_detection(table.where("file = 'x.tfrecord' and record = 1")).first()
    assert found.labels == [3] and tuple(found.boxes[0]) == (10.0, 2.5, 20.0, 5.0)
    (tmp_path / "bad.tfrecord").write_bytes(tfrecord(a)[:-1] + b"\0")
    with pytest.raises(Exception, match="checksum"):
        spark.read.format("tfrecord").load(str(tmp_path / "bad.tfrecord")).collect()


def test_recordio(spark, tmp_path):
    def record(flag, label, image_id, payload):
        data = struct.pack("<IfQQ", flag, label, image_id, 0) + payload
        return struct.pack("<II", records.RecordIOReader.MAGIC, len(data)) + data + b"\0" * (-len(data) % 4)

    (tmp_path / "a.rec").write_bytes(record(0, 3.0, 11, b"jpeg1") + record(2, 0.0, 12, b"many") + record(0, 4.0, 13, b"jpg"))
    rows = [(r.name, r.label, bytes(r.content)) for r in spark.read.format("recordio").load(str(tmp_path)).orderBy("image_id").collect()]
    assert rows == [("11", 3, b"jpeg1"), ("13", 4, b"jpg")]


def test_webdataset(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name, data in (("d/s1.jpg", b"1"), ("d/s1.cls", b"5"), ("d/s2.jpg", b"2"), ("s3.seg.png", b"3")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    table = spark.read.format("webdataset").load(str(tmp_path))
    assert {r.key: {k: bytes(v) for k, v in r.components.items()} for r in table.collect()} == {"d/s1": {"jpg": b"1", "cls": b"5"}, "d/s2": {"jpg": b"2"}, "s3": {"seg.png": b"3"}}
    assert records.web_components(table, [["jpg", "png"], ["cls"]]).count() == 3
    assert [r.key for r in records.web_components(table, [["jpg"], ["cls"]], "skip").collect()] == ["d/s1"]
    with pytest.raises(Exception, match="missing component"):
        records.web_components(table, [["jpg"], ["cls"]], "error").collect()


def lmdb_file(items, size=4096, split=3):
    """A database of leaves under one branch page, with overflow pages for large values."""
    pages = {}
    leaves, at = [], 2
    items = sorted(items)
    for i in range(0, len(items), split):
        number, at = at, at + 1
        nodes = []
        for key, value in items[i : i + split]:
            if len(value) > size // 4:
                count = -(-(len(value) + 16) // size)
                body = struct.pack("<QHHI", at, 0, 4, count) + value
                for k in range(count):
                    pages[at + k] = body[k * size : (k + 1) * size].ljust(size, b"\0")
                nodes.append((len(value), 1, key, struct.pack("<Q", at)))
                at += count
            else:
                nodes.append((len(value), 0, key, value))
        pages[number] = page(number, 2, [struct.pack("<HHHH", n & 0xFFFF, n >> 16, f, len(k)) + k + v for n, f, k, v in nodes], size)
        leaves.append((number, items[i][0]))
    root, at = at, at + 1
    pages[root] = page(root, 1, [struct.pack("<HHHH", n & 0xFFFF, n >> 16, 0, 0 if j == 0 else len(k)) + (b"" if j == 0 else k) for j, (n, k) in enumerate(leaves)], size)
    for m in (0, 1):
        empty = struct.pack("<IHHQQQQQ", size, 0, 0, 0, 0, 0, 0, (1 << 64) - 1)
        main = struct.pack("<IHHQQQQQ", 0, 0, 2, 1, len(leaves), 0, len(items), root if m else (1 << 64) - 1)
        pages[m] = (struct.pack("<QHHI", m, 0, 8, 0) + struct.pack("<IIQQ", 0xBEEFC0DE, 1, 0, at * size) + empty + main + struct.pack("<QQ", at - 1, m)).ljust(size, b"\0")
    return b"".join(pages[i] for i in range(at))


def page(number, flags, nodes, size):
    body, offsets, upper = bytearray(size), [], size
    for n in nodes:
        n += b"\0" * (len(n) % 2)
        upper -= len(n)
        body[upper : upper + len(n)] = n
        offsets.append(upper)
    body[:16] = struct.pack("<QHHHH", number, 0, flags, 16 + 2 * len(offsets), upper)
    body[16 : 16 + 2 * len(offsets)] = struct.pack(f"<{len(offsets)}H", *offsets)
    return bytes(body)


def test_lmdb_and_caffe(spark, tmp_path):
    datum = message((1, 3), (2, 8), (3, 8), (4, b"x" * 9000), (5, 6))
    box = message((1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, 9))
    annotated = message((1, message((4, b"img"), (5, 2))), (2, 0), (3, message((1, 9), (2, message((1, 0), (2, box))))))
    items = [(f"{i:08d}".encode(), datum if i == 4 else annotated if i == 5 else message((4, bytes([i])), (5, i))) for i in range(8)]
    (tmp_path / "data.mdb").write_bytes(lmdb_file(items))
    table = spark.read.format("lmdb").load(str(tmp_path))
    assert table.rdd.getNumPartitions() == 3
    assert {r.name: bytes(r.value) for r in table.collect()} == {k.decode(): v for k, v in items}
    rows = {r.name: r for r in records.caffe(table).collect()}
    assert rows["00000004"].label == 6 and len(rows["00000004"].content) == 9000
    assert tuple(rows["00000005"].boxes[0]) == (1.0, 2.0, 4.0, 6.0) and rows["00000005"].labels == [9] and bytes(rows["00000005"].content) == b"img"
    assert tuple(rows["00000001"].boxes[0]) == (0.0, 0.0, 1.0, 1.0) and rows["00000001"].labels == [0]


def test_caffe2(spark, tmp_path):
    dims = lambda *d: b"".join(varint(8) + varint(x) for x in d)
    protos = message((1, dims(1) + message((2, 4), (6, b"jpeg"))), (1, dims(1) + message((2, 2), (4, varint(5)))), (1, dims(1, 2, 3, 4)))
    (tmp_path / "data.mdb").write_bytes(lmdb_file([(b"k", protos), (b"m", message((1, message((5, b"raw")))))]))
    rows = {r.name: r for r in records.caffe2(spark.read.format("lmdb").load(str(tmp_path))).collect()}
    assert bytes(rows["k"].content) == b"jpeg" and rows["k"].label == 5 and tuple(rows["k"].boxes[0]) == (1.0, 2.0, 4.0, 6.0)
    assert bytes(rows["m"].content) == b"raw" and rows["m"].labels == [0]


def test_wire_negative_and_unpacked():
    assert wire.ints(0, (1 << 64) - 5) == [-5] and wire.ints(2, varint(-1) + varint(300)) == [-1, 300]


def test_npy(spark, tmp_path):
    a = np.arange(6, dtype="<f4").reshape(2, 3)
    np.save(tmp_path / "c.npy", a)
    np.save(tmp_path / "f.npy", np.asfortranarray(a))
    rows = files.npy_files(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and all(r.shape == [2, 3] and r["values"] == list(range(6)) for r in rows)
    buffer = io.BytesIO()
    np.save(buffer, np.arange(3, dtype=">i4"))
    with pytest.raises(ValueError, match="big-endian"):
        files.parse_npy(buffer.getvalue())


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_wav(spark, tmp_path, bits):
    n = bits // 8
    ints = [0, 1 << bits - 2, -(1 << bits - 2), 0]
    body = b"".join(((x + 128) if bits == 8 else x).to_bytes(n, "little", signed=bits > 8) for x in ints)
    fmt = struct.pack("<HHIIHH", 1, 2, 8000, 8000 * 2 * n, 2 * n, bits)
    chunks = b"LIST\x03\0\0\0abc\0" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body
    (tmp_path / "A.WAV").write_bytes(b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks)
    row = files.wav_files(spark, str(tmp_path)).first()
    assert (row.sample_rate, row.channels, row.samples) == (8000.0, 2, [0.0, 0.5, -0.5, 0.0])
    assert files.wav_files(spark, str(tmp_path), downmix=True).first().samples == [0.25, -0.25]


def test_cifar(spark, tmp_path):
    (tmp_path / "data_batch_1").write_bytes(b"".join(bytes([i]) + bytes([i + 1]) * 3072 for i in range(3)))
    rows = {r.name: r for r in files.cifar_files(spark, str(tmp_path)).collect()}
    assert {k: r.label for k, r in rows.items()} == {f"data_batch_1_{i}": i for i in range(3)} and bytes(rows["data_batch_1_2"]["values"]) == b"\3" * 3072


def test_images_and_labels(spark, tmp_path):
    for folder, name in (("cats", "b.JPG"), ("cats", "a.png"), ("ants", "c.jpeg"), ("ants", "notes.md")):
        (tmp_path / "i" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "i" / folder / name).write_bytes(b"x")
    assert {(r.name, r.label) for r in files.image_files(spark, str(tmp_path / "i")).collect()} == {("b.JPG", 1), ("a.png", 1), ("c.jpeg", 0)}
    (tmp_path / "labels.txt").write_text("d/x.jpg 3\ny.jpg 4\n\nbroken\nx.jpg 9\nz.jpg q\n")
    assert {tuple(r) for r in files.label_list(spark, str(tmp_path / "labels.txt")).collect()} == {("x.jpg", 3), ("y.jpg", 4)}
    assert files.decoded_images(spark, str(tmp_path / "i")).count() == 0


def test_frame_sequences(spark, tmp_path):
    for i in range(5):
        (tmp_path / "v").mkdir(exist_ok=True)
        (tmp_path / "v" / f"f{i}.jpg").write_bytes(b"x")
    rows = files.frame_sequences(spark, str(tmp_path), 2, 2, 2).orderBy("sequence", "frame").collect()
    assert [(r.sequence, r.path[-6:]) for r in rows] == [(0, "f0.jpg"), (0, "f2.jpg"), (1, "f2.jpg"), (1, "f4.jpg")]


def test_decoded_png(spark, tmp_path):
    import zlib

    raw = b"\0" + bytes([255, 0, 0, 0, 255, 0])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    (tmp_path / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    r = files.decoded_images(spark, str(tmp_path)).first()
    assert (r.height, r.width, r.channels, r["values"]) == (1, 2, 3, [255.0, 0.0, 0.0, 0.0, 255.0, 0.0])


def test_video_list(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a.mp4 0 1.02 2.5\nb.mp4 1\na.mp4 2 3 2\na.mp4 3 0 99\n")
    fps = spark.createDataFrame([("a.mp4", 25.0, 100), ("b.mp4", 30.0, 7)], "file string, fps double, frames long")
    got = {tuple(r) for r in files.video_list(spark, str(tmp_path / "v.txt"), fps, by_frame=False).collect()}
    assert got == {("a.mp4", 0, 26, 62), ("b.mp4", 1, 0, 7)}


def test_coco(spark, tmp_path):
    joints = [10.0, 20.0, 2.0] + [0.0, 0.0, 0.0] * 16
    data = {
        "images": [{"id": 5, "file_name": "a.jpg", "width": 100, "height": 50}, {"id": 6, "file_name": "b.jpg", "width": 10, "height": 10}],
        "categories": [{"id": 18, "name": "dog"}, {"id": 1, "name": "person"}],
        "annotations": [
            {"id": 1, "image_id": 5, "category_id": 1, "iscrowd": 0, "bbox": [10, 10, 20, 20], "segmentation": [[1, 2, 3, 4], [5, 6]], "keypoints": joints},
            {"id": 2, "image_id": 5, "category_id": 18, "iscrowd": 0, "bbox": [0, 0, 5, 5], "segmentation": [[7, 8]], "keypoints": joints},
            {"id": 3, "image_id": 5, "category_id": 1, "iscrowd": 1, "bbox": [1, 1, 2, 2], "segmentation": {"counts": [1]}, "keypoints": joints},
        ],
    }
    (tmp_path / "a.json").write_text(json.dumps(data))
    table = coco.read(spark, str(tmp_path / "a.json"))
    row = coco.detections(table).first()
    assert row.labels == [2, 1, 2] and tuple(row.boxes[0]) == (10.0, 10.0, 30.0, 30.0)
    found = coco.detections(table, masks=True)
    row = found.first()
    assert tuple(row.boxes[0]) == (10.0, 10.0, 29.0, 29.0) and row.masks == [[[1.0, 2.0, 3.0, 4.0], [5.0, 6.0]], [[7.0, 8.0]]]
    assert tuple(coco.mask_counts(found).first()) == ("a.jpg", [2, 1], 3)
    assert coco.mask_coordinates(found).first().coordinates == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    person = coco.keypoints(table).collect()
    assert len(person) == 1 and person[0].annotation_id == 1 and person[0].center == [19.5, 19.5] and person[0].joints[0] == [10.0, 20.0]
    assert [v[0] for v in person[0].visibility][:2] == [1.0, 0.0] and person[0].scale[1] == pytest.approx(19 / 0.75 / 200 * 1.25)
    assert table.select(F.size("images")).first()[0] == 2


def test_checksum_of_long_data():
    r = np.random.default_rng(4)
    for n in (0, 3, 255, 256, 257, 4097, 30_001):
        data = r.bytes(n)
        crc = 0xFFFFFFFF
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        assert records.crc32c(data) == crc ^ 0xFFFFFFFF


def test_lmdb_of_many_and_large_values(spark, tmp_path):
    items = {f"key-{i:06d}": bytes([i % 251]) * (i % 1500 if i % 97 else 9000) for i in range(3000)}
    rows = spark.createDataFrame([(k, v) for k, v in items.items()], "name string, value binary").repartition(2)
    rows.write.format("lmdb").option("maxFileBytes", "400000").mode("append").save(str(tmp_path / "db"))
    table = spark.read.format("lmdb").load(str(tmp_path / "db"))
    found = table.collect()
    assert len(found) == len(items) and {r.name: bytes(r.value) for r in found} == items
    assert len(list((tmp_path / "db").glob("*/data.mdb"))) > 2 and not list((tmp_path / "db").glob("_write-*"))
    alone = spark.read.format("lmdb").load(str(next((tmp_path / "db").glob("*/data.mdb")))).collect()
    assert [r.name for r in alone] == sorted(r.name for r in alone)


def test_recordio_parts_the_magic_number(spark, tmp_path):
    mark = struct.pack("<I", records.RecordIOReader.MAGIC)
    contents = [mark, b"abcd" + mark * 3, b"a" + mark, mark + b"xyz", b""]
    frame = spark.createDataFrame([(i, 7, c) for i, c in enumerate(contents)], "image_id long, label int, content binary")
    frame.write.format("recordio").mode("append").save(str(tmp_path / "r"))
    assert {r.image_id: bytes(r.content) for r in spark.read.format("recordio").load(str(tmp_path / "r")).collect()} == dict(enumerate(contents))


def test_written_files_replace_append_and_leave_nothing_behind(spark, tmp_path):
    path = str(tmp_path / "f")
    frame = lambda *names: spark.createDataFrame([(n, n.encode()) for n in names], "path string, content binary")
    frame("a/x.bin", "b.bin").write.format("files").mode("append").save(path)
    frame("c.bin").write.format("files").mode("append").save(path)
    held = lambda: {str(p.relative_to(path)) for p in (tmp_path / "f").rglob("*") if p.is_file()}
    assert held() == {"a/x.bin", "b.bin", "c.bin"}
    with pytest.raises(Exception, match="not a name below"):
        frame("ok.bin", "../out.bin").write.format("files").mode("append").save(path)
    assert held() == {"a/x.bin", "b.bin", "c.bin"}
    frame("d.bin").write.format("files").mode("overwrite").save(path)
    assert held() == {"d.bin"}


@pytest.mark.parametrize("step", [4, 36, 100, 1 << 20])
def test_recordio_splits(spark, tmp_path, step):
    magic = struct.pack("<I", records.RecordIOReader.MAGIC)
    contents = [b"", magic * 9, b"x" * 50, b"abc" + magic + magic, magic, b"y" * 7] * 4
    frame = spark.createDataFrame([(1, i, c) for i, c in enumerate(contents)], "label int, image_id long, content binary").coalesce(1)
    frame.write.format("recordio").mode("append").save(str(tmp_path / "r"))
    back = spark.read.format("recordio").option("splitBytes", step).load(str(tmp_path / "r"))
    assert sorted((r.image_id, bytes(r.content)) for r in back.collect()) == list(enumerate(contents))
    assert (back.rdd.getNumPartitions() > 1) == (step < 1000)


def test_recordio_that_is_cut(spark, tmp_path):
    whole = struct.pack("<II", records.RecordIOReader.MAGIC, 40) + bytes(40)
    (tmp_path / "a.rec").write_bytes(whole[:30])
    with pytest.raises(Exception, match="cut short"):
        spark.read.format("recordio").load(str(tmp_path)).collect()
