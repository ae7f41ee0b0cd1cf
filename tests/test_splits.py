"""Splits of record files: every record once, wherever a file is cut, and no file of another shard opened."""

from __future__ import annotations

import io
import json
import os
import random
import struct
import tarfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.sources import jsonscan, records, splits
from test_sources import example, tfrecord


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    records.register(spark)


def one(i, body=b""):
    return example(image__encoded=[b"%d:" % i + body], image__class__label=[i])


def labels(df):
    return sorted(r.ints["image/class/label"][0] for r in df.select("ints").collect())


def forged(size):
    """A record that is whole by itself."""
    return tfrecord(b"x" * size)


def test_tfrecord_from_any_byte(spark, tmp_path):
    r = random.Random(3)
    bodies = [r.randbytes(r.randint(0, 400)) for _ in range(150)]
    (tmp_path / "a.tfrecord").write_bytes(tfrecord(*(one(i, b) for i, b in enumerate(bodies))))
    (tmp_path / "b.tfrecord").write_bytes(tfrecord(*(one(150 + i) for i in range(3))))
    (tmp_path / "empty.tfrecord").write_bytes(b"")
    for step in (64, 333, 5000):
        where = splits.index(spark, "tfrecord", str(tmp_path), step)
        assert splits.size(where) == 153
        back = splits.read(spark, "tfrecord", str(tmp_path), where=where)
        assert labels(back) == list(range(153)) and back.rdd.getNumPartitions() == len(records.splits_of(where)) > 1
        numbers = {(x.file, x.record): x.ints["image/class/label"][0] for x in back.collect()}
        assert all(label == (n if file == "a.tfrecord" else 150 + n) for (file, n), label in numbers.items())


@pytest.mark.parametrize("step", [100, 1000, 4096])
def test_payloads_that_imitate_records(spark, tmp_path, step):
    """Whole record files within records, bare headers, and headers that lead to a true record's end."""
    inner = tfrecord(*(one(1000 + i, b"z" * 90) for i in range(40)))
    head = lambda n: struct.pack("<Q", n) + struct.pack("<I", records.masked_crc(struct.pack("<Q", n)))
    tricks = [inner, inner + b"tail", b"front" + inner, head(50) * 30, head(10**9), b"".join(head(8 * (i + 1)) for i in range(60)), b"\0" * 3000, inner * 3]
    whole = [one(i, t) for i, t in enumerate(tricks * 3)]
    (tmp_path / "x.tfrecord").write_bytes(tfrecord(*whole))
    (tmp_path / "y.tfrecord").write_bytes(tfrecord(*(one(100 + i) for i in range(5))))
    back = splits.read(spark, "tfrecord", str(tmp_path), split_bytes=step)
    assert labels(back) == [*range(24), *range(100, 105)]
    for k in range(4):
        got = labels(splits.read(spark, "tfrecord", str(tmp_path), k, 4, split_bytes=step))
        assert got == [*range(24), *range(100, 105)][29 * k // 4 : 29 * (k + 1) // 4]


def test_broken_tfrecords_are_told(spark, tmp_path):
    data = tfrecord(*(one(i) for i in range(9)))
    (tmp_path / "x.tfrecord").write_bytes(data[:-3])
    with pytest.raises(Exception, match="cut short|wrong checksum"):
        splits.read(spark, "tfrecord", str(tmp_path), split_bytes=40).collect()
    (tmp_path / "x.tfrecord").write_bytes(data[:100] + b"\1" + data[101:])
    with pytest.raises(Exception, match="wrong checksum|cut short"):
        splits.read(spark, "tfrecord", str(tmp_path), split_bytes=40).collect()


def test_scan_of_headers_is_fast():
    block = np.frombuffer(random.Random(1).randbytes(1 << 20), np.uint8)
    began = time.process_time()
    assert not list(splits._length_headers(block, 0, 1 << 40))
    list(splits._length_headers(np.zeros(1 << 20, np.uint8), 0, 1 << 40))
    assert time.process_time() - began < 3


@pytest.mark.parametrize("form", ["tfrecord", "recordio", "files", "fixed", "webdataset", "lmdb"])
def test_other_shards_are_not_opened(spark, tmp_path, monkeypatch, form):
    """Six folders of ten records; shard 1 of 3 is made of the middle two alone."""
    folder = str(tmp_path)
    e = spark.range(60).repartitionByRange(6, "id").sortWithinPartitions("id").select(F.col("id").cast("int").alias("i"))
    text = F.col("i").cast("string").cast("binary")
    frames = {
        "tfrecord": e.select(F.create_map(F.lit("image/encoded"), F.array(text)).alias("bytes"), F.create_map(F.lit("k"), F.array(F.col("i").cast("long"))).alias("ints")),
        "recordio": e.select(F.col("i").alias("label"), F.col("i").cast("long").alias("image_id"), text.alias("content")),
        "files": e.select(F.format_string("d%d/%03d.bin", F.floor(F.col("i") / 10), "i").alias("path"), text.alias("content")),
        "fixed": e.select(F.lpad("i", 4, "0").cast("binary").alias("content")),
        "webdataset": e.select(F.format_string("d/%03d", "i").alias("key"), F.create_map(F.lit("txt"), text).alias("components")),
        "lmdb": e.select(F.format_string("%03d", "i").alias("name"), text.alias("value")),
    }
    frames[form].write.format(form).mode("append").save(folder)
    if form == "webdataset":
        assert set(splits.write_tar_indexes(spark, folder).values()) == {10}
    more = {"record_bytes": 4} if form == "fixed" else {}
    where = splits.index(spark, form, folder, **more)
    assert splits.size(where) == 60
    value = {"tfrecord": lambda r: r.ints["k"][0], "recordio": lambda r: r.label, "files": lambda r: int(r.content), "fixed": lambda r: int(r.content), "webdataset": lambda r: int(r.components["txt"]), "lmdb": lambda r: int(r.value)}[form]
    for k, n in ((0, 1), (1, 7), (6, 7), (3, 4)):
        got = splits.read(spark, form, folder, k, n, where, **more).collect()
        assert sorted(map(value, got)) == list(range(60 * k // n, 60 * (k + 1) // n))
    mine = {p.path for p in records.shard_parts(where, 1, 3)}
    for s in records.splits_of(where):
        if s["path"] not in mine and os.path.exists(s["path"]):
            os.remove(s["path"])
    got = splits.read(spark, form, folder, 1, 3, where, **more)
    assert sorted(map(value, got.collect())) == list(range(20, 40))
    with pytest.raises(Exception):
        splits.read(spark, form, folder, 0, 3, where, **more).collect()


def test_more_shards_than_records(spark, tmp_path):
    (tmp_path / "a.tfrecord").write_bytes(tfrecord(*(one(i) for i in range(3))))
    got = [labels(splits.read(spark, "tfrecord", str(tmp_path), k, 5)) for k in range(5)]
    assert got == [[], [0], [], [1], [2]]
    with pytest.raises(ValueError, match="shard 5"):
        splits.read(spark, "tfrecord", str(tmp_path), 5, 5)
    os.remove(tmp_path / "a.tfrecord")
    assert splits.read(spark, "tfrecord", str(tmp_path)).count() == 0


def tar(path, members):
    with tarfile.open(path, "w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def test_tar_splits(spark, tmp_path):
    """Splits begin within the file and keep samples whole; the index is made from headers alone."""
    r = random.Random(2)
    members = [(f"d/s{i:03d}.{e}", r.randbytes(r.randint(0, 3000))) for i in range(80) for e in ("jpg", "seg.png", "cls")]
    tar(tmp_path / "a.tar", members)
    tar(tmp_path / "b.tar", [("x.txt", b"1"), ("y.txt", b"")])
    counts = splits.write_tar_indexes(spark, str(tmp_path))
    assert counts == {str(tmp_path / "a.tar"): 80, str(tmp_path / "b.tar"): 2}
    want = {}
    for name, data in [*members, ("x.txt", b"1"), ("y.txt", b"")]:
        key, extension = records.sample_name(name)
        want.setdefault(key, {})[extension] = data
    where = splits.index(spark, "webdataset", str(tmp_path), 9000)
    assert len(records.splits_of(where)) > 10
    got = splits.read(spark, "webdataset", str(tmp_path), where=where).collect()
    assert {x.key: {k: bytes(v) for k, v in x.components.items()} for x in got} == want and len(got) == 82
    plain = spark.read.format("webdataset").load(str(tmp_path)).collect()
    assert sorted(x.key for x in plain) == sorted(want)


def test_tar_index_reads_headers_alone(tmp_path):
    tar(tmp_path / "a.tar", [(f"s{i}.bin", bytes(200_000)) for i in range(20)])

    class Counting(io.FileIO):
        seen = 0

        def read(self, n=-1):
            data = super().read(n)
            Counting.seen += len(data)
            return data

    with Counting(tmp_path / "a.tar") as f:
        assert [k for k, _ in splits.index_lines(f)] == [f"s{i}" for i in range(20)]
    assert Counting.seen < 40_000


def test_indexes_made_elsewhere(spark, tmp_path):
    """Version 1.1 has no names: samples are called by their line. Broken ones are told."""
    tar(tmp_path / "a.tar", [("p.txt", b"one"), ("p.cls", b"1"), ("q.txt", b"two")])
    with tarfile.open(tmp_path / "a.tar") as t:
        at = {m.name: m.offset_data for m in t}
    lines = f"v1.1 2\ntxt {at['p.txt']} 3 cls {at['p.cls']} 1\ntxt {at['q.txt']} 3\n"
    (tmp_path / "a.idx").write_text(lines)
    got = {x.key: x.components for x in splits.read(spark, "webdataset", str(tmp_path)).collect()}
    assert got == {"1": {"txt": b"one", "cls": b"1"}, "2": {"txt": b"two"}}
    (tmp_path / "a.idx").write_text("v2.0 1\n")
    with pytest.raises(Exception, match="not an index"):
        splits.read(spark, "webdataset", str(tmp_path)).collect()
    os.remove(tmp_path / "a.idx")
    with pytest.raises(ValueError, match="no index"):
        splits.read(spark, "webdataset", str(tmp_path))
    tar(tmp_path / "b.tar", [("with space.txt", b"1")])
    assert splits.write_tar_indexes(spark, str(tmp_path))[str(tmp_path / "b.tar")] == -1


def test_lmdb_ranges(spark, tmp_path, monkeypatch):
    """Pages whose keys lie outside are not read; results are those of a filter."""
    names = [*(f"k{i:05d}" for i in range(20_000)), "ké", "ké1", "k\U0001f600", "kz", "l"]
    rows = spark.createDataFrame([(n, b"v" * (i % 50)) for i, n in enumerate(names)], "name string, value binary")
    rows.coalesce(1).write.format("lmdb").mode("append").save(str(tmp_path))
    got = lambda **k: sorted(r.name for r in records.lmdb(spark, str(tmp_path), **k).collect())
    key = lambda x: x.encode()
    assert got() == sorted(names) and got(name="k00777") == ["k00777"] and got(name="zz") == []
    for low, high in (("k01000", "k01010"), ("k19990", "z"), ("", "k00009"), ("ké", "kz"), ("b", "a"), ("k05000x", "k05001")):
        assert got(low=low, high=high) == sorted(n for n in names if key(low) <= key(n) <= key(high)), (low, high)
    assert got(low="k19998") == sorted(n for n in names if key(n) >= b"k19998") and got(high="k00001") == ["k00000", "k00001"]
    assert len(got(prefix="k0100")) == 10 and got(prefix="ké") == ["ké", "ké1"] and len(got(prefix="")) == len(names)
    assert got(prefix="k010", low="k01090") == [f"k{i:05d}" for i in range(1090, 1100)]

    def pages(**options):
        seen, read = [], records.LmdbReader._page
        monkeypatch.setattr(records.LmdbReader, "_page", lambda self, f, size, n: (seen.append(n), read(self, f, size, n))[1])
        reader = records.LmdbReader({"path": str(tmp_path), **options})
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        monkeypatch.setattr(records.LmdbReader, "_page", read)
        return len(seen), rows

    every, rows = pages()
    assert len(rows) == len(names) and every > 150
    few, rows = pages(low="k00777", high="k00777")
    assert [r[0] for r in rows] == ["k00777"] and few <= 4
    few, rows = pages(low="k01000", high="k01099")
    assert len(rows) == 100 and few <= 8
    assert pages(low="zzz")[1] == []
    with pytest.raises(ValueError, match="counts all keys"):
        records.LmdbReader({"path": "x", "index": "y", "low": "a"})


def test_files_sink(spark, tmp_path):
    """Files go where their rows say, without a message for each; an overwritten folder holds the new ones alone."""
    rows = spark.range(300).select(F.format_string("c%d/%d.bin", F.col("id") % 3, "id").alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    to = str(tmp_path / "out")
    rows.repartition(5).write.format("files").mode("append").save(to)
    back = spark.read.format("files").load(to)
    assert {r.path: bytes(r.content) for r in back.collect()} == {f"c{i % 3}/{i}.bin": b"%d" % i for i in range(300)}
    assert back.rdd.getNumPartitions() < 20 and sorted(os.listdir(to)) == ["c0", "c1", "c2"]
    rows.where("id < 4").write.format("files").mode("overwrite").save(to)
    assert spark.read.format("files").load(to).count() == 4 and os.listdir(tmp_path) == ["out"]
    rows.where("id = 2").withColumn("content", F.lit(b"new")).write.format("files").mode("append").save(to)
    assert {r.path: bytes(r.content) for r in spark.read.format("files").load(to).collect()}["c2/2.bin"] == b"new"
    bad = rows.where("id < 9").withColumn("path", F.when(F.col("path") == "c2/8.bin", "../x").otherwise(F.col("path")))
    with pytest.raises(Exception):
        bad.coalesce(1).write.format("files").mode("append").save(to)
    assert spark.read.format("files").load(to).count() == 4 and sorted(os.listdir(to)) == ["c0", "c1", "c2"]
    with pytest.raises(Exception):
        rows.coalesce(1).select(F.lit("../x").alias("path"), "content").write.format("files").mode("overwrite").save(to)
    assert spark.read.format("files").load(to).count() == 4 and os.listdir(tmp_path) == ["out"]


NASTY = ['plain', 'a "quoted" {name}', "back\\slash\\", '\\"', "]}[{", "é日本", "tab\tnew\nline", '\\\\"}, {"id": 9', "", '\\' * 7]


def annotation_file(n, seed):
    r = random.Random(seed)
    text = lambda: r.choice(NASTY) + r.choice(NASTY)
    images = [{"id": i, "file_name": text(), "width": 10 + i, "height": 20, "extra": {"deep": [[{"x": text()}]]}} for i in range(n)]
    categories = [{"id": 7 * k + 3, "name": text()} for k in range(4)]
    annotations = [
        {"id": j, "image_id": r.randrange(n), "category_id": 7 * r.randrange(4) + 3, "iscrowd": int(r.random() < 0.2), "area": r.random(), "bbox": [r.random() * 9 for _ in range(4)], "segmentation": r.choice([[[1.0, 2.0, 3.5]], {"counts": text(), "size": [1, 2]}, None]), "note": text()}
        for j in range(3 * n)
    ]
    whole = {"info": {"images": [{"id": -1}], "about": text()}, "images": images, "licenses": [], "annotations": annotations, "categories": categories, text() + "k": [1, [2], "x"]}
    return whole


@pytest.mark.parametrize("step", [50, 700, 100_000])
@pytest.mark.parametrize("indent", [None, 1])
def test_annotations_in_ranges(spark, tmp_path, step, indent):
    """One file in several partitions, whatever its strings hold, gives what a JSON parser gives."""
    from tilewright.sources import coco

    whole = annotation_file(12, step)
    (tmp_path / "a.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=step == 50))
    data = coco.scan(spark, str(tmp_path), step)
    got = data.annotations.orderBy("position").collect()
    assert [(a.id, a.image_id, a.category_id, a.iscrowd, a.area, a.bbox) for a in got] == [tuple(a[k] for k in ("id", "image_id", "category_id", "iscrowd", "area", "bbox")) for a in whole["annotations"]]
    assert [json.loads(a.segmentation) if a.segmentation else None for a in got] == [a["segmentation"] for a in whole["annotations"]]
    assert [(i.id, i.file_name, i.width) for i in data.images.orderBy("position").collect()] == [(i["id"], i["file_name"], i["width"]) for i in whole["images"]]
    assert {c.category_id: c["class"] for c in coco.categories(data).collect()} == {7 * k + 3: k + 1 for k in range(4)}
    assert (data.annotations.rdd.getNumPartitions() > 5) == (step < 1000)


def test_scanner_in_any_blocks():
    """States and brackets don't depend on how a text is cut, nor on where counting begins."""
    r = random.Random(5)
    text = json.dumps(annotation_file(5, 1)).encode()
    plain, inside, escaped, depth = [], False, False, 0
    for i, c in enumerate(text):
        if inside:
            inside, escaped = (escaped or c != 34), (c == 92 and not escaped)
        elif c == 34:
            inside = True
        elif c in b"[]{}":
            depth += 1 if c in b"[{" else -1
            plain.append((i, depth))
    for _ in range(30):
        s, at, got = jsonscan.Scanner(), 0, []
        while at < len(text):
            n = r.choice([1, 2, 3, 7, 50, 400])
            places, after = s.scan(np.frombuffer(text[at : at + n], np.uint8))
            got += [(at + int(p), int(d)) for p, d in zip(places, after)]
            at += n
        assert got == plain and s.depth == 0 and not s.inside


def test_annotation_files_that_are_none(spark, tmp_path):
    from tilewright.sources import coco

    (tmp_path / "a.json").write_text('{"images": [{"id": 1}], "annotations": [')
    with pytest.raises(Exception, match="cut short"):
        coco.scan(spark, str(tmp_path))
    (tmp_path / "a.json").write_text('{"images": [{"id": "x", "width": null, "height": 3.0}, 5, null, [{"id": 8}]]}')
    data = coco.scan(spark, str(tmp_path))
    assert [tuple(x)[2:] for x in data.images.collect()] == [(None, None, None, 3)] and data.annotations.count() == 0
    (tmp_path / "a.json").write_text("{}")
    assert coco.detections(coco.scan(spark, str(tmp_path))).count() == 0


def test_blocks_bound_memory(tmp_path):
    """A range is read block by block; what is held is an object."""
    body = b'{"annotations": [' + b",".join(b'{"id": %d, "t": "%s"}' % (i, b"x" * 500) for i in range(4000)) + b"]}"
    (tmp_path / "a.json").write_bytes(body)
    sizes = []

    class File:
        def __init__(self, f):
            self.f = f

        def size(self):
            return len(body)

        def read_at(self, n, at):
            sizes.append(n)
            return self.f.read_at(n, at)

    with records._random_access(str(tmp_path / "a.json")) as f:
        found = [json.loads(t)["id"] for _, t in jsonscan.objects(File(f), 17, len(body) - 2, False, 2, 4096)]
    assert found == list(range(4000)) and max(sizes) == 4096


def test_small_splits_share_tasks(spark, tmp_path):
    """Tasks don't grow in number with small splits; every record is still read once, in every shard, under its number."""
    for name, low, high in (("a", 0, 700), ("b", 700, 701), ("c", 701, 1500)):
        (tmp_path / f"{name}.tfrecord").write_bytes(tfrecord(*(one(i) for i in range(low, high))))
    where = splits.index(spark, "tfrecord", str(tmp_path), 64)
    assert len(records.splits_of(where)) > 1000
    back = splits.read(spark, "tfrecord", str(tmp_path), where=where)
    assert 100 < back.rdd.getNumPartitions() <= 257
    assert [(r.file, r.record, r.ints["image/class/label"][0]) for r in back.collect()] == [
        ("a.tfrecord" if i < 700 else "b.tfrecord" if i < 701 else "c.tfrecord", i if i < 700 else i - 700 if i < 701 else i - 701, i) for i in range(1500)
    ]
    for k in range(3):
        assert labels(splits.read(spark, "tfrecord", str(tmp_path), k, 3, where)) == list(range(500 * k, 500 * k + 500))


@pytest.mark.parametrize("form", ["tfrecord", "recordio", "fixed", "webdataset", "lmdb"])
def test_groups_of_splits(spark, tmp_path, form):
    """Groups hold the records of their splits, in order, whatever the format."""
    i = F.col("id").cast("int")
    text = F.lpad(i.cast("string"), 4, "0").cast("binary")
    columns = {
        "tfrecord": [F.create_map(F.lit("k"), F.array(text)).alias("bytes")],
        "recordio": [i.alias("label"), F.col("id").alias("image_id"), text.alias("content")],
        "fixed": [text.alias("content")],
        "webdataset": [F.format_string("d/%04d", i).alias("key"), F.create_map(F.lit("txt"), text).alias("components")],
        "lmdb": [F.format_string("%04d", i).alias("name"), text.alias("value")],
    }
    folder, rows = str(tmp_path), spark.range(200).repartitionByRange(9, "id").sortWithinPartitions("id")
    rows.select(*columns[form]).write.format(form).mode("append").save(folder)
    if form == "webdataset":
        splits.write_tar_indexes(spark, folder)
    more = {"record_bytes": 4} if form == "fixed" else {}
    where = splits.index(spark, form, folder, 40, **more)
    found = records.splits_of(where)
    assert len(found) >= 9 and all(s["bytes"] > 0 for s in found)
    value = {"tfrecord": lambda r: r[2]["k"][0], "recordio": lambda r: r[4], "fixed": lambda r: r[2], "webdataset": lambda r: r[2]["txt"], "lmdb": lambda r: r[1]}[form]
    for tasks, shard, shards in ((1, 0, 1), (4, 0, 1), (8, 2, 3), (2, 5, 7)):
        reader = records.SOURCES[form][1]({"path": folder, "index": where, "shard": str(shard), "shards": str(shards), "tasks": str(tasks), **({"recordbytes": "4"} if more else {})})
        parts = reader.partitions()
        assert len(parts) <= tasks + 1
        assert [int(bytes(value(r))) for p in parts for r in reader.read(p)] == list(range(200 * shard // shards, 200 * (shard + 1) // shards))


def test_groups_follow_bytes():
    part = lambda at, size, path="x": records.FilePart(path, start=at, end=at + size, take=1, size=size)
    few = [part(10 * i, 10) for i in range(7)]
    assert [g.parts for g in records.grouped(few, 7)] == [[p] for p in few]
    halves = records.grouped(few, 2)
    assert [(p.start, p.end, p.take) for g in halves for p in g.parts] == [(0, 40, 4), (40, 70, 3)]
    gap = records.grouped([part(0, 10), part(10, 10), part(30, 10), part(0, 10, "y")], 1)
    assert [(p.path, p.start, p.end) for p in gap[0].parts] == [("x", 0, 20), ("x", 30, 40), ("y", 0, 10)] and len(gap) == 1
    large = [part(i << 26, 1 << 26) for i in range(64)]
    assert len(records.grouped(large, 4)) == 32 and all(g.parts[0].size <= records.GROUP_BYTES for g in records.grouped(large, 4))


def test_files_of_a_task_are_in_order(spark, tmp_path):
    """A task that closes many files names them in the order of its rows."""
    rows = spark.range(400).coalesce(1).select(F.lpad(F.col("id").cast("string"), 4, "0").cast("binary").alias("content"))
    rows.write.format("fixed").option("maxFileBytes", "40").mode("append").save(str(tmp_path))
    names = sorted(p.name for p in tmp_path.iterdir())
    assert len(names) == 40 and b"".join((tmp_path / n).read_bytes() for n in names) == b"".join(b"%04d" % i for i in range(400))
