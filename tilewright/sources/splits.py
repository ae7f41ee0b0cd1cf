"""Which bytes of a record file hold which records, and scans of one shard's splits alone.

``index`` finds the splits of all files below a path in one Spark job and
stores a small table: a file, a range, the number of its first record within
the file and its number of records. A reader that is given the table plans
partitions for the splits of its own shard only: files of other shards are
never opened, and in the two splits at a shard's ends the other shards' records
are passed over by their headers. Splits may be much smaller than what is worth
a task: neighbours then share one (``records.grouped``).

==============  =============================================================
``tfrecord``    ranges of bytes. A reader that starts anywhere looks for a
                length whose masked checksum follows it and whose record's
                checksum is right. A payload may hold such a record too, so a
                range counts only if the range before it ends where it begins;
                from the first that doesn't, the file's headers are walked.
``recordio``    ranges of bytes, found by the magic number
``fixed``       ranges of whole records, by arithmetic
``webdataset``  ranges of lines of an index file beside the tar
``lmdb``        children of the root page
``files``       a file is a record
==============  =============================================================

The table has a row for each split, as any listing of files has, so the driver
holds bytes / ``split_bytes`` rows. Files are taken in the order of their paths.
"""

from __future__ import annotations

import io
import json
import os
import struct
import tarfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tilewright.sources import records
from tilewright.sources.records import masked_crc, open_path, sizes_below
from tilewright.storage import new_path

SPLIT_BYTES = 128 << 20
_BLOCK = 1 << 20
_FIELDS = "path string, start long, end long, first long, count long"
#: With the bytes of the records, where the range isn't one of theirs.
_SIZED = f"{_FIELDS}, bytes long"


# --- TFRecord: records found from any byte ---


def _length_headers(block: np.ndarray, at: int, size: int) -> Iterator[tuple[int, int]]:
    """(place, length) of all 12 bytes of ``block`` that are a length which fits the file, and its masked checksum."""
    n = len(block) - 11
    if n <= 0:
        return
    small = np.ones(n, bool)
    for byte in range((size.bit_length() + 7) // 8, 8):
        small &= block[byte : byte + n] == 0
    places = np.flatnonzero(small)
    heads = block[places[:, None] + np.arange(12)]
    crc = np.full(len(places), 0xFFFFFFFF, np.uint32)
    for byte in range(8):
        crc = records._CRC_ARRAY[(crc ^ heads[:, byte]) & 0xFF] ^ crc >> 8
    crc ^= np.uint32(0xFFFFFFFF)
    masked = (crc >> 15 | crc << 17) + np.uint32(0xA282EAD8)
    lengths = np.ascontiguousarray(heads[:, :8]).view("<u8").ravel()
    right = (masked == np.ascontiguousarray(heads[:, 8:]).view("<u4").ravel()) & (lengths <= size)
    for place, length in zip(places[right].tolist(), lengths[right].tolist()):
        if at + place + 16 + length <= size:
            yield at + place, length


def first_tfrecord(f, start: int, end: int, size: int) -> int | None:
    """The first place in [start, end) that begins what reads as a whole record."""
    if start == 0:
        return 0
    for at in range(start, end, _BLOCK):
        # 11 bytes of the next block, as a header may go over.
        block = np.frombuffer(f.read_at(min(_BLOCK, end - at) + 11, at), np.uint8)
        for place, length in _length_headers(block, at, size):
            body = f.read_at(length + 4, place + 12)
            if masked_crc(body[:-4]) == struct.unpack("<I", body[-4:])[0]:
                return place
    return None


def walk_tfrecords(f, at: int, end: int, size: int) -> tuple[int, int]:
    """(place after the last record that begins before ``end``, number of records), by headers alone."""
    n = 0
    while at < end:
        at += 16 + records.tfrecord_length(f.read_at(12, at))
        n += 1
    if at > size:
        raise ValueError("a record is cut short")
    return at, n


def _ranges(path: str, suffixes: tuple[str, ...], step: int) -> list[dict]:
    return [{"path": p, "size": n, "start": a, "end": min(a + step, n)} for p, n in sizes_below(path, suffixes) for a in range(0, n, step)]


def _each(spark: SparkSession, rows: list[dict], schema: str, f: Callable[[dict], Iterator[tuple]]) -> list:
    """``f`` of every row as Spark tasks; the rows that come back."""
    if not rows:
        return []
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([found for row in frame.to_dict("records") for found in f(row)], columns=names)

    tasks = min(len(rows), 4 * spark.sparkContext.defaultParallelism)
    return spark.createDataFrame(pd.DataFrame(rows)).repartition(tasks).mapInPandas(run, schema).collect()


def _tfrecord(spark: SparkSession, path: str, step: int) -> list[dict]:
    ranges = _ranges(path, records.TFRecordReader.suffixes, step)

    def probe(r: dict) -> Iterator[tuple]:
        with records._random_access(r["path"]) as f:
            entry = first_tfrecord(f, r["start"], r["end"], r["size"])
            if entry is not None:
                try:
                    after, n = walk_tfrecords(f, entry, r["end"], r["size"])
                except ValueError:
                    after, n = -1, 0  # not the file's own records, or the file is broken, which the walk below tells
                yield r["path"], r["start"], entry, after, n

    found = {(x.path, x.start): x for x in _each(spark, ranges, "path string, start long, entry long, after long, n long", probe)}
    out, unsure, at, first, path = [], [], 0, 0, None
    for r in ranges:
        if r["path"] != path:
            path, at, first = r["path"], 0, 0
        x = found.get((path, r["start"]))
        if at >= r["end"] or (unsure and unsure[-1]["path"] == path):
            continue
        if x is None or x.entry != at or x.after < 0:
            unsure.append({"path": path, "at": at, "first": first, "size": r["size"], "step": step})
            continue
        out.append({"path": path, "start": at, "end": x.after, "first": first, "count": x.n})
        at, first = x.after, first + x.n

    def walk(r: dict) -> Iterator[tuple]:
        at, first = r["at"], r["first"]
        with records._random_access(r["path"]) as f:
            while at < r["size"]:
                after, n = walk_tfrecords(f, at, min(at - at % r["step"] + r["step"], r["size"]), r["size"])
                yield r["path"], at, after, first, n
                at, first = after, first + n

    return out + [x.asDict() for x in _each(spark, unsure, _FIELDS, walk)]


# --- the other formats ---


def _recordio(spark: SparkSession, path: str, step: int) -> list[dict]:
    step = max(4, step - step % 4)

    def count(r: dict) -> Iterator[tuple]:
        reader = records.RecordIOReader({"path": path})
        with records._random_access(r["path"]) as f:
            yield r["path"], r["start"], r["end"], 0, sum(1 for _ in reader.heads(f, r["start"], r["end"]))

    return _numbered(x.asDict() for x in _each(spark, _ranges(path, records.RecordIOReader.suffixes, step), _FIELDS, count))


def _numbered(splits) -> list[dict]:
    """``splits`` with the number of each one's first record, counted through its file."""
    out, path, first = [], None, 0
    for s in sorted(splits, key=lambda s: (s["path"], s["start"])):
        first = first if s["path"] == path else 0
        path = s["path"]
        out.append(s | {"first": first})
        first += s["count"]
    return out


def _lmdb(spark: SparkSession, path: str, step: int) -> list[dict]:
    roots = [{"path": p.path, "page": p.page, "at": i} for i, p in enumerate(records.LmdbReader({"path": path}).partitions()) if p.path]

    def count(r: dict) -> Iterator[tuple]:
        reader = records.LmdbReader({"path": path})
        with records._random_access(r["path"]) as f:
            yield r["path"], r["page"], r["at"], 0, *reader.count(f, r["page"])

    # Children come in key order, which needn't be that of their page numbers.
    found = sorted((x.asDict() for x in _each(spark, roots, _SIZED, count)), key=lambda s: s["end"])
    out, path, first = [], None, 0
    for s in found:
        first = first if s["path"] == path else 0
        path = s["path"]
        out.append(s | {"first": first, "end": -1})
        first += s["count"]
    return out


def _fixed(spark: SparkSession, path: str, step: int, record_bytes: int) -> list[dict]:
    step = max(1, step // record_bytes) * record_bytes
    found = sizes_below(path, ("",))
    broken = [p for p, n in found if n % record_bytes]
    if broken:
        raise ValueError(f"{broken[0]} doesn't hold whole records of {record_bytes} bytes")
    return [{"path": p, "start": a, "end": min(a + step, n), "first": a // record_bytes, "count": (min(a + step, n) - a) // record_bytes} for p, n in found for a in range(0, n, step)]


def _files(spark: SparkSession, path: str, step: int) -> list[dict]:
    return [{"path": p, "start": 0, "end": n, "first": 0, "count": 1} for p, n in sizes_below(path, ("",))]


def index_name(tar: str) -> str:
    return tar.removesuffix(".tar") + ".idx"


def index_lines(f) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """(sample, [(extension, offset, size)]) of the samples of an open tar, by its headers alone."""
    key, parts = None, []
    with tarfile.open(fileobj=f, mode="r:") as tar:
        for member in tar:
            if member.isfile():
                name, extension = records.sample_name(member.name)
                if name != key and parts:
                    yield key, parts
                    parts = []
                key = name
                parts.append((extension, member.offset_data, member.size))
            tar.members = []  # else all headers stay in memory
    if parts:
        yield key, parts


def write_tar_indexes(spark: SparkSession, path: str) -> dict[str, int]:
    """Writes an index (version 1.2) beside every tar below the path; number of samples by tar.

    A line of an index has the extension, offset, size and name of each
    component of a sample, parted by spaces. A tar with a name that holds white
    space, or no extension, can't be listed so and counts -1: it is read whole.
    """

    def one(r: dict) -> Iterator[tuple]:
        system, inner = open_path(r["path"])
        lines = []
        with system.open_input_file(inner) as f:
            for key, parts in index_lines(f):
                fields = [w for e, o, n in parts for w in (e, str(o), str(n), f"{key}.{e}")]
                if any(w.split() != [w] for w in fields):
                    yield r["path"], -1
                    return
                lines.append(" ".join(fields))
        final, own = index_name(inner), f"{index_name(inner)}.{os.getpid()}.tmp"
        with system.open_output_stream(own, compression=None) as out:
            out.write("".join(f"{x}\n" for x in [f"v1.2 {len(lines)}", *lines]).encode())
        system.move(own, final)
        yield r["path"], len(lines)

    tars = [{"path": p} for p, _ in sizes_below(path, (".tar",))]
    return {x.path: x.samples for x in _each(spark, tars, "path string, samples long", one)}


def _webdataset(spark: SparkSession, path: str, step: int) -> list[dict]:
    def cut(r: dict) -> Iterator[tuple]:
        """Ranges of lines whose samples hold about ``step`` bytes."""
        system, inner = open_path(index_name(r["path"]))
        with io.BufferedReader(system.open_input_stream(inner, compression=None)) as f:
            head = f.readline()
            at = begun = len(head)
            width = records.index_width(head)
            number = first = held = 0
            while line := f.readline():
                fields = line.split()
                held += sum(map(int, fields[2::width]))
                at, number = at + len(line), number + 1
                if held >= step:
                    yield r["path"], begun, at, first, number - first, held
                    begun, first, held = at, number, 0
            if number > first:
                yield r["path"], begun, at, first, number - first, held

    found = sizes_below(path, (".tar", ".idx"))
    have = {p for p, _ in found}
    tars = [p for p, _ in found if p.endswith(".tar")]
    lacking = [p for p in tars if index_name(p) not in have]
    if lacking:
        raise ValueError(f"{lacking[0]} has no index: write_tar_indexes makes one")
    return [x.asDict() for x in _each(spark, [{"path": p} for p in tars], _SIZED, cut)]


_KINDS = {"tfrecord": _tfrecord, "recordio": _recordio, "webdataset": _webdataset, "lmdb": _lmdb, "files": _files, "fixed": _fixed}


def index(spark: SparkSession, form: str, path: str, split_bytes: int = SPLIT_BYTES, **options: int) -> str:
    """Finds the splits of the files below ``path``, stores them as lines of JSON and returns the path of that table.

    ``fixed`` needs ``record_bytes``.
    """
    found = sorted(_KINDS[form](spark, path, split_bytes, **options), key=lambda s: (s["path"], s["first"]))
    where = new_path(spark, "splits")
    system, inner = open_path(where)
    system.create_dir(os.path.dirname(inner), recursive=True)
    with system.open_output_stream(inner, compression=None) as out:
        for s in found:
            if s["count"]:
                out.write((json.dumps({"bytes": s["end"] - s["start"]} | s) + "\n").encode())
    return where


def size(where: str) -> int:
    """Records of all splits of a table."""
    return sum(s["count"] for s in records.splits_of(where))


def read(spark: SparkSession, form: str, path: str, shard: int = 0, shards: int = 1, where: str | None = None, **options: int) -> DataFrame:
    """The records of one shard: those from floor(n shard / shards) up to the next shard's, in the order of files and records.

    ``where`` is a table that ``index`` made, to be shared by ranks and epochs; without it the splits are found now.
    """
    if not 0 <= shard < shards:
        raise ValueError(f"shard {shard} is not one of {shards}")
    records.register(spark)
    where = where or index(spark, form, path, **options)
    more = {"recordbytes": str(options["record_bytes"])} if "record_bytes" in options else {}
    tasks = max(records.TASKS, 4 * spark.sparkContext.defaultParallelism)
    return spark.read.format(form).options(index=where, shard=str(shard), shards=str(shards), tasks=str(tasks), **more).load(path)
