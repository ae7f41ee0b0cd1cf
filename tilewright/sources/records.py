"""Record formats as Python data sources: TFRecord, RecordIO, WebDataset, LMDB, fixed records and whole files.

Each archive file is a partition, read as a stream of records; RecordIO files
are split by bytes, and an LMDB file is divided by the children of its root
page. With a table of splits (``splits.index``) every format is planned by it,
and only the splits of one shard are; where there are more splits than tasks are
worth starting for, neighbours share a task. Formats: ``tfrecord``, ``recordio``,
``webdataset``, ``lmdb``, ``fixed`` and ``files``; ``register`` makes them
known. ``sinks`` writes them.
"""

from __future__ import annotations

import json
import os
import struct
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tilewright.sources import wire


def open_path(path: str):
    """(file system, path in it): local paths and file: URIs directly, other schemes through pyarrow."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def sizes_below(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of the path itself if it is a file, else of the files below with one of the suffixes, sorted."""
    system, base = open_path(path)
    own = system.get_file_info(base)
    if own.type == fs.FileType.File:
        return [(path, own.size)]
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((f"{path.rstrip('/')}/{os.path.relpath(x.path, base)}", x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(suffixes))


def files_below(path: str, suffixes: tuple[str, ...]) -> list[str]:
    return [p for p, _ in sizes_below(path, suffixes)]


@dataclass
class FilePart(InputPartition):
    """A file or a range of it; ``first`` numbers its first record, ``skip`` records are passed over and ``take`` are read (-1: all)."""

    path: str
    page: int = -1
    start: int = 0
    end: int = -1
    first: int = 0
    skip: int = 0
    take: int = -1
    size: int = 0


@dataclass
class FileGroup(InputPartition):
    """Parts that one task reads, in order."""

    parts: list


def splits_of(where: str) -> list[dict]:
    """The splits that ``splits.index`` stored, by path and first record."""
    system, inner = open_path(where)
    with system.open_input_stream(inner, compression=None) as f:
        return [json.loads(x) for x in f.read().decode().splitlines()]


def shard_parts(where: str, shard: int, shards: int) -> list[FilePart]:
    """The splits, or parts of them, that hold the records of one shard."""
    found = splits_of(where)
    n = sum(s["count"] for s in found)
    low, high, at, out = n * shard // shards, n * (shard + 1) // shards, 0, []
    for s in found:
        a, b = max(low, at), min(high, at + s["count"])
        if a < b:
            size = s.get("bytes", GROUP_BYTES) * (b - a) // s["count"]
            out.append(FilePart(s["path"], s["start"], s["start"], s["end"], s["first"], a - at, b - a, size))
        at += s["count"]
    return out


#: Splits up to this number are tasks of their own; more of them are joined to about as many groups, or to more of ``GROUP_BYTES`` each.
TASKS = 256
GROUP_BYTES = 128 << 20


def grouped(parts: list[FilePart], tasks: int = TASKS) -> list[FileGroup]:
    """Neighbouring parts together, in groups of about equal bytes; ranges of a file that touch become one."""
    total = sum(p.size for p in parts)
    groups = max(tasks, -(-total // GROUP_BYTES))
    if len(parts) <= groups:
        return [FileGroup([p]) for p in parts]
    out: list[FileGroup] = []
    at, number = 0, -1
    for part in parts:
        # A group holds the parts whose middles lie in its stretch of the bytes.
        own = (2 * at + part.size) * groups // (2 * total + 1)
        last = out[-1].parts[-1] if own == number else None
        if last is None:
            out.append(FileGroup([part]))
        elif last.path == part.path and last.end == part.start and not part.skip:
            out[-1].parts[-1] = replace(last, end=part.end, take=last.take + part.take, size=last.size + part.size)
        else:
            out[-1].parts.append(part)
        at, number = at + part.size, own
    return out


class FileReader(DataSourceReader):
    suffixes: tuple[str, ...] = ("",)

    def __init__(self, options: dict) -> None:
        self.path, self.options = options["path"], dict(options)

    def partitions(self) -> list[InputPartition]:
        """By the table of splits if there is one; at least one part, as the reader must yield something to run."""
        if "index" in self.options:
            return self.groups(self.shard_parts()) or [FilePart("")]
        return self.parts() or [FilePart("")]

    def shard_parts(self) -> list[FilePart]:
        shard, shards = (int(self.options.get(k, d)) for k, d in (("shard", 0), ("shards", 1)))
        return shard_parts(self.options["index"], shard, shards)

    def groups(self, parts: list[FilePart]) -> list[InputPartition]:
        return grouped(parts, int(self.options.get("tasks", TASKS)))

    def parts(self) -> list[InputPartition]:
        return [FilePart(p) for p in files_below(self.path, self.suffixes)]

    def read(self, partition: FilePart | FileGroup) -> Iterator[tuple]:
        for part in partition.parts if isinstance(partition, FileGroup) else [partition]:
            if part.path:
                yield from islice(self.records(part), part.take if part.take >= 0 else None)

    def records(self, partition: FilePart) -> Iterator[tuple]:
        raise NotImplementedError


def _exactly(stream, n: int, what: str) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError(f"{what} is cut short")
    return data


_LANE = 512
_SHORT = 24


def crc32c(data: bytes) -> int:
    """CRC-32C. Data are cut into lanes; a lane's remainder joins those of its bytes, looked up by place, and lanes are joined in order."""
    if len(data) < _SHORT:
        crc = 0xFFFFFFFF
        for b in data:
            crc = _CRC[(crc ^ b) & 0xFF] ^ crc >> 8
        return crc ^ 0xFFFFFFFF
    # Zeros in front don't change a remainder that starts at 0; inverting the first four bytes starts it at ~0.
    x = np.zeros(-(-len(data) // _LANE) * _LANE, np.uint8)
    start = len(x) - len(data)
    x[start:] = np.frombuffer(data, np.uint8)
    x[start : start + 4] ^= 0xFF
    lanes = x.reshape(-1, _LANE)
    a, b, c, d = _AHEAD
    out = 0
    for at in range(0, len(lanes), 512):
        for own in np.bitwise_xor.reduce(_PLACES.take(lanes[at : at + 512] + _ROWS), axis=1).tolist():
            out = a[out & 0xFF] ^ b[out >> 8 & 0xFF] ^ c[out >> 16 & 0xFF] ^ d[out >> 24] ^ own
    return out ^ 0xFFFFFFFF


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ 0x82F63B78 if b & 1 else b >> 1
        out.append(b)
    return out


_CRC = _crc_table()
_CRC_ARRAY = np.asarray(_CRC, np.uint32)


def _ahead() -> list[list[int]]:
    """For each byte of a remainder what it becomes after a lane of zeros; the map is linear."""
    crc = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for _ in range(_LANE):
        crc = _CRC_ARRAY[crc & 0xFF] ^ crc >> 8
    return crc.tolist()


_AHEAD = _ahead()


def _places() -> np.ndarray:
    """The remainder of each byte at each place of a lane, the last place last."""
    out = np.empty((_LANE, 256), np.uint32)
    crc = _CRC_ARRAY
    for place in range(_LANE - 1, -1, -1):
        out[place] = crc
        crc = _CRC_ARRAY[crc & 0xFF] ^ crc >> 8
    return out.ravel()


_PLACES = _places()
_ROWS = np.arange(_LANE, dtype=np.int64) * 256


def masked_crc(data: bytes) -> int:
    crc = crc32c(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


_BUFFER = 1 << 20


def tfrecord_length(head: bytes, n: int | None = None) -> int:
    """The length in a record's 12-byte header, if its checksum is right."""
    if len(head) != 12:
        raise ValueError("a record is cut short")
    size, crc = struct.unpack("<QI", head)
    if masked_crc(head[:8]) != crc:
        raise ValueError(f"wrong checksum of {'a record' if n is None else f'record {n}'}'s length")
    return size


class TFRecordReader(FileReader):
    suffixes = (".tfrecord", ".tfrecords", ".record")

    def records(self, partition: FilePart) -> Iterator[tuple]:
        check = str(self.options.get("verify", "true")).lower() == "true"
        name = os.path.basename(open_path(partition.path)[1])
        with _random_access(partition.path) as f:
            at, n = partition.start, partition.first + partition.skip
            for _ in range(partition.skip):
                at += 16 + tfrecord_length(f.read_at(12, at))
            f.seek(at)
            stream = pa.BufferedInputStream(f, _BUFFER)
            while (partition.end < 0 or at < partition.end) and (head := stream.read(12)):
                size = tfrecord_length(head, n)
                data, (crc,) = _exactly(stream, size, "a record"), struct.unpack("<I", _exactly(stream, 4, "a record"))
                if check and masked_crc(data) != crc:
                    raise ValueError(f"wrong checksum of record {n}")
                kinds: tuple[dict, dict, dict] = ({}, {}, {})
                for key, values in wire.example(data).items():
                    which = 0 if values and isinstance(values[0], bytes) else 1 if values and isinstance(values[0], float) else 2
                    kinds[which][key] = values
                yield (name, n, *kinds)
                at, n = at + 16 + size, n + 1


class RecordIOReader(FileReader):
    """Single-label records; those with a list of labels are passed over.

    A file is split every ``splitBytes``: the magic number stands at a multiple
    of four only where a part of a record begins, so a reader that starts
    anywhere finds the next record. Each range yields the records that begin in it.
    """

    suffixes = (".rec",)
    MAGIC = 0xCED7230A
    SPLIT_BYTES = 128 << 20
    _BLOCK = 1 << 20

    def parts(self) -> list[InputPartition]:
        step = int(self.options.get("splitbytes", self.options.get("splitBytes", self.SPLIT_BYTES)))
        step = max(4, step - step % 4)
        return [FilePart(p, start=a, end=min(a + step, n)) for p, n in sizes_below(self.path, self.suffixes) for a in range(0, n, step)]

    def _first(self, f, start: int, end: int) -> int:
        """The first place in [start, end) at which a record begins, or ``end``."""
        for at in range(start, end, self._BLOCK):
            words = np.frombuffer(f.read_at(min(self._BLOCK, end - at) // 4 * 4, at), "<u4")
            for k in np.flatnonzero(words == self.MAGIC).tolist():
                head = f.read_at(8, at + 4 * k)
                if len(head) < 8:
                    raise ValueError("a record is cut short")
                if struct.unpack("<II", head)[1] >> 29 in (0, 1):
                    return at + 4 * k
        return end

    def heads(self, f, start: int, end: int) -> Iterator[int]:
        """Places of the single-label records that begin in the range; bodies are passed over."""
        at, begun, open_record = self._first(f, start, end) if start else 0, 0, False
        while at < end or open_record:
            head = f.read_at(12, at)
            if len(head) < 8 or struct.unpack_from("<I", head)[0] != self.MAGIC:
                raise ValueError("not a RecordIO file")
            part, size = struct.unpack_from("<I", head, 4)[0] >> 29, struct.unpack_from("<I", head, 4)[0] & (1 << 29) - 1
            begun = at if part in (0, 1) else begun
            if part in (0, 1):
                # The number may stand where the flag is; then the flag isn't zero.
                single = size >= 4 and head[8:12] == b"\0\0\0\0"
            open_record = part in (1, 2)
            if single and not open_record:
                yield begun
            at += 8 + size + -size % 4

    def records(self, partition: FilePart) -> Iterator[tuple]:
        with _random_access(partition.path) as f:
            if partition.skip:
                at = next(islice(self.heads(f, partition.start, partition.end), partition.skip, None), partition.end)
            else:
                at = self._first(f, partition.start, partition.end) if partition.start else 0
            f.seek(at)
            stream, whole, open_record = pa.BufferedInputStream(f, self._BLOCK), b"", False
            end = partition.end if partition.end >= 0 else f.size()
            while at < end or open_record:
                head = stream.read(8)
                if len(head) != 8:
                    raise ValueError("a record is cut short")
                magic, word = struct.unpack("<II", head)
                if magic != self.MAGIC:
                    raise ValueError("not a RecordIO file")
                part, size = word >> 29, word & (1 << 29) - 1
                data = _exactly(stream, size + -size % 4, "a record")[:size]
                at += 8 + size + -size % 4
                # 1, 2 and 3 are the first, middle and last part of a record that holds the magic number.
                whole = data if part in (0, 1) else whole + head[:4] + data
                open_record = part in (1, 2)
                if open_record:
                    continue
                flag, label, first, second = struct.unpack_from("<IfQQ", whole)
                if flag == 0:
                    yield str(first), int(label), first, second, whole[24:]


def sample_name(member: str) -> tuple[str, str]:
    """(sample, extension) of a tar member: up to and after the first dot of the base name."""
    folder, _, base = member.rpartition("/")
    stem, _, extension = base.partition(".")
    return f"{folder}/{stem}" if folder else stem, extension


def index_width(head: bytes) -> int:
    """Fields that an index has for each component: extension, offset and size, and but in version 1.1 a name."""
    version, *_ = head.split() or [b""]
    if not version.startswith(b"v1."):
        raise ValueError(f"not an index of version 1: {head[:20]!r}")
    return 3 if version == b"v1.1" else 4


class WebDatasetReader(FileReader):
    """Members of a tar are grouped by name up to the first dot of the base name; groups stand together in the file."""

    suffixes = (".tar",)

    def records(self, partition: FilePart) -> Iterator[tuple]:
        system, path = open_path(partition.path)
        if "index" in self.options:
            yield from self._listed(system, path, partition)
            return
        with system.open_input_stream(path, compression=None) as f, tarfile.open(fileobj=f, mode="r|*") as tar:
            key, parts = None, {}
            for member in tar:
                if not member.isfile():
                    continue
                name, extension = sample_name(member.name)
                if name != key and parts:
                    yield os.path.basename(path), key, parts
                    parts = {}
                key = name
                parts[extension] = tar.extractfile(member).read()
            if parts:
                yield os.path.basename(path), key, parts

    def _listed(self, system, path: str, partition: FilePart) -> Iterator[tuple]:
        """The samples of a range of lines of the tar's index: one read for each, from its first component to its last.

        Samples of an index without names are called by the number of their line, from 1.
        """
        with system.open_input_file(path.removesuffix(".tar") + ".idx") as f:
            width = index_width(f.read_at(64, 0))
            lines = f.read_at(partition.end - partition.start, partition.start).decode().splitlines()
        with system.open_input_file(path) as tar:
            for number, line in enumerate(lines[partition.skip :], partition.first + partition.skip + 1):
                fields = line.split()
                if not fields or len(fields) % width:
                    raise ValueError(f"line {number} of the index of {path} is broken")
                parts = [(e, int(o), int(n)) for e, o, n in zip(fields[::width], fields[1::width], fields[2::width])]
                start, end = min(o for _, o, _ in parts), max(o + n for _, o, n in parts)
                data = tar.read_at(end - start, start)
                if len(data) != end - start:
                    raise ValueError(f"{path} ends before the sample of line {number}")
                key = sample_name(fields[3])[0] if width == 4 else str(number)
                yield os.path.basename(path), key, {e: data[o - start : o - start + n] for e, o, n in parts}


class LmdbReader(FileReader):
    """Keys and values in key order, from the newer of the two meta pages; read by offset, never mapped.

    The options ``low`` and ``high`` bound the keys, both included: pages whose
    keys all lie outside are not read. They are options, since Spark keeps the
    reader of a loaded table, with the predicates that one query handed down,
    for the next query over it.
    """

    suffixes = ("data.mdb",)
    BRANCH, LEAF, BIG = 1, 2, 1

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.low, self.high = (options[k].encode() if k in options else None for k in ("low", "high"))
        if "index" in options and (self.low or self.high):
            raise ValueError("a table of splits counts all keys, so it goes without bounds")

    def parts(self) -> list[InputPartition]:
        out = []
        for path in files_below(self.path, self.suffixes):
            with _random_access(path) as f:
                size, root = self._root(f)
                if root != (1 << 64) - 1:
                    page = self._page(f, size, root)
                    flags = struct.unpack_from("<H", page, 10)[0]
                    roots = list(self._inside(page)) if flags & self.BRANCH else [root]
                    out += [FilePart(path, r) for r in roots]
        return out

    def records(self, partition: FilePart) -> Iterator[tuple]:
        skip = partition.skip
        with _random_access(partition.path) as f:
            size, _ = self._root(f)
            # A table of splits has the page where other formats have the range's start.
            for page in self._leaves(f, size, partition.start if "index" in self.options else partition.page):
                n = self._entries(page)
                if skip >= n:
                    skip -= n
                    continue
                yield from self._values(f, size, page, skip)
                skip = 0

    def count(self, f, page: int) -> tuple[int, int]:
        """Entries below a page, and the bytes of their keys and values; values aren't read."""
        entries = held = 0
        for leaf in self._leaves(f, self._root(f)[0], page):
            entries += self._entries(leaf)
            held += sum(n + (lo | hi << 16) for _, lo, hi, _, n in self._nodes(leaf))
        return entries, held

    def _root(self, f) -> tuple[int, int]:
        head = f.read_at(152, 0)
        magic, _, _, _, size = struct.unpack_from("<IIQQI", head, 16)
        if magic != 0xBEEFC0DE:
            raise ValueError("not an LMDB file")
        metas = [f.read_at(152, k * size) for k in (0, 1)]
        newest = max(metas, key=lambda m: struct.unpack_from("<Q", m, 144)[0])
        return size, struct.unpack_from("<Q", newest, 128)[0]

    def _page(self, f, size: int, number: int) -> bytes:
        return f.read_at(size, number * size)

    def _entries(self, page: bytes) -> int:
        return (struct.unpack_from("<H", page, 12)[0] - 16) // 2

    def _nodes(self, page: bytes) -> Iterator[tuple[int, int, int, int, int]]:
        lower = struct.unpack_from("<H", page, 12)[0]
        for (at,) in struct.iter_unpack("<H", page[16:lower]):
            yield at, *struct.unpack_from("<HHHH", page, at)

    def _inside(self, page: bytes) -> Iterator[int]:
        """Children of a branch page whose keys may lie within the bounds: a child's keys end where the next one's begin."""
        nodes = [(lo | hi << 16 | flags << 32, page[at + 8 : at + 8 + n]) for at, lo, hi, flags, n in self._nodes(page)]
        for i, (child, key) in enumerate(nodes):
            after = nodes[i + 1][1] if i + 1 < len(nodes) else None
            below = self.low is not None and after is not None and after <= self.low
            above = self.high is not None and i > 0 and key > self.high
            if not below and not above:
                yield child

    def _leaves(self, f, size: int, number: int) -> Iterator[bytes]:
        page = self._page(f, size, number)
        if struct.unpack_from("<H", page, 10)[0] & self.BRANCH:
            for child in self._inside(page):
                yield from self._leaves(f, size, child)
        else:
            yield page

    def _values(self, f, size: int, page: bytes, skip: int) -> Iterator[tuple[str, bytes]]:
        for at, lo, hi, flags, n in islice(self._nodes(page), skip, None):
            key, length = page[at + 8 : at + 8 + n], lo | hi << 16
            if (self.low is not None and key < self.low) or (self.high is not None and key > self.high):
                continue
            if flags & self.BIG:
                (first,) = struct.unpack_from("<Q", page, at + 8 + n)
                value = f.read_at(length, first * size + 16)
            else:
                value = page[at + 8 + n : at + 8 + n + length]
            yield key.decode("utf-8", "replace"), value


class FixedReader(FileReader):
    """Records of ``recordBytes`` each, files split at whole records."""

    SPLIT_BYTES = 128 << 20

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.size = int(options.get("recordbytes", options.get("recordBytes", 0)))
        if self.size < 1:
            raise ValueError("recordBytes says how many bytes a record has")

    def parts(self) -> list[InputPartition]:
        step = max(1, self.SPLIT_BYTES // self.size) * self.size
        return [FilePart(p, start=a, end=min(a + step, n), first=a // self.size) for p, n in sizes_below(self.path, self.suffixes) for a in range(0, n, step)]

    def records(self, partition: FilePart) -> Iterator[tuple]:
        name = os.path.basename(open_path(partition.path)[1])
        with _random_access(partition.path) as f:
            f.seek(partition.start + partition.skip * self.size)
            stream = pa.BufferedInputStream(f, _BUFFER)
            for at in range(f.tell(), partition.end, self.size):
                yield name, at // self.size, _exactly(stream, self.size, "a record")


class WholeFileReader(FileReader):
    """A file is a record; its path is the part below the folder. Small files share a task."""

    OPEN_BYTES = 4 << 20

    def parts(self) -> list[InputPartition]:
        return [FilePart(p, end=n) for p, n in sizes_below(self.path, self.suffixes)]

    def partitions(self) -> list[InputPartition]:
        groups, held = [], 0
        for part in (self.shard_parts() if "index" in self.options else self.parts()) or [FilePart("")]:
            cost = part.end - part.start + self.OPEN_BYTES
            if not groups or held + cost > GROUP_BYTES:
                groups.append(FileGroup([]))
                held = 0
            groups[-1].parts.append(part)
            held += cost
        return groups

    def records(self, partition: FilePart) -> Iterator[tuple]:
        system, path = open_path(partition.path)
        with system.open_input_stream(path, compression=None) as f:
            yield os.path.relpath(path, open_path(self.path)[1]), f.read()


def _random_access(path: str):
    system, inner = open_path(path)
    return system.open_input_file(inner)


def _source(label: str, columns: str, kind: type[FileReader]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return columns

        def reader(self, schema):
            return kind(self.options)

        def writer(self, schema, overwrite: bool):
            from tilewright.sources.sinks import WRITERS

            return WRITERS[label](self.options, schema, overwrite)

    return Source


SOURCES = {
    "tfrecord": ("file string, record long, bytes map<string,array<binary>>, floats map<string,array<float>>, ints map<string,array<long>>", TFRecordReader),
    "recordio": ("name string, label int, image_id long, image_id2 long, content binary", RecordIOReader),
    "webdataset": ("file string, key string, components map<string,binary>", WebDatasetReader),
    "lmdb": ("name string, value binary", LmdbReader),
    "fixed": ("file string, record long, content binary", FixedReader),
    "files": ("path string, content binary", WholeFileReader),
}


def register(spark: SparkSession) -> None:
    """Makes the formats known."""
    for label, (columns, kind) in SOURCES.items():
        spark.dataSource.register(_source(label, columns, kind))


# --- what the sources' records mean ---


def tf_classification(records: DataFrame, encoded: str = "image/encoded", label: str = "image/class/label", filename: str | None = "image/filename") -> DataFrame:
    """(name, content, label); without a file name key the name is file and record number."""
    number = F.concat_ws("_", "file", F.col("record").cast("string"))
    given = F.get(F.element_at("bytes", filename), F.lit(0)).cast("string") if filename else F.lit(None).cast("string")
    return records.select(F.coalesce(given, number).alias("name"), F.get(F.element_at("bytes", encoded), F.lit(0)).alias("content"), F.get(F.element_at("ints", label), F.lit(0)).cast("int").alias("label"))


def tf_detection(records: DataFrame, prefix: str = "image/object/bbox", label: str = "image/object/class/label") -> DataFrame:
    """(file, record, boxes, labels): relative edges times width and height."""
    edge = lambda k: F.element_at("floats", f"{prefix}/{k}")
    w, h = (F.get(F.element_at("ints", f"image/{k}"), F.lit(0)).cast("double") for k in ("width", "height"))
    boxes = F.transform(
        F.arrays_zip(edge("xmin").alias("l"), edge("ymin").alias("t"), edge("xmax").alias("r"), edge("ymax").alias("b")),
        lambda x: F.struct((x["l"] * w).alias("l"), (x["t"] * h).alias("t"), (x["r"] * w).alias("r"), (x["b"] * h).alias("b")),
    )
    return records.select("file", "record", boxes.alias("boxes"), F.element_at("ints", label).cast("array<int>").alias("labels"))


_BOXED = "name string, label int, content binary, boxes array<struct<l:double,t:double,r:double,b:double>>, labels array<int>"
_NONE = ([{"l": 0.0, "t": 0.0, "r": 1.0, "b": 1.0}], [0])


def _mapped(values: DataFrame, parse) -> DataFrame:
    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = [parse(bytes(v)) for v in frame["value"]]
            yield pd.DataFrame({"name": frame["name"], **{c: [r[c] for r in rows] for c in ("label", "content", "boxes", "labels")}})

    return values.select("name", "value").mapInPandas(run, _BOXED)


def caffe(values: DataFrame) -> DataFrame:
    """(name, label, content, boxes, labels) of Caffe records; the upper edges are stored as offsets and are added. No box: (0, 0, 1, 1), label 0."""

    def parse(value: bytes) -> dict:
        d = wire.datum(value)
        boxes = [{"l": x, "t": y, "r": x + w, "b": y + h} for x, y, w, h in d["boxes"]]
        return {"label": d["label"], "content": d["data"], "boxes": boxes or _NONE[0], "labels": d["labels"] or _NONE[1]}

    return _mapped(values, parse)


def caffe2(values: DataFrame) -> DataFrame:
    """(name, label, content, boxes, labels) of Caffe2 records: tensors of image, label and, as left, top, width and height in its dimensions, boxes."""

    def parse(value: bytes) -> dict:
        t = wire.tensors(value) + [{"dims": [], "ints": [], "bytes": b"", "strings": []}] * 3
        content = t[0]["bytes"] or (t[0]["strings"] or [b""])[0]
        labels = t[1]["ints"] or _NONE[1]
        four = zip(*[iter(t[2]["dims"])] * 4)
        boxes = [{"l": float(x), "t": float(y), "r": float(x + w), "b": float(y + h)} for x, y, w, h in four]
        return {"label": labels[0], "content": content, "boxes": boxes or _NONE[0], "labels": labels if boxes else _NONE[1]}

    return _mapped(values, parse)


def lmdb(spark: SparkSession, path: str, name: str | None = None, low: str | None = None, high: str | None = None, prefix: str | None = None) -> DataFrame:
    """(name, value) of the keys equal to ``name``, from ``low`` to ``high`` (both included) or beginning with ``prefix``; only their pages are read."""
    lows = [x for x in (name, low, prefix) if x is not None]
    # Text above all that begin with the prefix: no character comes after this one.
    highs = [x for x in (name, high, None if prefix is None else prefix + "\U0010ffff" * 128) if x is not None]
    bounds = {k: f(v) for k, v, f in (("low", lows, max), ("high", highs, min)) if v}
    return spark.read.format("lmdb").options(**bounds).load(path)


def web_components(samples: DataFrame, extensions: list[list[str]], missing: str = "empty") -> DataFrame:
    """(file, key, c0, c1, ...): for each set of extensions the first component found.

    Missing components are null ("empty"), drop the sample ("skip") or are an error ("error").
    """
    picked = [F.coalesce(*(F.element_at("components", e) for e in group)) for group in extensions]
    out = samples.select("file", "key", *(c.alias(f"c{i}") for i, c in enumerate(picked)))
    lacking = F.greatest(*(F.col(f"c{i}").isNull() for i in range(len(picked)))) if len(picked) > 1 else F.col("c0").isNull()
    if missing == "skip":
        return out.where(~lacking)
    if missing == "error":
        return out.where(F.assert_true(~lacking, F.concat(F.lit("missing component in "), "key")).isNull())
    return out
