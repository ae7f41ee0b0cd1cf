"""Writers of the record formats, and encoders of small binary formats as Columns.

``df.write.format(name).mode("append").save(path)`` for the formats below. A
task writes under a folder of its own write, whose name readers pass over; the
driver moves the files of the tasks that count when all are done, so retried
and lost tasks leave nothing that is read. Files are closed at about
``maxFileBytes``, so there are few to move, and are named by their task's
number and their own within it, so that their order is that of the rows. Where
a file holds one row, tasks put it in its place themselves: a task that runs
again writes the same names, and the driver has nothing to do for a row. With
``overwrite`` old files go when the new ones are in place.

======================  ===============================================================
``tfrecord``            bytes, floats, ints: maps from a feature's name to its values
``recordio``            label, image_id, image_id2, content
``webdataset``          key, components: map from extension to bytes
``lmdb``                name, value; a database for each file, sorted by name
``fixed``               content: records joined as they are, files named by ``prefix``
``files``               path, content: a file for each row, ``path`` below the folder
======================  ===============================================================
"""

from __future__ import annotations

import io
import json
import struct
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructType

from tilewright.sources import wire
from tilewright.sources.records import RecordIOReader, files_below, masked_crc, open_path

MAX_FILE_BYTES = 64 << 20


def _task() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


@dataclass
class Moves(WriterCommitMessage):
    """(written, final) names below the folder."""

    files: list


class FileWriter(DataSourceWriter):
    suffix = ""

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.options, self.overwrite = options["path"].rstrip("/"), dict(options), overwrite
        self.limit = int(options.get("maxfilebytes", options.get("maxFileBytes", MAX_FILE_BYTES)))
        self.columns = [f.name for f in schema.fields]
        self.own = f"_write-{uuid.uuid4().hex}"
        self.named = 0

    def bodies(self, rows: Iterator[dict]) -> Iterator[tuple[str, bytes]]:
        """(final name, bytes) of each file; by default the encoded records, joined up to the limit."""
        held: list[bytes] = []
        size = 0
        for row in rows:
            held.append(self.encode(row))
            size += len(held[-1])
            if size >= self.limit:
                yield self.name(), b"".join(held)
                held, size = [], 0
        if held:
            yield self.name(), b"".join(held)

    def encode(self, row: dict) -> bytes:
        return bytes(row["content"])

    def numbers(self) -> str:
        """Of the task and of the file within it."""
        self.named += 1
        return f"{_task():05d}-{self.named:05d}"

    def name(self) -> str:
        return f"{self.options.get('prefix', 'part-')}{self.numbers()}-{uuid.uuid4().hex}{self.suffix}"

    def write(self, iterator) -> Moves:
        system, base = open_path(self.path)
        system.create_dir(f"{base}/{self.own}", recursive=True)
        moves = []
        for name, body in self.bodies({c: row[i] for i, c in enumerate(self.columns)} for row in iterator):
            written = f"{self.own}/{uuid.uuid4().hex}"
            with system.open_output_stream(f"{base}/{written}", compression=None) as f:
                f.write(body)
            moves.append((written, name))
        return Moves(moves)

    def commit(self, messages) -> None:
        system, base = open_path(self.path)
        system.create_dir(base, recursive=True)
        old = [p for p in files_below(self.path, (self.suffix,)) if "/_write-" not in p] if self.overwrite else []
        for written, name in (m for message in messages if message is not None for m in message.files):
            final = f"{base}/{name}"
            system.create_dir(final.rpartition("/")[0], recursive=True)
            system.move(f"{base}/{written}", final)
        for gone in old:
            system.delete_file(open_path(gone)[1])
        self.abort(messages)

    def abort(self, messages) -> None:
        system, base = open_path(self.path)
        if system.get_file_info(f"{base}/{self.own}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.own}")


class TFRecordWriter(FileWriter):
    suffix = ".tfrecord"

    def encode(self, row: dict) -> bytes:
        data = wire.example_bytes(row.get("bytes"), row.get("floats"), row.get("ints"))
        head = struct.pack("<Q", len(data))
        return head + struct.pack("<I", masked_crc(head)) + data + struct.pack("<I", masked_crc(data))


class RecordIOWriter(FileWriter):
    suffix = ".rec"

    def encode(self, row: dict) -> bytes:
        whole = struct.pack("<IfQQ", 0, float(row["label"]), row["image_id"] or 0, row.get("image_id2") or 0) + bytes(row["content"])
        mark, pieces, start, at = struct.pack("<I", RecordIOReader.MAGIC), [], 0, 0
        # Where the magic number stands at a multiple of four the record is parted and the number left out.
        while (at := whole.find(mark, at)) >= 0:
            if at % 4 == 0:
                pieces.append(whole[start:at])
                start = at = at + 4
            else:
                at += 1
        pieces.append(whole[start:])
        kinds = [0] if len(pieces) == 1 else [1, *[2] * (len(pieces) - 2), 3]
        return b"".join(mark + struct.pack("<I", kind << 29 | len(p)) + p + b"\0" * (-len(p) % 4) for kind, p in zip(kinds, pieces))


class WebDatasetWriter(FileWriter):
    suffix = ".tar"

    def bodies(self, rows: Iterator[dict]) -> Iterator[tuple[str, bytes]]:
        out = tar = None
        for row in rows:
            if out is None:
                out = io.BytesIO()
                tar = tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT)
            for extension, data in sorted((row["components"] or {}).items()):
                info = tarfile.TarInfo(f"{row['key']}.{extension}")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(bytes(data)))
            if out.tell() >= self.limit:
                tar.close()
                yield self.name(), out.getvalue()
                out = None
        if out is not None:
            tar.close()
            yield self.name(), out.getvalue()


class LmdbWriter(FileWriter):
    suffix = "data.mdb"
    PAGE = 4096
    _NONE = (1 << 64) - 1

    def name(self) -> str:
        return f"part-{self.numbers()}-{uuid.uuid4().hex}/data.mdb"

    def bodies(self, rows: Iterator[dict]) -> Iterator[tuple[str, bytes]]:
        held, size = {}, 0
        for row in rows:
            key = row["name"].encode()
            if not 0 < len(key) <= 511:
                raise ValueError("a key has 1 to 511 bytes")
            held[key] = bytes(row["value"])
            size += len(held[key])
            if size >= self.limit:
                yield self.name(), self.database(sorted(held.items()))
                held, size = {}, 0
        if held:
            yield self.name(), self.database(sorted(held.items()))

    def _node_page(self, number: int, kind: int, nodes: list[bytes]) -> bytes:
        page, upper, places = bytearray(self.PAGE), self.PAGE, []
        for node in nodes:
            upper -= len(node)
            page[upper : upper + len(node)] = node
            places.append(upper)
        page[:16] = struct.pack("<QHHHH", number, 0, kind, 16 + 2 * len(places), upper)
        page[16 : 16 + 2 * len(places)] = struct.pack(f"<{len(places)}H", *places)
        return bytes(page)

    def database(self, items: list[tuple[bytes, bytes]]) -> bytes:
        """Pages of one database: large values on pages of their own, leaves, then branch pages up to one root."""
        pages: list[bytes] = []
        counts = {"branch": 0, "leaf": 0, "big": 0}
        even = lambda node: node + b"\0" * (len(node) % 2)

        def level(entries: list[tuple[bytes, bytes]], kind: int, what: str) -> list[tuple[bytes, int]]:
            """(first key, page number) of the pages that hold the encoded nodes."""
            out, nodes, room, first = [], [], self.PAGE - 16, b""
            for key, node in [*entries, (b"", b"")]:
                if nodes and (not node or len(node) + 2 > room):
                    out.append((first, len(pages) + 2))
                    pages.append(self._node_page(len(pages) + 2, kind, nodes))
                    counts[what] += 1
                    nodes, room = [], self.PAGE - 16
                if node:
                    first = first if nodes else key
                    nodes.append(node)
                    room -= len(node) + 2
            return out

        leaves = []
        for key, value in items:
            big = len(value) > self.PAGE // 4
            rest = value
            if big:
                number, n = len(pages) + 2, -(-(len(value) + 16) // self.PAGE)
                body = (struct.pack("<QHHI", number, 0, 4, n) + value).ljust(n * self.PAGE, b"\0")
                pages.extend(body[i * self.PAGE : (i + 1) * self.PAGE] for i in range(n))
                counts["big"] += n
                rest = struct.pack("<Q", number)
            leaves.append((key, even(struct.pack("<HHHH", len(value) & 0xFFFF, len(value) >> 16, int(big), len(key)) + key + rest)))
        found, depth = level(leaves, 2, "leaf"), 1
        while len(found) > 1:
            child = lambda key, number: (key, even(struct.pack("<HHHH", number & 0xFFFF, number >> 16 & 0xFFFF, number >> 32, len(key)) + key))
            found, depth = level([child(k, n) for k, n in found], 1, "branch"), depth + 1
        root = found[0][1] if found else self._NONE
        free = struct.pack("<IHHQQQQQ", self.PAGE, 0, 0, 0, 0, 0, 0, self._NONE)
        main = struct.pack("<IHHQQQQQ", 0, 0, depth, counts["branch"], counts["leaf"], counts["big"], len(items), root)
        last = len(pages) + 1
        metas = [
            (struct.pack("<QHHI", m, 0, 8, 0) + struct.pack("<IIQQ", 0xBEEFC0DE, 1, 0, (last + 1) * self.PAGE) + free + main + struct.pack("<QQ", last, m)).ljust(self.PAGE, b"\0")
            for m in (0, 1)
        ]
        return b"".join([*metas, *pages])


class RowFileWriter(FileWriter):
    """Tasks put files in place; an overwritten folder is replaced by a new one beside it.

    A task writes some files under other names, notes their names in a list and
    then moves them. If the write fails, the lists tell what to take back: the
    driver reads them then, and not otherwise.
    """

    SOME = 500

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        super().__init__(options, schema, overwrite)
        self.final = self.path
        if overwrite:
            self.path += f".{self.own}"

    def write(self, iterator) -> Moves:
        system, base = open_path(self.path)
        system.create_dir(f"{base}/{self.own}", recursive=True)
        made: set[str] = set()
        some: list[tuple[str, str]] = []
        for row in ({c: row[i] for i, c in enumerate(self.columns)} for row in iterator):
            name = row["path"]
            if name.startswith(("/", "_")) or ".." in name.split("/"):
                raise ValueError(f"not a name below the folder: {name}")
            early = f"{self.own}/{uuid.uuid4().hex}"
            with system.open_output_stream(f"{base}/{early}", compression=None) as f:
                f.write(bytes(row["content"]))
            some.append((early, name))
            if len(some) == self.SOME:
                self._place(system, base, some, made)
        self._place(system, base, some, made)
        return Moves([])

    def _place(self, system, base: str, some: list[tuple[str, str]], made: set[str]) -> None:
        """Moves files to their names; a file that stood there is kept until the write is done."""
        if not some:
            return
        there = {i.path for i in system.get_file_info([f"{base}/{n}" for _, n in some]) if i.type == fs.FileType.File}
        before = {n: f"{early}.before" for early, n in some if f"{base}/{n}" in there}
        with system.open_output_stream(f"{base}/{self.own}/{uuid.uuid4().hex}.list", compression=None) as f:
            f.write(json.dumps([(n, before.get(n)) for _, n in some]).encode())
        for early, name in some:
            final = f"{base}/{name}"
            if (folder := final.rpartition("/")[0]) not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            if name in before:
                system.move(final, f"{base}/{before[name]}")
            system.move(f"{base}/{early}", final)
        some.clear()

    def commit(self, messages) -> None:
        super().abort(messages)
        if self.overwrite:
            system, base = open_path(self.final)
            system.create_dir(open_path(self.path)[1], recursive=True)
            there = system.get_file_info(base).type == fs.FileType.Directory
            if there:
                system.move(base, f"{base}.old{self.own}")
            system.move(open_path(self.path)[1], base)
            if there:
                system.delete_dir(f"{base}.old{self.own}")

    def abort(self, messages) -> None:
        system, base = open_path(self.path)
        kind = lambda path: system.get_file_info(path).type
        if self.overwrite:
            if kind(base) == fs.FileType.Directory:
                system.delete_dir(base)
            return
        if kind(f"{base}/{self.own}") == fs.FileType.Directory:
            for found in system.get_file_info(fs.FileSelector(f"{base}/{self.own}")):
                if found.path.endswith(".list"):
                    with system.open_input_stream(found.path, compression=None) as f:
                        placed = json.loads(f.read())
                    for name, before in placed:
                        if before and kind(f"{base}/{before}") == fs.FileType.File:
                            system.move(f"{base}/{before}", f"{base}/{name}")
                        elif not before and kind(f"{base}/{name}") == fs.FileType.File:
                            system.delete_file(f"{base}/{name}")
        super().abort(messages)


WRITERS = {"tfrecord": TFRecordWriter, "recordio": RecordIOWriter, "webdataset": WebDatasetWriter, "lmdb": LmdbWriter, "fixed": FileWriter, "files": RowFileWriter}


# --- encoders ---


def _encoder(f):
    """A Column function from arrays to binary, null where a null comes in."""

    @F.pandas_udf(BinaryType())
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(np.asarray(v)) for v in values], dtype=object)

    return run


def unsigned_bytes(values):
    """8-bit values as bytes."""
    return _encoder(lambda v: v.astype(np.uint8).tobytes())(values)


def npy_bytes(values, *shape: int):
    """A version 1 array file of 32-bit floats."""

    def one(v: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.save(out, v.astype("<f4").reshape(shape or -1), allow_pickle=False)
        return out.getvalue()

    return _encoder(one)(values)


def wav_bytes(samples, rate: int, channels: int = 1):
    """A WAVE file of 32-bit floats, frames interleaved."""

    def one(v: np.ndarray) -> bytes:
        body = v.astype("<f4").tobytes()
        form = struct.pack("<HHIIHH", 3, channels, rate, rate * channels * 4, channels * 4, 32)
        chunks = b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body
        return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks

    return _encoder(one)(samples)


def bmp_bytes(values, h: int, w: int):
    """An uncompressed 24-bit picture of RGB values, rows from the bottom."""
    line = -(-w * 3 // 4) * 4

    def one(v: np.ndarray) -> bytes:
        rows = np.zeros((h, line), np.uint8)
        rows[:, : w * 3] = v.astype(np.uint8).reshape(h, w, 3)[::-1, :, ::-1].reshape(h, w * 3)
        return struct.pack("<2sIHHI", b"BM", 54 + h * line, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, h * line, 2835, 2835, 0, 0) + rows.tobytes()

    return _encoder(one)(values)


def datum(label, content, boxes=None, labels=None):
    """A Caffe record; boxes are arrays of (x, y, width, height)."""

    @F.pandas_udf(BinaryType())
    def plain(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([wire.datum_bytes(int(x), bytes(y)) for x, y in zip(a, b)], dtype=object)

    @F.pandas_udf(BinaryType())
    def annotated(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([wire.datum_bytes(int(x), bytes(y), list(z), [int(n) for n in own]) for x, y, z, own in zip(a, b, c, d)], dtype=object)

    return plain(label, content) if boxes is None else annotated(label, content, boxes, labels)


def tensors(labels, content, boxes=None):
    """A Caffe2 record; boxes are arrays of whole (x, y, width, height)."""

    @F.pandas_udf(BinaryType())
    def plain(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([wire.tensors_bytes([int(n) for n in x], bytes(y)) for x, y in zip(a, b)], dtype=object)

    @F.pandas_udf(BinaryType())
    def boxed(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([wire.tensors_bytes([int(n) for n in x], bytes(y), list(z)) for x, y, z in zip(a, b, c)], dtype=object)

    return plain(labels, content) if boxes is None else boxed(labels, content, boxes)
