"""What the first bytes of files tell: sizes of pictures, and arrays of a type, a shape or a range of rows.

``image_sizes`` walks the markers of each picture's head and decodes nothing.
``arrays`` reads an array file's header first, passes over files of another type
or shape, and reads the bytes of the wanted rows alone; a file larger than
``splitBytes`` is read in ranges of rows.

What is wanted is given as options, not as predicates of a query: Spark keeps
the reader of a loaded table for the next query over it.
"""

from __future__ import annotations

import ast
import math
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.sources import records
from tilewright.sources.records import FilePart, WholeFileReader, open_path, sizes_below


@dataclass
class Prefix:
    """Random reads of a file by small blocks; ``seen`` counts the bytes read."""

    file: object
    block: int = 512
    blocks: dict[int, bytes] = field(default_factory=dict)
    seen: int = 0

    def __getitem__(self, at: slice) -> bytes:
        out = b""
        for k in range(at.start // self.block, -(-at.stop // self.block)):
            if k not in self.blocks:
                self.blocks[k] = self.file.read_at(self.block, k * self.block)
                self.seen += len(self.blocks[k])
            out += self.blocks[k]
        skip = at.start % self.block
        return out[skip : skip + at.stop - at.start]


#: JPEG markers that begin a frame, and markers without a length.
_FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
_BARE = {0x01, *range(0xD0, 0xDA)}


def _jpeg(head: Prefix) -> tuple[int, int] | None:
    at = 2
    while len(two := head[at : at + 2]) == 2 and two[0] == 0xFF:
        marker = two[1]
        if marker == 0xFF:  # a filling byte
            at += 1
        elif marker in _BARE:
            at += 2
        else:
            more = head[at + 2 : at + 9]
            if len(more) < 2:
                return None
            if marker in _FRAMES:
                return struct.unpack_from(">HH", more, 3)[::-1] if len(more) == 7 else None
            at += 2 + struct.unpack_from(">H", more)[0]
    return None


def picture_size(head: Prefix) -> tuple[str, int, int] | None:
    """(format, width, height) of a JPEG, PNG, GIF or BMP file; None for others and broken ones."""
    first = head[0:32]
    if first[:2] == b"\xff\xd8":
        found = _jpeg(head)
        return found and ("jpeg", *found)
    if first[:8] == b"\x89PNG\r\n\x1a\n" and first[12:16] == b"IHDR" and len(first) >= 24:
        return "png", *struct.unpack_from(">II", first, 16)
    if first[:6] in (b"GIF87a", b"GIF89a") and len(first) >= 10:
        return "gif", *struct.unpack_from("<HH", first, 6)
    if first[:2] == b"BM" and len(first) >= 26:
        old = struct.unpack_from("<I", first, 14)[0] == 12
        w, h = struct.unpack_from("<HH" if old else "<ii", first, 18)
        return "bmp", w, abs(h)
    return None


class SizeReader(WholeFileReader):
    def records(self, partition: FilePart) -> Iterator[tuple]:
        with records._random_access(partition.path) as f:
            found = picture_size(Prefix(f)) or (None, None, None)
        yield os.path.relpath(open_path(partition.path)[1], open_path(self.path)[1]), *found


@dataclass
class ArrayHead:
    dtype: str
    shape: tuple[int, ...]
    fortran: bool
    offset: int

    @property
    def row_bytes(self) -> int:
        """Bytes of one step along the first axis."""
        return np.dtype(self.dtype).itemsize * math.prod(self.shape[1:])


def array_head(head: Prefix) -> ArrayHead:
    first = head[0:12]
    if first[:6] != b"\x93NUMPY" or len(first) < 12:
        raise ValueError("not an array file")
    wide = first[6] > 1
    size = struct.unpack_from("<I" if wide else "<H", first, 8)[0]
    start = 12 if wide else 10
    told = ast.literal_eval(head[start : start + size].decode("utf-8" if first[6] > 2 else "latin-1"))
    dtype = np.dtype(told["descr"])
    if dtype.hasobject or dtype.names:
        raise ValueError("an array of objects or records")
    return ArrayHead(dtype.str, tuple(told["shape"]), told["fortran_order"], start + size)


class ArrayFileReader(WholeFileReader):
    """Options: ``dtype`` as numpy writes it, ``shape`` as numbers and stars ("*,64"), ``rows`` as "from:to" along the first axis."""

    suffixes = (".npy",)
    SPLIT_BYTES = 128 << 20

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.dtype = np.dtype(options["dtype"]) if "dtype" in options else None
        self.shape = [None if x.strip() == "*" else int(x) for x in options["shape"].split(",")] if "shape" in options else None
        low, _, high = options.get("rows", ":").partition(":")
        self.low, self.high = int(low or 0), int(high) if high else None
        if self.low < 0 or (self.high or 0) < 0:
            raise ValueError("rows are counted from the start")
        self.step = int(options.get("splitbytes", options.get("splitBytes", self.SPLIT_BYTES)))

    def wanted(self, head: ArrayHead) -> bool:
        if self.dtype is not None and np.dtype(head.dtype) != self.dtype:
            return False
        return self.shape is None or (len(self.shape) == len(head.shape) and all(a is None or a == b for a, b in zip(self.shape, head.shape)))

    def parts(self) -> list[FilePart]:
        """Files, and ranges of rows of those that are larger than a split: of these alone the header is read here."""
        out = []
        for path, size in sizes_below(self.path, self.suffixes):
            if size <= self.step:
                out.append(FilePart(path, end=size))
                continue
            with records._random_access(path) as f:
                head = array_head(Prefix(f))
            if not self.wanted(head):
                continue
            if head.fortran and len(head.shape) > 1 or not head.shape:
                out.append(FilePart(path, end=size))
                continue
            each = max(1, self.step // max(1, head.row_bytes))
            # Numbers of rows stand in first and take; start and end are bytes, by which small parts are grouped.
            low, high = self.low, min(head.shape[0], head.shape[0] if self.high is None else self.high)
            out += [FilePart(path, start=0, end=each * head.row_bytes, first=a, take=min(each, high - a)) for a in range(low, high, each)]
        return out

    def read(self, partition) -> Iterator[tuple]:
        for part in partition.parts:
            if part.path:
                yield from self.records(part)

    def records(self, partition: FilePart) -> Iterator[tuple]:
        with records._random_access(partition.path) as f:
            head = array_head(Prefix(f))
            if self.wanted(head):
                whole = head.shape or (1,)
                low, high = (partition.first, partition.first + partition.take) if partition.take >= 0 else (self.low, whole[0] if self.high is None else min(whole[0], self.high))
                low, high = min(low, whole[0]), max(min(low, whole[0]), high)
                flat = head.fortran and len(whole) > 1
                at, size = (0, math.prod(whole)) if flat else (low, (high - low) * math.prod(whole[1:]))
                kind = np.dtype(head.dtype)
                data = f.read_at(size * kind.itemsize, head.offset + (0 if flat else at * head.row_bytes))
                if len(data) != size * kind.itemsize:
                    raise ValueError(f"{partition.path} is cut short")
                values = np.frombuffer(data, kind)
                if flat:  # rows are scattered over the file
                    values = values.reshape(whole, order="F")[low:high].ravel()
                shape = [high - low, *whole[1:]] if head.shape else []
                yield os.path.relpath(open_path(partition.path)[1], open_path(self.path)[1]), head.dtype, shape, low, values.astype(np.float64).tolist()


_SOURCES = {
    "image_sizes": ("path string, format string, width int, height int", SizeReader),
    "arrays": ("path string, dtype string, shape array<int>, start long, values array<double>", ArrayFileReader),
}


def _load(spark: SparkSession, label: str, path: str, options: dict) -> DataFrame:
    columns, kind = _SOURCES[label]
    spark.dataSource.register(records._source(label, columns, kind))
    return spark.read.format(label).options(**{k: str(v) for k, v in options.items() if v is not None}).load(path)


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, width, height) of every file below the path; null where the head tells no size."""
    return _load(spark, "image_sizes", path, {})


def largest(sizes: DataFrame) -> DataFrame:
    """(width, height): the largest of each, as buffers for all need them."""
    return sizes.agg(F.max("width").alias("width"), F.max("height").alias("height"))


def most_frequent(sizes: DataFrame) -> DataFrame:
    """(width, height, n) of the most frequent size; of equally frequent ones the larger."""
    n = sizes.where("width is not null").groupBy("width", "height").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), F.desc(F.col("width").cast("long") * F.col("height")), F.desc("width")).limit(1)


def arrays(spark: SparkSession, path: str, dtype: str | None = None, shape: str | None = None, rows: str | None = None, split_bytes: int | None = None) -> DataFrame:
    """(path, dtype, shape, start, values) of the array files of a type and shape; of ``rows`` "a:b" along the first axis only."""
    return _load(spark, "arrays", path, {"dtype": dtype, "shape": shape, "rows": rows, "splitBytes": split_bytes})
