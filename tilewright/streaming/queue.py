"""A queue of fed samples as a streaming source with offsets.

A feeder puts lists of samples into a folder, each as a numbered segment that
appears at once, and marks the end of a feed by a row with ``last``. The source
``samples`` counts segments: an offset is the number of the next one, a batch is
the segments from one offset up to another, and a batch that wasn't committed
is read again from the same files. Segments are removed when their batch is
committed, but for the last, unless ``keep`` is set. One feeder at a time writes
to a folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tilewright.sources.records import open_path

SCHEMA = "feed string, sample long, name string, content binary, label int, roi_w int, roi_h int, last boolean"
_ARROW = pa.schema(
    [("feed", pa.string()), ("sample", pa.int64()), ("name", pa.string()), ("content", pa.binary()), ("label", pa.int32()), ("roi_w", pa.int32()), ("roi_h", pa.int32()), ("last", pa.bool_())]
)
_SUFFIX = ".segment"


def _segments(path: str) -> list[int]:
    """Numbers of the segments that are there."""
    system, base = open_path(path)
    if system.get_file_info(base).type != fs.FileType.Directory:
        return []
    return sorted(int(x.base_name.removesuffix(_SUFFIX)) for x in system.get_file_info(fs.FileSelector(base)) if x.base_name.endswith(_SUFFIX))


class Queue:
    """The feeder's side."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")
        system, base = open_path(self.path)
        system.create_dir(base, recursive=True)
        self.next = max(_segments(self.path), default=-1) + 1

    def put(self, samples: Iterable[dict]) -> int:
        """Appends a segment; ``samples`` have the fields of ``SCHEMA``, absent ones count as null. Returns its number."""
        system, base = open_path(self.path)
        rows = [{"last": False} | s for s in samples]
        early = f"{base}/_{uuid.uuid4().hex}"
        with system.open_output_stream(early, compression=None) as out, pa.ipc.new_file(out, _ARROW) as writer:
            writer.write_table(pa.Table.from_pylist(rows, _ARROW))
        system.move(early, f"{base}/{self.next:012d}{_SUFFIX}")
        self.next += 1
        return self.next - 1

    def end(self, feed: str) -> int:
        """Marks the end of a feed."""
        return self.put([{"feed": feed, "last": True}])


@dataclass
class Segment(InputPartition):
    path: str


class QueueReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.keep = str(options.get("keep", "false")).lower() == "true"

    def initialOffset(self) -> dict:
        return {"segment": 0}

    def latestOffset(self) -> dict:
        there = _segments(self.path)
        return {"segment": there[-1] + 1 if there else 0}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        wanted = range(start["segment"], end["segment"])
        found = [n for n in _segments(self.path) if n in wanted]
        if len(found) != len(wanted):
            raise ValueError(f"segments from {wanted[0]} to {wanted[-1]} of {self.path} are asked for, and some are gone")
        return [Segment(f"{self.path}/{n:012d}{_SUFFIX}") for n in found]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        system, path = open_path(partition.path)
        with system.open_input_file(path) as f, pa.ipc.open_file(f) as reader:
            for i in range(reader.num_record_batches):
                yield reader.get_batch(i)

    def commit(self, end: dict) -> None:
        if not self.keep:
            system, base = open_path(self.path)
            for n in _segments(self.path):
                # The last one stays, since numbers go on from it.
                if n < end["segment"] - 1:
                    system.delete_file(f"{base}/{n:012d}{_SUFFIX}")

    def stop(self) -> None:
        pass


class QueueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "samples"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> QueueReader:
        return QueueReader(self.options)


def stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The samples of a queue; with the option ``keep`` segments stay when they are committed."""
    spark.dataSource.register(QueueSource)
    return spark.readStream.format("samples").options(**options).load(path)
