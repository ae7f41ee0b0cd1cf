"""WARC archives as a PySpark Python data source.

``spark.read.format("warc")`` plans one partition for each archive file, or for
each stretch of ``splitBytes`` of one that this source wrote, pushes down
equality and membership predicates on ``warc_type`` and ``warc_record_id`` and
equality on ``target_uri`` and ``content_type``, reads a record's headers first
and decodes its payload only if the record passes and ``payload`` is asked for
(option ``payload``, true by default). A file is read through a moving window;
payloads that nobody wants are passed over and never held.

``df.write.format("warc")`` writes one record for each row to files of about
``maxFileBytes``. Each record is one gzip member, as the standard advises; its
``sl`` extra field gives the member's compressed size, so that a reader can
pass over a payload without inflating it. Files without that field are read
too. A task's files have names of their own and count only once the driver has
listed them in the manifest of that write, so retried and lost tasks leave
nothing that is read. An append adds a manifest and an overwrite replaces all;
a write removes
what its failed tasks left.

Paths: ``file:`` URIs and plain paths are opened directly, other schemes
through ``pyarrow.fs``. Defined results: a null payload is an empty one, a
null header value is left out; header values lose line breaks and may have any
length; rows that repeat an id give records that repeat it, and of equal
payloads that of least id is stored; very long texts are one record, of 2 GB
at most as any binary value; an empty table gives an archive without files,
which reads as no rows; clashing extra columns are not written. A folder with
manifests is read by them alone, one without by its file names.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tilewright.storage import written

SCHEMA = (
    "warc_type string, warc_record_id string, target_uri string, content_type string, payload_digest string, "
    "payload_bytes long, refers_to string, payload binary"
)
#: Column, header.
HEADERS = {
    "warc_type": "WARC-Type",
    "warc_record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
    "refers_to": "WARC-Refers-To",
}
PUSHED = {"warc_type", "warc_record_id", "target_uri", "content_type"}
MAX_FILE_BYTES = 64 << 20
#: Archives that this source wrote are read in stretches of about so many bytes.
SPLIT_BYTES = 64 << 20
MANIFEST = "manifest-"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 100
_HEAD = 2048
_CHUNK = 1 << 16
_END = b"\r\n\r\n"


def _open(path: str):
    """(file system, path in it)."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def record_bytes(headers: dict[str, str], payload: bytes) -> bytes:
    """One record as a gzip member with an ``sl`` field."""
    clean = lambda v: " ".join(str(v).splitlines())
    lines = ["WARC/1.1", *(f"{k}: {clean(v)}" for k, v in headers.items() if v is not None), f"Content-Length: {len(payload)}"]
    raw = ("\r\n".join(lines) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    # A member too large for the field tells no size, which readers allow for.
    extra = b"sl" + struct.pack("<HII", 8, size if size < 1 << 32 else 0, len(raw) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class Window:
    """Bytes of a file by offset, through one buffer that moves along with the reader."""

    def __init__(self, read_at, size: int, ahead: int = 1 << 18) -> None:
        self.read_at, self.size, self.ahead = read_at, size, ahead
        self.at, self.data = 0, b""

    def get(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at``, fewer at the end of the file."""
        n = min(n, self.size - at)
        if not self.at <= at <= at + n <= self.at + len(self.data):
            self.at, self.data = at, self.read_at(min(max(n, self.ahead), self.size - at), at)
        return self.data[at - self.at : at - self.at + n]


def _told(window: Window, at: int) -> int:
    """Compressed size of the gzip member at an offset, 0 if it isn't told."""
    head = window.get(at, 12)
    if head[:3] != b"\x1f\x8b\x08":
        raise ValueError(f"no gzip member at byte {at}")
    if len(head) == 12 and head[3] & 4:
        fields, field = window.get(at + 12, struct.unpack_from("<H", head, 10)[0]), 0
        while field + 4 <= len(fields):
            (length,) = struct.unpack_from("<H", fields, field + 2)
            if fields[field : field + 2] == b"sl" and length >= 4 and field + 8 <= len(fields):
                return struct.unpack_from("<I", fields, field + 4)[0]
            field += 4 + length
    return 0


@dataclass
class ArchivePartition(InputPartition):
    """Records that begin at ``start`` or later and before ``stop``, -1 being the end of the file."""

    path: str
    start: int = 0
    stop: int = -1


@dataclass
class Written(WriterCommitMessage):
    """(name, offsets of records where a stretch ends) of each file."""

    files: list


def _passes(headers: dict[str, str], tests: list[tuple[str, frozenset]]) -> bool:
    return all(headers.get(HEADERS[c]) in values for c, values in tests)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in PUSHED:
                self.tests.append((name, frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, base = _open(self.path)
        if system.get_file_info(base).type == fs.FileType.File:
            return [ArchivePartition(self.path)]
        listed = _manifests(system, base)
        if listed:
            files = [tuple(x) for path in listed for x in _listed(system, path)]
        else:
            files = [(os.path.basename(x.path), []) for x in system.get_file_info(fs.FileSelector(base)) if x.path.endswith((".warc", ".warc.gz"))]
        return [
            ArchivePartition(f"{self.path.rstrip('/')}/{name}", start, stop)
            for name, cuts in sorted(files)
            for start, stop in zip([0, *cuts], [*cuts, -1])
        ]

    def read(self, partition: ArchivePartition | None) -> Iterator[tuple]:
        if partition is None or not partition.path:
            return
        system, path = _open(partition.path)
        with system.open_input_file(path) as f:
            window = Window(f.read_at, f.size())
            for headers, payload in records(window, path.endswith(".gz"), self.tests, self.payload, partition.start, partition.stop):
                get = lambda c: headers.get(HEADERS[c])
                digest = get("payload_digest")
                length = get("payload_bytes") or headers["Content-Length"]
                yield (
                    get("warc_type"), get("warc_record_id"), get("target_uri"), get("content_type"),
                    digest and digest.removeprefix("sha256:"), int(length), get("refers_to"), payload,
                )


def _manifests(system, base: str) -> list[str]:
    """Paths of the manifests of all writes."""
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(x.path for x in found if os.path.basename(x.path).startswith(MANIFEST) and x.path.endswith(".json"))


def _listed(system, path: str) -> list:
    with system.open_input_stream(path) as f:
        return json.loads(f.read())


def _remove(system, paths: list[str]) -> None:
    for path in paths:
        if system.get_file_info(path).type == fs.FileType.File:
            system.delete_file(path)


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(line.split(": ", 1) for line in lines[1:] if ": " in line)


def records(data: Window | memoryview, packed: bool, tests: list[tuple[str, frozenset]], want: bool, start: int = 0, stop: int = -1) -> Iterator[tuple[dict, bytes | None]]:
    """Headers and payloads (None if not wanted) of the records that pass; other payloads are passed over."""
    window = data if isinstance(data, Window) else Window(lambda n, at: bytes(data[at : at + n]), len(data))
    at, stop = start, window.size if stop < 0 else stop
    one = _packed if packed else _plain
    while at < stop:
        at, headers, payload = one(window, at, tests, want)
        if headers is not None:
            yield headers, payload


def _plain(window: Window, at: int, tests, want: bool) -> tuple[int, dict | None, bytes | None]:
    """(offset of the next record, headers or None, payload or None) of an uncompressed record."""
    n = _HEAD
    while (end := (head := window.get(at, n)).find(_END)) < 0:
        if at + n >= window.size:
            raise ValueError("a record is cut short")
        n *= 2
    headers = _headers(head[:end])
    begin, size = at + end + 4, int(headers["Content-Length"])
    after = begin + size + 4
    if begin + size > window.size:
        raise ValueError("a record is cut short")
    if not _passes(headers, tests):
        return after, None, None
    return after, headers, window.get(begin, size) if want else None


def _packed(window: Window, at: int, tests, want: bool) -> tuple[int, dict | None, bytes | None]:
    """As ``_plain``, of a record that is a gzip member."""
    told = _told(window, at)
    unpack = zlib.decompressobj(31)
    fed, raw, seen = at, bytearray(), 0
    while (end := raw.find(_END, max(0, seen - 3))) < 0:
        seen = len(raw)
        chunk = window.get(fed, _HEAD) if fed < window.size else b""
        if not chunk or unpack.eof:
            raise ValueError("a record is cut short")
        raw += unpack.decompress(chunk)
        fed += len(chunk)
    headers = _headers(bytes(raw[:end]))
    wanted = _passes(headers, tests)
    held = wanted and want
    parts = [bytes(raw[end + 4 :])]
    if held or not told:
        while not unpack.eof:
            chunk = window.get(fed, _CHUNK) if fed < window.size else b""
            if not chunk:
                raise ValueError("a record is cut short")
            inflated = unpack.decompress(chunk)
            fed += len(chunk)
            if held:
                parts.append(inflated)
    after = at + told if told else fed - len(unpack.unused_data)
    if not held:
        return after, headers if wanted else None, None
    size = int(headers["Content-Length"])
    payload = b"".join(parts)[:size]
    if len(payload) < size:
        raise ValueError("a record is cut short")
    return after, headers, payload


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        option = lambda name, default: int(options.get(name, options.get(name.lower(), default)))
        self.limit, self.split = option("maxFileBytes", MAX_FILE_BYTES), option("splitBytes", SPLIT_BYTES)
        self.columns = [f.name for f in schema.fields]
        self.name = uuid.uuid4().hex  # of this write; its files begin with it

    def write(self, iterator) -> Written:
        system, base = _open(self.path)
        system.create_dir(base, recursive=True)
        files: list[tuple[str, list[int]]] = []
        out, size = None, 0
        for row in iterator:
            data = self._record(row)
            if out is None or size >= self.limit:
                if out is not None:
                    out.close()
                files.append((f"{self.name}-{uuid.uuid4().hex}.warc.gz", []))
                out, size = system.open_output_stream(f"{base}/{files[-1][0]}", compression=None), 0
            cuts = files[-1][1]
            if size - (cuts[-1] if cuts else 0) >= self.split:
                cuts.append(size)
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def _record(self, row) -> bytes:
        r = {c: row[i] for i, c in enumerate(self.columns)}
        payload = r.get("payload")
        payload = b"" if payload is None else payload.encode() if isinstance(payload, str) else bytes(payload)
        headers = {h: r.get(c) for c, h in HEADERS.items()}
        if r.get("payload_digest"):
            headers["WARC-Payload-Digest"] = f"sha256:{r['payload_digest']}"
        if r.get("warc_type") == "revisit":
            headers["WARC-Profile"], payload = PROFILE, b""
        return record_bytes(headers, payload)

    def commit(self, messages) -> None:
        system, base = _open(self.path)
        system.create_dir(base, recursive=True)
        before = _manifests(system, base) if self.overwrite else []
        files = sorted(x for m in messages if m is not None for x in m.files)
        path = f"{base}/{MANIFEST}{uuid.uuid4().hex}.json"
        with system.open_output_stream(f"{path}.tmp") as f:
            f.write(json.dumps(files).encode())
        system.move(f"{path}.tmp", path)
        gone = [f"{base}/{name}" for manifest in before for name, _ in _listed(system, manifest)]
        _remove(system, [*before, *gone])
        self._clean({name for name, _ in files})

    def abort(self, messages) -> None:
        self._clean(set())

    def _clean(self, kept: set[str]) -> None:
        """Removes what tasks of this write left that failed, were lost or ran twice."""
        system, base = _open(self.path)
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        _remove(system, [x.path for x in found if (name := os.path.basename(x.path)).startswith(f"{self.name}-") and name not in kept])


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema, overwrite)


def register(spark) -> None:
    """Makes the format known to a session, and lets Python sources of that session see predicates, which Spark withholds by default."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def as_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Records of pages: of equal payloads of ``REVISIT_BYTES`` or more that of least id is the response, the others revisit it.

    Only digests shared by several pages are joined back, one row each. They are
    written first, so that the join has exchanges of its own and the rows of a
    hot digest can be split.
    """
    p = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    shared = written(
        p.where(F.length("payload") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", "first"),
        "shared",
    )
    revisit = (F.col("first").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.join(shared, "digest", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">")).alias("warc_record_id"),
        F.col("url").alias("target_uri"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.col("digest").alias("payload_digest"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_of(uri):
    """The page id inside a record id."""
    return F.regexp_extract(uri, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
