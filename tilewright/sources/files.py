"""Sources of one sample per file, or of fixed-size records, over ``binaryFile``."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tilewright.operators.labels import basename, folder_labels

#: File name extensions taken for images.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "ppm", "bmp", "pgm", "tif", "tiff", "webp")
CIFAR_RECORD = 3073


def _binary(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """Files below ``path`` by extension in either case; the listing is pruned before any content is read."""
    either = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e)
    glob = "*.{" + ",".join(map(either, extensions)) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def image_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """(path, name, folder, label, content): the class is the folder's ordinal."""
    files = _binary(spark, path, extensions).select("path", basename(F.col("path")).alias("name"), F.element_at(F.split("path", "/"), -2).alias("folder"), "content")
    return folder_labels(files, "folder").select("path", "name", "folder", F.col("label").cast("int").alias("label"), "content")


def decoded_images(spark: SparkSession, path: str, keep_failed: bool = False) -> DataFrame:
    """(path, height, width, channels, values): pixels decoded by Spark's image source, BGR turned to RGB.

    Undecodable files are left out, or with ``keep_failed`` have null values, so
    that ``batches.replace_failed`` can find stand-ins for them.
    """
    images = spark.read.format("image").option("dropInvalid", str(not keep_failed).lower()).option("recursiveFileLookup", "true").load(path).select("image.*")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            values = [
                None if h < 0 else np.frombuffer(d, np.uint8).reshape(h, w, c)[..., [*reversed(range(min(c, 3))), *range(3, c)]].astype(np.float64).ravel()
                for d, h, w, c in zip(f["data"], f["height"], f["width"], f["nChannels"])
            ]
            yield pd.DataFrame({"path": f["origin"], "height": f["height"], "width": f["width"], "channels": f["nChannels"], "values": values})

    return images.mapInPandas(run, "path string, height int, width int, channels int, values array<double>")


def frame_sequences(spark: SparkSession, path: str, length: int, step: int = 1, stride: int = 1) -> DataFrame:
    """(folder, sequence, start, frame, path): windows over the sorted frames of each folder. Only names are read."""
    from tilewright.operators.sequences import sequences

    frames = _binary(spark, path, IMAGE_EXTENSIONS).select("path", F.element_at(F.split("path", "/"), -2).alias("folder"))
    return sequences(frames, "folder", ["path"], length, step, stride).select("folder", "sequence", "start", "frame", "path")


def parse_npy(data: bytes) -> tuple[str, list[int], np.ndarray]:
    """(dtype, shape, values in C order) of a version 1 array file; big-endian data are refused."""
    if data[:6] != b"\x93NUMPY" or data[6] != 1:
        raise ValueError("not a version 1 array file")
    (n,) = struct.unpack_from("<H", data, 8)
    head = ast.literal_eval(data[10 : 10 + n].decode("latin-1"))
    if head["descr"].startswith(">"):
        raise ValueError("big-endian arrays are not read")
    values = np.frombuffer(data, np.dtype(head["descr"]), offset=10 + n)
    shaped = values.reshape(head["shape"], order="F" if head["fortran_order"] else "C")
    return head["descr"], list(shaped.shape), shaped.ravel(order="C")


@F.pandas_udf(ArrayType(IntegerType()))
def raw_values(content: pd.Series) -> pd.Series:
    """8-bit values of raw samples."""
    return pd.Series([None if c is None else np.frombuffer(c, np.uint8).astype(np.int32) for c in content], dtype=object)


def npy_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, dtype, shape, values)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [parse_npy(c) for c in f["content"]]
            yield pd.DataFrame({"name": f["name"], "dtype": [r[0] for r in rows], "shape": [r[1] for r in rows], "values": [r[2].astype(np.float64) for r in rows]})

    files = _binary(spark, path, ("npy",)).select(basename(F.col("path")).alias("name"), "content")
    return files.mapInPandas(run, "name string, dtype string, shape array<int>, values array<double>")


def parse_wav(data: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, channels, samples in [-1, 1), frame by frame) of a PCM or float file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
            code = struct.unpack_from("<H", body, 24)[0] if form[0] == 0xFFFE else form[0]
        elif kind == b"data":
            _, channels, rate, _, _, bits = form
            whole = body[: len(body) // (bits // 8) * (bits // 8)]
            if code == 3:
                x = np.frombuffer(whole, np.dtype(f"<f{bits // 8}")).astype(np.float64)
            elif bits == 8:
                x = (np.frombuffer(whole, np.uint8).astype(np.float64) - 128) / 128
            elif bits == 24:
                b = np.frombuffer(whole, np.uint8).reshape(-1, 3).astype(np.int32)
                x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
            else:
                x = np.frombuffer(whole, np.dtype(f"<i{bits // 8}")) / float(1 << bits - 1)
            return rate, channels, x
        at += 8 + size + size % 2
    raise ValueError("no samples")


def wav_files(spark: SparkSession, path: str, downmix: bool = False) -> DataFrame:
    """(name, sample_rate, channels, samples): frames interleaved, or averaged over channels with ``downmix``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [parse_wav(c) for c in f["content"]]
            mixed = [(r, 1, x.reshape(-1, c).mean(axis=1)) if downmix else (r, c, x) for r, c, x in rows]
            yield pd.DataFrame({"name": f["name"], "sample_rate": [float(m[0]) for m in mixed], "channels": [m[1] for m in mixed], "samples": [m[2] for m in mixed]})

    files = _binary(spark, path, ("wav",)).select(basename(F.col("path")).alias("name"), "content")
    return files.mapInPandas(run, "name string, sample_rate float, channels int, samples array<double>")


def cifar_files(spark: SparkSession, path: str, prefix: str = "data_batch_") -> DataFrame:
    """(name, label, values): fixed records of a label byte and three planes of 1024 bytes, cut by built-in functions."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*").load(path).select(basename(F.col("path")).alias("file"), "content")
    count = F.floor(F.length("content") / CIFAR_RECORD).cast("int")
    numbered = files.select("file", "content", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))).alias("i"))
    record = lambda offset, n: F.substring(F.col("content"), F.col("i") * CIFAR_RECORD + offset, F.lit(n))
    return numbered.select(
        F.concat_ws("_", "file", F.col("i").cast("string")).alias("name"), F.conv(F.hex(record(1, 1)), 16, 10).cast("int").alias("label"), record(2, CIFAR_RECORD - 1).alias("values")
    )


def label_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, label) of text files of ``name label`` lines; of equal names the first file's, then the first line's counts.

    A file is read whole, since its lines' order can't be told across splits.
    """
    from tilewright.operators.labels import parse_label_lines

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "value"))
    return parse_label_lines(whole.select("value", F.struct("file", "at").alias("place")), "value", "place").select("name", "label")


def video_list(spark: SparkSession, path: str, fps: DataFrame, by_frame: bool = True) -> DataFrame:
    """(file, label, first, last) of ``file label [start end]`` lines; ``fps`` has file, fps and frames. Stretches that are empty or too long go."""
    from tilewright.operators.sequences import frame_range

    parts = F.split(F.trim("value"), r"\s+")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    lines = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("file"), number(1).cast("int").alias("label"), number(2).alias("start"), number(3).alias("end"))
    r = F.when(F.col("start").isNull(), F.struct(F.lit(0).alias("first"), F.col("frames").cast("int").alias("last"))).otherwise(frame_range(F.col("start"), F.col("end"), F.col("fps"), by_frame))
    return lines.where("label is not null").join(fps, "file").select("file", "label", r.alias("r"), "frames").where("r is not null and r.last <= frames").select("file", "label", "r.first", "r.last")
