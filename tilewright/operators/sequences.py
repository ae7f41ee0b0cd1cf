"""Windows of frames over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequence_starts(counts: DataFrame, key: str, count: str, length: int, step: int, stride: int) -> DataFrame:
    """(key, sequence, start): windows of ``length`` frames, ``stride`` apart, one every ``step`` frames."""
    last = F.col(count) - (length - 1) * stride - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long")))
    return counts.select(key, F.posexplode(starts).alias("sequence", "start"))


def sequences(rows: DataFrame, key: str, order: list[str], length: int, step: int = 1, stride: int = 1) -> DataFrame:
    """(key, sequence, start, frame, and the row's columns): each window's frames as rows.

    A frame belongs to at most ceil(length / step) windows, which follow from
    its number alone, so rows are exploded and never joined with themselves.
    """
    group = Window.partitionBy(key)
    placed = rows.withColumns({"_n": F.row_number().over(group.orderBy(*order)) - 1, "_count": F.count("*").over(group)})
    offsets = F.array(*(F.struct(F.lit(i).alias("frame"), F.lit(i * stride).alias("at")) for i in range(length)))
    starts = F.transform(offsets, lambda o: F.struct((F.col("_n") - o["at"]).alias("start"), o["frame"].alias("frame")))
    ok = F.filter(starts, lambda s: (s["start"] >= 0) & (s["start"] % step == 0) & (s["start"] + (length - 1) * stride < F.col("_count")))
    return placed.select(*rows.columns, F.explode(ok).alias("_w")).select(
        *rows.columns, (F.col("_w.start") / step).cast("int").alias("sequence"), F.col("_w.start").alias("start"), F.col("_w.frame").alias("frame")
    )


def frame_times(start: Column, length: int, stride: int, fps: float) -> Column:
    """Time of each frame of a window, in seconds."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: (start + i * stride) / F.lit(float(fps)))


def frame_range(start: Column, end: Column, fps: Column, by_frame: bool) -> Column:
    """(first, last) frame of a labelled stretch; times round inwards. Null where it is empty or before 0."""
    a = start.cast("int") if by_frame else F.ceil(start * fps).cast("int")
    b = end.cast("int") if by_frame else F.floor(end * fps).cast("int")
    return F.when((a >= 0) & (a < b), F.struct(a.alias("first"), b.alias("last")))
