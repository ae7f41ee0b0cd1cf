"""Random crop windows by rejection sampling, without leaving the JVM.

All attempts of a sample are drawn as one array of candidate windows, pure
functions of (seed, sample, attempt); the first that passes is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import boxes as B
from tilewright.functions import rng


def _first(candidates: Column, ok, otherwise: Column) -> Column:
    return F.coalesce(F.get(F.filter(candidates, ok), F.lit(0)), otherwise)


def random_window(key: Column, width: int, height: int, seed: int, area=(0.08, 0.99), aspect=(0.75, 1.333), attempts: int = 20) -> Column:
    """struct(x, y, w, h): the first window of random area and aspect that fits, else a centred one of clamped aspect."""

    def draw(i: Column) -> Column:
        u = lambda n: rng.uniform(seed, f"crop{n}", key, 0, i)
        target = rng.uniform_range(u("area"), *area) * (width * height)
        ratio = rng.uniform_range(u("aspect"), *aspect)
        w, h = F.floor(F.sqrt(target * ratio)).cast("int"), F.floor(F.sqrt(target / ratio)).cast("int")
        return F.struct(
            F.floor(u("x") * (width - w)).cast("int").alias("x"), F.floor(u("y") * (height - h)).cast("int").alias("y"), w.alias("w"), h.alias("h")
        )

    ratio = min(max(width / height, aspect[0]), aspect[1])
    cw, ch = (width, int(width / ratio)) if width / height < ratio else (int(height * ratio), height)
    cw, ch = min(cw, width), min(ch, height)
    centre = F.struct(*(F.lit(v).alias(n) for n, v in (("x", (width - cw) // 2), ("y", (height - ch) // 2), ("w", cw), ("h", ch))))
    tries = F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), draw)
    return _first(tries, lambda c: (c["w"] < width) & (c["h"] < height) & (c["w"] > 0) & (c["h"] > 0), centre)


def random_windows(df: DataFrame, key: str, width: int, height: int, seed: int, area=(0.08, 0.99), aspect=(0.75, 1.333), attempts: int = 20) -> DataFrame:
    """(key, x, y, w, h): a ``random_window`` of each sample."""
    return df.select(key, random_window(F.col(key), width, height, seed, area, aspect, attempts).alias("c")).select(key, "c.*")


def bbox_crop_windows(df: DataFrame, key: str, width: float, height: float, seed: int, scale=(0.3, 1.0), aspect=(0.5, 2.0), thresholds=(0.1, 0.3, 0.5, 0.7, 0.9), all_boxes: bool = False, attempts: int = 20) -> DataFrame:
    """(key, l, t, r, b): a window by a randomly chosen option: the whole image, any window, or one with a least IoU with the boxes.

    A window needs a box's centre strictly inside. ``all_boxes`` asks the least
    IoU of all boxes, else of one. Without success the whole image is taken.
    """
    whole = B.box(0, 0, width, height)
    option = rng.uniform_int(rng.uniform(seed, "option", F.col(key)), 0, len(thresholds) + 1)
    least = F.when(option == len(thresholds), F.lit(-1.0)).otherwise(F.get(F.array(*(F.lit(float(x)) for x in thresholds)), option))

    def draw(i: Column) -> Column:
        u = lambda n: rng.uniform(seed, f"box{n}", F.col(key), 0, i)
        w, h = rng.uniform_range(u("w"), *scale) * width, rng.uniform_range(u("h"), *scale) * height
        x, y = u("x") * (width - w), u("y") * (height - h)
        return B.box(x, y, x + w, y + h)

    def ok(c: Column) -> Column:
        ratio = (c["r"] - c["l"]) / (c["b"] - c["t"]) * (height / width)
        enough = lambda a: B.iou(a, c) >= least
        overlap = F.forall("boxes", enough) if all_boxes else F.exists("boxes", enough)
        return ratio.between(*aspect) & overlap & F.exists("boxes", lambda a: B.centre_inside(a, c))

    tries = F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), draw)
    window = F.when(option > len(thresholds), whole).otherwise(_first(tries, ok, whole))
    return df.select(key, window.alias("c")).select(key, "c.*")


def ssd_crops(df: DataFrame, key: str, width: float, height: float, seed: int, scale=(0.3, 1.0), aspect=(0.5, 2.0), lows=(0.0, 0.1, 0.3, 0.5, 0.7, 0.9), attempts: int = 20) -> DataFrame:
    """(key, window, boxes, labels): a window by a randomly chosen option, and the boxes that it keeps, relative to it.

    An option is the whole image or a least IoU. A window passes if a box has
    its centre inside and at least that IoU with it; up to ``attempts`` are
    tried, then the whole image is taken with all boxes (convention).
    """
    whole = B.box(0, 0, width, height)
    option = rng.uniform_int(rng.uniform(seed, "ssd option", F.col(key)), 0, len(lows))
    low = F.coalesce(F.get(F.array(*(F.lit(float(x)) for x in lows)), option), F.lit(0.0))

    def draw(i: Column) -> Column:
        u = lambda n: rng.uniform(seed, f"ssd {n}", F.col(key), 0, i)
        w, h = rng.uniform_range(u("w"), *scale) * width, rng.uniform_range(u("h"), *scale) * height
        x, y = u("x") * (width - w), u("y") * (height - h)
        return B.box(x, y, x + w, y + h)

    def ok(c: Column) -> Column:
        ratio = (c["r"] - c["l"]) / (c["b"] - c["t"]) * (height / width)
        return ratio.between(*aspect) & F.exists("boxes", lambda a: B.centre_inside(a, c, strict=False) & (B.iou(a, c) >= F.col("_low")))

    tries = F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), draw)
    chosen = df.withColumns({"_low": low, "_option": option}).withColumn("_found", F.when(F.col("_option") < len(lows), _first(tries, ok, F.lit(None).cast("struct<l:double,t:double,r:double,b:double>"))))
    window, least = F.coalesce("_found", whole), F.when(F.col("_found").isNull(), F.lit(0.0)).otherwise(F.col("_low"))
    placed = chosen.select(key, "boxes", "labels", window.alias("window"), least.alias("_least"))
    kept = B.ssd_crop_update(F.col("boxes"), F.col("labels"), F.col("window"), F.col("_least"), F.lit(1.0))
    return placed.select(key, "window", kept.alias("o")).select(key, "window", "o.boxes", "o.labels")
