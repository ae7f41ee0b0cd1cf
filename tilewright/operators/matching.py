"""Boxes against anchors: IoU, matching and encoding.

Anchors are a fixed grid given as a parameter, so they are broadcast; the
number is checked. A sample's boxes meet the anchors inside its own row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import boxes as B

#: Anchors are broadcast up to this number; detection models have some thousands.
MOST_ANCHORS = 1_000_000
Edges = tuple[float, float, float, float]


def anchor_table(spark, anchors: Sequence[Edges]) -> DataFrame:
    """(anchor_id, anchor) of (l, t, r, b) tuples."""
    if len(anchors) > MOST_ANCHORS:
        raise ValueError(f"more than {MOST_ANCHORS} anchors")
    rows = [(i, tuple(map(float, a))) for i, a in enumerate(anchors)]
    return spark.createDataFrame(rows, "anchor_id int, anchor struct<l:double,t:double,r:double,b:double>")


def pairs(samples: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """(key, box_id, box, label, anchor_id, anchor, iou) of every box and anchor of a sample.

    ``samples`` has ``boxes`` and ``labels``. Each box meets the whole grid:
    that is the definition of the operator, and linear in the boxes.
    """
    each = samples.select(key, F.posexplode(F.arrays_zip("boxes", "labels")).alias("box_id", "_b")).select(key, "box_id", F.col("_b.boxes").alias("box"), F.col("_b.labels").alias("label"))
    grid = F.broadcast(anchors.agg(F.collect_list(F.struct("anchor_id", "anchor")).alias("_grid")).withColumn("_one", F.lit(1)))
    joined = each.withColumn("_one", F.lit(1)).join(grid, "_one")
    return joined.select(key, "box_id", "box", "label", F.explode("_grid").alias("_a")).select(
        key, "box_id", "box", "label", F.col("_a.anchor_id").alias("anchor_id"), F.col("_a.anchor").alias("anchor"), B.iou(F.col("box"), F.col("_a.anchor")).alias("iou")
    )


def _iou_matrix(boxes: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Boxes by anchors."""
    low = np.maximum(boxes[:, None, :2], anchors[None, :, :2])
    high = np.minimum(boxes[:, None, 2:], anchors[None, :, 2:])
    inter = np.prod(np.clip(high - low, 0, None), axis=2)
    size = lambda x: np.prod(x[:, 2:] - x[:, :2], axis=1)
    return inter / (size(boxes)[:, None] + size(anchors)[None, :] - inter)


def _each(samples: DataFrame, anchors: Sequence[Edges], key: str, out: str, f: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.Array]) -> DataFrame:
    """(key, and what ``f`` makes of a sample's boxes, labels and anchors); the key is a long.

    A sample is matched inside its row, with arrays over the whole grid, so a
    data set of any size is matched without a shuffle.
    """
    if len(anchors) > MOST_ANCHORS:
        raise ValueError(f"more than {MOST_ANCHORS} anchors")
    grid = np.asarray(anchors, float).reshape(-1, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for flat, labels in zip(batch.column(1), batch.column(2)):
                boxes = np.asarray(flat.as_py() or [], float).reshape(-1, 4)
                found.append(f(boxes, np.asarray(labels.as_py() or [], np.int32), grid))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*found))] if found else [batch.column(0).slice(0, 0)], names=[key, *names])

    names = [c.split()[0] for c in out.split(", ")]
    flat = F.flatten(F.transform("boxes", lambda b: F.array(b["l"], b["t"], b["r"], b["b"])))
    rows = samples.select(F.col(key).cast("long").alias(key), flat.alias("boxes"), F.col("labels").cast("array<int>").alias("labels"))
    return rows.mapInArrow(run, f"`{key}` long, {out}")


def match(samples: DataFrame, anchors: Sequence[Edges], key: str, high: float, low: float, allow_low_quality: bool = True) -> DataFrame:
    """(key, matches): for each anchor the first best box, -1 below ``low``, -2 below ``high``.

    With ``allow_low_quality`` an anchor that is within 1e-6 of some box's best
    keeps its match whatever its IoU. A sample without boxes matches nothing.
    """

    def one(boxes: np.ndarray, labels: np.ndarray, grid: np.ndarray):
        if not len(boxes):
            return (np.full(len(grid), -1, np.int32),)
        iou = _iou_matrix(boxes, grid)
        best = iou.argmax(axis=0)  # the first of equals
        value = iou.max(axis=0)
        out = np.where(value < low, -1, np.where(value < high, -2, best))
        if allow_low_quality:
            near = (np.abs(iou - iou.max(axis=1, keepdims=True)) < 1e-6).any(axis=0)
            out = np.where(near, best, out)
        return (out.astype(np.int32),)

    return _each(samples, anchors, key, "matches array<int>", one)


def encode(samples: DataFrame, anchors: Sequence[Edges], key: str, criteria: float, means=(0.0, 0.0, 0.0, 0.0), stds=(1.0, 1.0, 1.0, 1.0), offset: bool = False, scale: float = 1.0) -> DataFrame:
    """(key, encoded_labels, encoded_boxes): a label and four coordinates, flat, for each anchor.

    The first best anchor of each box is forced to it; otherwise an anchor
    takes its last best box if the IoU exceeds ``criteria``. Matched anchors
    hold the box as centre and size, or as scaled offsets from the anchor;
    others hold label 0 and the anchor's centre and size, or zeros.
    """
    centred = lambda x: np.concatenate([(x[:, :2] + x[:, 2:]) / 2, x[:, 2:] - x[:, :2]], axis=1)

    def one(boxes: np.ndarray, labels: np.ndarray, grid: np.ndarray):
        own = centred(grid)
        values, names = np.zeros_like(own) if offset else own.copy(), np.zeros(len(grid), np.int32)
        if len(boxes):
            iou = _iou_matrix(boxes, grid)
            iou[np.arange(len(boxes)), iou.argmax(axis=1)] = 2.0
            best = len(boxes) - 1 - iou[::-1].argmax(axis=0)  # the last of equals
            hit = iou.max(axis=0) > criteria
            b = centred(boxes)[best]
            if offset:
                moved = np.concatenate([(b[:, :2] - own[:, :2]) * scale / (own[:, 2:] * scale), np.log(b[:, 2:] / own[:, 2:])], axis=1)
                b = (moved - np.asarray(means)) / np.asarray(stds)
            values[hit], names[hit] = b[hit], labels[best][hit]
        return names, values.ravel()

    return _each(samples, anchors, key, "encoded_labels array<int>, encoded_boxes array<double>", one)
