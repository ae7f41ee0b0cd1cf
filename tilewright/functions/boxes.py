"""Bounding-box operators as Column functions.

Boxes are ``array<struct<l,t,r,b:double>>`` with labels in a parallel array.
Operators that can lose boxes return both, and put one dummy box with label 0
where none is left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KEEP_SHARE = 0.25


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def box(l, t, r, b) -> Column:
    return F.struct(_num(l).alias("l"), _num(t).alias("t"), _num(r).alias("r"), _num(b).alias("b"))


def area(a: Column) -> Column:
    return (a["r"] - a["l"]) * (a["b"] - a["t"])


def overlap(a: Column, b: Column) -> Column:
    """Area of the intersection, 0 if there is none."""
    w = F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"])
    h = F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    inter = overlap(a, b)
    return inter / (area(a) + area(b) - inter)


def share_inside(a: Column, window: Column) -> Column:
    """The part of a that lies in the window: intersection over the area of a, not over the union."""
    return overlap(a, window) / area(a)


def clip(a: Column, window: Column) -> Column:
    return box(
        F.greatest(a["l"], window["l"]), F.greatest(a["t"], window["t"]), F.least(a["r"], window["r"]), F.least(a["b"], window["b"])
    )


def shift(a: Column, dx, dy) -> Column:
    return box(a["l"] - dx, a["t"] - dy, a["r"] - dx, a["b"] - dy)


def rescale(a: Column, fx, fy) -> Column:
    return box(a["l"] * fx, a["t"] * fy, a["r"] * fx, a["b"] * fy)


def resize(boxes: Column, src_w, src_h, dst_w, dst_h) -> Column:
    fx, fy = _num(dst_w) / _num(src_w), _num(dst_h) / _num(src_h)
    return F.transform(boxes, lambda a: rescale(a, fx, fy))


def mirror(a: Column, width, off: float = 0.0) -> Column:
    """Left-right in a width; fused resize-mirror works with an offset of one pixel, plain flips with none."""
    w = _num(width)
    return box(w - a["r"] - off, a["t"], w - a["l"] - off, a["b"])


def flip(boxes: Column, width, height, horizontal=1, vertical=0) -> Column:
    h, v = (x if isinstance(x, Column) else F.lit(x) for x in (horizontal, vertical))
    across = F.when(h == 1, F.transform(boxes, lambda a: mirror(a, width))).otherwise(boxes)
    down = F.transform(across, lambda a: box(a["l"], _num(height) - a["b"], a["r"], _num(height) - a["t"]))
    return F.when(v == 1, down).otherwise(across)


def _zip(boxes: Column, labels: Column) -> Column:
    return F.zip_with(boxes, labels, lambda b, c: F.struct(b.alias("0"), c.alias("1")))


def _keep(boxes: Column, labels: Column, test, change, dummy: Column) -> Column:
    pairs = F.filter(_zip(boxes, labels), lambda p: test(p["0"]))
    some = F.size(pairs) > 0
    return F.struct(
        F.when(some, F.transform(pairs, lambda p: change(p["0"]))).otherwise(F.array(dummy)).alias("boxes"),
        F.when(some, F.transform(pairs, lambda p: p["1"])).otherwise(F.array(F.lit(0))).alias("labels"),
    )


def crop(boxes: Column, labels: Column, x, y, w, h, flag=0, out_w=None, out_h=None) -> Column:
    """Boxes with a quarter or more inside the window, clipped and moved; mirrored where flag is 1.

    With an output size they are scaled from the window to it, as crop-resize
    does. None left: one box of the output's size with label 0.
    """
    x, y, w, h = map(_num, (x, y, w, h))
    ow, oh = (w if out_w is None else _num(out_w)), (h if out_h is None else _num(out_h))
    window = box(x, y, x + w, y + h)
    on = flag if isinstance(flag, Column) else F.lit(flag)

    def change(a: Column) -> Column:
        moved = shift(clip(a, window), x, y)
        turned = F.when(on == 1, mirror(moved, w)).otherwise(moved)
        return rescale(turned, ow / w, oh / h)

    return _keep(boxes, labels, lambda a: share_inside(a, window) >= KEEP_SHARE, change, box(0, 0, ow, oh))


def resize_mirror(boxes: Column, src_w, src_h, dst_w, dst_h, flag=0) -> Column:
    """The fused resize-mirror: mirrored coordinates are one pixel less than a flip's."""
    on = flag if isinstance(flag, Column) else F.lit(flag)
    sized = resize(boxes, src_w, src_h, dst_w, dst_h)
    return F.when(on == 1, F.transform(sized, lambda a: mirror(a, dst_w, 1.0))).otherwise(sized)


def resize_mirror_masks(masks: Column, src_w, src_h, dst_w, dst_h, flag=0) -> Column:
    """Polygons of (x, y, x, y, ...) by object under the fused resize-mirror; mirrored places are one pixel less, as those of boxes."""
    on = flag if isinstance(flag, Column) else F.lit(flag)
    fx, fy = _num(dst_w) / _num(src_w), _num(dst_h) / _num(src_h)
    place = lambda z, i: F.when(i % 2 == 1, z * fy).when(on == 1, _num(dst_w) - z * fx - 1.0).otherwise(z * fx)
    return F.transform(masks, lambda polygons: F.transform(polygons, lambda p: F.transform(p, place)))


def rotate(boxes: Column, labels: Column, w, h, dst_w, dst_h, degrees) -> Column:
    """The axis-aligned hull of each box turned about the image's centre, clipped to the output; a quarter must stay."""
    w, h, dw, dh, angle = map(_num, (w, h, dst_w, dst_h, degrees))
    rad = -angle * (math.pi / 180.0)
    cos, sin = F.cos(rad), F.sin(rad)
    px = lambda x, y: cos * (x - w / 2) + sin * (y - h / 2) + dw / 2
    py = lambda x, y: -sin * (x - w / 2) + cos * (y - h / 2) + dh / 2

    def hull(a: Column) -> Column:
        corners = [(a[i], a[j]) for i in ("l", "r") for j in ("t", "b")]
        xs, ys = [px(*c) for c in corners], [py(*c) for c in corners]
        return box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))

    window = box(0, 0, dw, dh)
    return _keep(F.transform(boxes, hull), labels, lambda a: share_inside(a, window) >= KEEP_SHARE, lambda a: clip(a, window), box(0, 0, dw, dh))


def centre_inside(a: Column, window: Column, strict: bool = True) -> Column:
    x, y = (a["l"] + a["r"]) / 2, (a["t"] + a["b"]) / 2
    if strict:
        return (x > window["l"]) & (x < window["r"]) & (y > window["t"]) & (y < window["b"])
    return (x >= window["l"]) & (x <= window["r"]) & (y >= window["t"]) & (y <= window["b"])


def centre_crop_update(boxes: Column, labels: Column, window: Column) -> Column:
    """Boxes whose centre lies strictly inside a window, clipped and moved; none left: a zero box with label 0."""
    return _keep(boxes, labels, lambda a: centre_inside(a, window), lambda a: shift(clip(a, window), window["l"], window["t"]), box(0, 0, 0, 0))


def ssd_crop_update(boxes: Column, labels: Column, window: Column, low: float, high: float) -> Column:
    """Boxes whose centre lies in the window and whose IoU with it is in [low, high], in coordinates relative to the window."""
    w, h = window["r"] - window["l"], window["b"] - window["t"]
    test = lambda a: centre_inside(a, window, strict=False) & iou(a, window).between(low, high)
    return _keep(boxes, labels, test, lambda a: rescale(shift(clip(a, window), window["l"], window["t"]), 1 / w, 1 / h), box(0, 0, 1, 1))
