"""Effects as Columns: geometry by index and weight, hue and saturation, and effects with draws.

Each pixel's draw is a pure function of seed, sample and place. Formulas are
conventions. Everything stays in the JVM: no effect needs a Python worker.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions import rng
from tilewright.functions.tensor import _at, _index, _place, crop, flip, let, resize_bilinear


def _draws(name: str, key: Column, n: int, seed: int) -> Column:
    """One uniform for each of n places."""
    return F.transform(_index(n), lambda i: rng.uniform(seed, name, key, 0, i))


def salt_and_pepper(v: Column, h: int, w: int, key: Column, probability: float, salt: float = 0.5, salt_value: float = 255.0, pepper_value: float = 0.0, c: int = 1, seed: int = 0) -> Column:
    """Pixels hit with ``probability``; a share ``salt`` of those turns to the salt value, the others to the pepper value."""
    pick = lambda x, u: F.when(u < probability * salt, F.lit(salt_value)).when(u < probability, F.lit(pepper_value)).otherwise(x)
    return let(_draws("salt", key, h * w, seed), lambda u: F.transform(v, lambda x, i: pick(x, _at(u, F.floor(i / c)))))


def snow(v: Column, h: int, w: int, key: Column, amount: float, c: int = 1, seed: int = 0) -> Column:
    """Brightens what is already bright, values above 1 - amount of the range, and lets flakes fall on a tenth of ``amount``."""
    lit = lambda x: F.when(x >= 255 * (1 - amount), F.least(F.lit(255.0), x * (1 + amount))).otherwise(x)
    fall = lambda x, u: F.when(u < amount * 0.1, F.lit(255.0)).otherwise(lit(x))
    return let(_draws("snow", key, h * w, seed), lambda u: F.transform(v, lambda x, i: fall(x, _at(u, F.floor(i / c)))))


def jitter(v: Column, h: int, w: int, key: Column, kernel: int = 3, c: int = 1, seed: int = 0) -> Column:
    """Every pixel from a random one within half the kernel's side, edges repeated."""
    reach = kernel // 2
    held = lambda x, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), x))
    move = lambda u, p: F.floor(_at(u, p) * (2 * reach + 1)) - reach

    def one(down: Column, across: Column, i: Column) -> Column:
        row, col, ch = _place(i, w, c)
        p = row * w + col
        return _at(v, (held(row + move(down, p), h) * w + held(col + move(across, p), w)) * c + ch)

    return let(_draws("jitter y", key, h * w, seed), lambda a: let(_draws("jitter x", key, h * w, seed), lambda b: F.transform(_index(h * w * c), lambda i: one(a, b, i))))


def rain(v: Column, h: int, w: int, key: Column, share: float, length: int = 5, slant: int = 0, transparency: float = 0.5, value: float = 200.0, c: int = 1, seed: int = 0) -> Column:
    """Streaks of ``length`` pixels mixed in; each pixel begins one with the probability share / length."""

    def wet(u: Column, i: Column) -> Column:
        row, col, _ = _place(i, w, c)

        def from_above(k: Column) -> Column:
            y, x = row - k, col - k * slant
            return (y >= 0) & (x >= 0) & (x < w) & (_at(u, y * w + x) < share / length)

        return F.exists(F.sequence(F.lit(0), F.lit(length - 1)), from_above)

    mixed = lambda x: x * (1 - transparency) + value * transparency
    return let(_draws("rain", key, h * w, seed), lambda u: F.transform(v, lambda x, i: F.when(wet(u, i), mixed(x)).otherwise(x)))


def random_crop_resize(v: Column, h: int, w: int, oh: int, ow: int, key: Column, area=(0.08, 0.99), aspect=(0.75, 1.333), attempts: int = 20, c: int = 1, seed: int = 0) -> Column:
    """A window of random area and aspect, as ``random_crops.random_window`` draws it, resized."""
    from tilewright.operators.random_crops import random_window

    return let(
        random_window(key, w, h, seed, area, aspect, attempts),
        lambda r: let(crop(v, w, r["y"], r["x"], r["h"], r["w"], c), lambda x: resize_bilinear(x, r["h"], r["w"], oh, ow, c)),
    )


# --- geometry: each pixel from a real place of the image ---


def gathered(v: Column, h: int, w: int, source: Callable[[Column, Column], tuple[Column, Column, Column | None]], fill: float = 0.0, c: int = 1) -> Column:
    """Bilinear values at the places that ``source`` gives for a row and a column: (y, x, whether it counts); ``fill`` outside the image."""
    held = lambda x, n: F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), x))

    def inside(y: Column, x: Column, counts: Column | None) -> Column:
        hit = (y >= -0.5) & (y <= h - 0.5) & (x >= -0.5) & (x <= w - 0.5)
        return hit if counts is None else hit & counts

    def mixed(q: Column, ch: Column) -> Column:
        y0, x0 = F.floor(q["y"]), F.floor(q["x"])
        y1, x1 = F.least(F.lit(h - 1), y0 + 1), F.least(F.lit(w - 1), x0 + 1)
        pixel = lambda y, x: _at(v, (y * w + x) * c + ch)
        along = lambda y: pixel(y, x0) * (1 - (q["x"] - x0)) + pixel(y, x1) * (q["x"] - x0)
        return F.when(q["hit"], along(y0) * (1 - (q["y"] - y0)) + along(y1) * (q["y"] - y0)).otherwise(F.lit(float(fill)))

    def one(i: Column) -> Column:
        row, col, ch = _place(i, w, c)
        y, x, counts = source(row.cast("double"), col.cast("double"))
        place = F.struct(y.alias("y"), x.alias("x"), (F.lit(True) if counts is None else counts).alias("counts"))
        kept = lambda p: F.struct(held(p["y"], h).alias("y"), held(p["x"], w).alias("x"), inside(p["y"], p["x"], p["counts"]).alias("hit"))
        return let(place, lambda p: let(kept(p), lambda q: mixed(q, ch)))

    return F.transform(_index(h * w * c), one)


def warp_affine(v: Column, h: int, w: int, matrix: Sequence, fill: float = 0.0, c: int = 1) -> Column:
    """matrix (a, b, c, d, tx, ty), numbers or Columns: the source of output (x, y), from the centre, is (a x + b y + tx, c x + d y + ty)."""
    a, b, m, d, tx, ty = (x if isinstance(x, Column) else F.lit(float(x)) for x in matrix)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    return gathered(v, h, w, lambda y, x: (m * (x - cx) + d * (y - cy) + ty + cy, a * (x - cx) + b * (y - cy) + tx + cx, None), fill, c)


def rotate(v: Column, h: int, w: int, degrees, fill: float = 0.0, c: int = 1) -> Column:
    """``degrees`` may be a Column."""
    if isinstance(degrees, Column):
        return let(F.radians(degrees), lambda r: warp_affine(v, h, w, (F.cos(r), F.sin(r), -F.sin(r), F.cos(r), 0.0, 0.0), fill, c))
    r = math.radians(degrees)
    return warp_affine(v, h, w, (math.cos(r), math.sin(r), -math.sin(r), math.cos(r), 0.0, 0.0), fill, c)


def fish_eye(v: Column, h: int, w: int, c: int = 1) -> Column:
    """Places are drawn to the middle by their distance from it, in units of half the image; nothing beyond distance one."""

    def source(y: Column, x: Column) -> tuple[Column, Column, Column]:
        ny, nx = 2 * y / max(1, h - 1) - 1, 2 * x / max(1, w - 1) - 1
        r = F.sqrt(nx * nx + ny * ny)
        k = F.when(r > 0, (r + 1 - F.sqrt(F.greatest(F.lit(0.0), 1 - r * r))) / 2 / r).otherwise(F.lit(1.0))
        return (ny * k + 1) / 2 * (h - 1), (nx * k + 1) / 2 * (w - 1), r <= 1

    return gathered(v, h, w, source, 0.0, c)


def lens_correction(v: Column, h: int, w: int, k1: float = 0.0, k2: float = 0.0, p1: float = 0.0, p2: float = 0.0, k3: float = 0.0, focal: float | None = None, c: int = 1) -> Column:
    """Radial and tangential distortion about the centre; lengths are in units of ``focal``, by default the longer side."""
    f = float(focal or max(h, w))

    def source(y: Column, x: Column) -> tuple[Column, Column, None]:
        a, b = (x - (w - 1) / 2) / f, (y - (h - 1) / 2) / f
        r2 = a * a + b * b
        radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
        da = a * radial + 2 * p1 * a * b + p2 * (r2 + 2 * a * a)
        db = b * radial + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b
        return db * f + (h - 1) / 2, da * f + (w - 1) / 2, None

    return gathered(v, h, w, source, 0.0, c)


# --- colour: pixels of three channels by hue, saturation and value ---


def _turned(r: Column, g: Column, b: Column, degrees, factor) -> Column:
    """The three channels after the hue went on by ``degrees`` and the saturation was multiplied."""
    amounts = F.struct(F.greatest(r, g, b).alias("top"), (F.greatest(r, g, b) - F.least(r, g, b)).alias("span"))

    def hsv(m: Column) -> Column:
        top, span = m["top"], m["span"]
        sixth = F.when(top == r, F.pmod((g - b) / span, F.lit(6.0))).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
        hue = F.when(span > 0, sixth * 60).otherwise(F.lit(0.0))
        sat = F.when(top > 0, span / top).otherwise(F.lit(0.0))
        return F.struct(F.pmod(hue + degrees, F.lit(360.0)).alias("h"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sat * factor)).alias("s"), top.alias("v"))

    def channel(t: Column, n: int) -> Column:
        at = F.pmod(n + t["h"] / 60, F.lit(6.0))
        return t["v"] - t["v"] * t["s"] * F.greatest(F.lit(0.0), F.least(F.lit(1.0), at, 4 - at))

    return let(amounts, lambda m: let(hsv(m), lambda t: F.array(*(channel(t, n) for n in (5, 3, 1)))))


def hue_saturation(v: Column, degrees=0.0, factor=1.0) -> Column:
    """Hue turned by ``degrees`` and saturation times ``factor``, numbers or Columns, of pixels of three channels in 0..255."""
    degrees, factor = (x if isinstance(x, Column) else F.lit(float(x)) for x in (degrees, factor))
    unit = lambda i, k: _at(v, i * 3 + k) / 255.0
    pixel = lambda i: F.array(unit(i, 0), unit(i, 1), unit(i, 2))
    # A black or grey pixel has no hue; where the span is zero nothing is divided by it.
    one = lambda i: let(pixel(i), lambda p: F.transform(_turned(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2)), degrees, factor), lambda x: x * 255.0))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 3).cast("int") - 1), one))


def hue(v: Column, degrees) -> Column:
    return hue_saturation(v, degrees)


def saturation(v: Column, factor) -> Column:
    return hue_saturation(v, 0.0, factor)


def color_twist_hsv(v: Column, alpha=1.0, beta=0.0, degrees=0.0, factor=1.0) -> Column:
    """Brightness and contrast, held to 0..255, then hue and saturation in one conversion."""
    lit = F.transform(v, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), x * alpha + beta)))
    return let(lit, lambda x: hue_saturation(x, degrees, factor))


def mirror(v: Column, h: int, w: int, key: Column, probability: float = 1.0, c: int = 1, seed: int = 0) -> Column:
    """Columns reversed for a share of the samples."""
    return flip(v, h, w, F.when(rng.uniform(seed, "mirror", key) < probability, 1).otherwise(0), 0, c)
