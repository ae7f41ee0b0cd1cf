"""Tensor operators as Column functions over a flat ``array<double>``.

An image of h rows, w columns and c channels is stored row by row, channels
innermost (HWC). Nothing here explodes pixels or leaves the JVM. Where the
conventional formula of an effect is a choice of this library, the docstring
says "convention".
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _index(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _at(v: Column, i: Column) -> Column:
    """Element by zero-based index."""
    return F.get(v, i.cast("int"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once.

    An expression that a lambda refers to is evaluated again for every element;
    bound as the variable of a one-element transform it is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clamp_u8(x: Column) -> Column:
    """An 8-bit pixel: rounded half up and held to 0..255."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(x + 0.5).cast("double")))


def pixels(v: Column, low: float = -0.5, high: float = 0.5) -> Column:
    """8-bit pixels from values in [low, high]; values beyond are clipped."""
    return F.transform(v, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((x.cast("double") - low) * (255.0 / (high - low))).cast("double"))))


# --- element by element ------------------------------------------------------


def brightness(v: Column, alpha=1.0, beta=0.0) -> Column:
    """alpha * x + beta (convention)."""
    return F.transform(v, lambda x: clamp_u8(x * _num(alpha) + _num(beta)))


def contrast(v: Column, factor=1.0, center=128.0) -> Column:
    """(x - center) * factor + center (convention)."""
    return F.transform(v, lambda x: clamp_u8((x - _num(center)) * _num(factor) + _num(center)))


def gamma(v: Column, value=1.0) -> Column:
    """255 * (x / 255) ** gamma (convention)."""
    return F.transform(v, lambda x: clamp_u8(F.pow(x / 255.0, _num(value)) * 255.0))


def exposure(v: Column, factor=0.0) -> Column:
    """x * 2 ** factor (convention)."""
    return F.transform(v, lambda x: clamp_u8(x * F.pow(F.lit(2.0), _num(factor))))


def color_temperature(v: Column, adjustment, channels: int = 3) -> Column:
    """Adds to the first channel and takes from the third (convention)."""
    a = _num(adjustment)
    shift = lambda i: F.when(i % channels == 0, a).when(i % channels == 2, -a).otherwise(F.lit(0.0))
    return F.transform(v, lambda x, i: clamp_u8(x + shift(i)))


def blend(a: Column, b: Column, ratio=0.5) -> Column:
    """ratio * a + (1 - ratio) * b."""
    r = _num(ratio)
    return F.zip_with(a, b, lambda x, y: r * x + (1.0 - r) * y)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(v: Column, factor) -> Column:
    return F.transform(v, lambda x: x * _num(factor))


def log1p(v: Column) -> Column:
    return F.transform(v, lambda x: F.log1p(x))


def vignette(v: Column, h: int, w: int, sdev=50.0, c: int = 1) -> Column:
    """x * exp(-r2 / (2 * sdev2)), r from the centre (convention)."""
    s2 = 2.0 * _num(sdev) * _num(sdev)

    def one(x: Column, i: Column) -> Column:
        p = F.floor(i / c)
        dy, dx = F.floor(p / w) - (h - 1) / 2.0, p % w - (w - 1) / 2.0
        return clamp_u8(x * F.exp(-(dx * dx + dy * dy) / s2))

    return F.transform(v, one)


def fog(v: Column, intensity=0.5, gray=0.5) -> Column:
    """Mixes every pixel with a gray level (convention)."""
    k = _num(intensity)
    return F.transform(v, lambda x: clamp_u8(x * (1.0 - k) + _num(gray) * 255.0 * k))


def to_tensor(v: Column, multiplier: Sequence[float], offset: Sequence[float], reverse_channels: bool = False) -> Column:
    """offset[c] + multiplier[c] * x, channels optionally reversed first."""
    n = len(multiplier)
    m, o = F.array(*map(_num, multiplier)), F.array(*map(_num, offset))
    flipped = F.transform(v, lambda _, i: _at(v, i - i % n + (n - 1 - i % n))) if reverse_channels else v
    return F.transform(flipped, lambda x, i: _at(o, i % n) + _at(m, i % n) * x)


def to_planes(v: Column, h: int, w: int, c: int) -> Column:
    """HWC to CHW."""
    return F.transform(_index(h * w * c), lambda i: _at(v, (i % (h * w)) * c + F.floor(i / (h * w))))


# --- geometry ----------------------------------------------------------------


def rows(v: Column, h: int, stride: int) -> Column:
    return F.transform(_index(h), lambda r: F.slice(v, r * stride + 1, F.lit(stride)))


def crop(v: Column, w: int, y, x, ch, cw, c: int = 1) -> Column:
    """The window of ch rows and cw columns whose first pixel is (y, x); w is the image's width."""
    y, x, ch, cw = map(_col, (y, x, ch, cw))
    return F.flatten(F.transform(F.sequence(y, y + ch - 1), lambda r: F.slice(v, (r * w + x) * c + 1, cw * c)))


def crop_anchor(position, size: int, crop_size: int) -> Column:
    """First row or column of a crop at a relative position; halves go to the even number."""
    return F.bround(_num(position) * (size - crop_size)).cast("int")


def center_crop(v: Column, h: int, w: int, ch: int, cw: int, c: int = 1) -> Column:
    return crop(v, w, crop_anchor(0.5, h, ch), crop_anchor(0.5, w, cw), ch, cw, c)


def flip(v: Column, h: int, w: int, horizontal=1, vertical=0, c: int = 1) -> Column:
    """Mirrors columns and rows; flags may be columns."""
    across, down = _col(horizontal), _col(vertical)
    pixel = lambda r: F.flatten(F.reverse(F.transform(_index(w), lambda i: F.slice(r, i * c + 1, F.lit(c)))))
    lines = rows(v, h, w * c)
    turned = F.when(across == 1, F.transform(lines, pixel)).otherwise(lines)
    return F.flatten(F.when(down == 1, F.reverse(turned)).otherwise(turned))


def transpose(v: Column, h: int, w: int) -> Column:
    return F.transform(_index(h * w), lambda i: _at(v, (i % h) * w + F.floor(i / h)))


def permute(v: Column, shape: Sequence[int], perm: Sequence[int]) -> Column:
    """Any permutation of axes; the new axis k is the old axis perm[k]."""
    size, strides = 1, [0] * len(shape)
    for k in reversed(range(len(shape))):
        strides[k], size = size, size * shape[k]
    new = [shape[p] for p in perm]

    def source(i: Column) -> Column:
        out, rest = F.lit(0), i
        for k in reversed(range(len(new))):
            out, rest = out + rest % new[k] * strides[perm[k]], F.floor(rest / new[k])
        return out

    return F.transform(_index(size), lambda i: _at(v, source(i)))


def sequence_rearrange(frames: Column, order: Sequence[int]) -> Column:
    """Frames by index; indexes may repeat or leave some out."""
    return F.transform(F.array(*map(F.lit, order)), lambda i: F.get(frames, i))


def slice_pad(v: Column, start, size, fill=0.0, policy: str = "pad") -> Column:
    """size elements from start; outside the array: filled ("pad"), left out ("trim") or an error ("error")."""
    s, n = _col(start), _col(size)
    if policy == "trim":
        lo = F.greatest(s, F.lit(0))
        return F.slice(v, lo + 1, F.greatest(F.lit(0), F.least(s + n, F.size(v)) - lo))
    picked = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when((i + s >= 0) & (i + s < F.size(v)), F.get(v, i + s)).otherwise(_num(fill)))
    if policy == "error":
        return F.when((s < 0) | (s + n > F.size(v)), F.raise_error(F.lit("slice out of bounds"))).otherwise(picked)
    return picked


def window(v: Column, shape: Sequence, start: Sequence, size: Sequence, fill=0.0) -> Column:
    """``size`` places along each axis from ``start`` on, those outside of ``shape`` filled; all may hold columns."""
    shape, start, size = ([_col(x) for x in xs] for xs in (shape, start, size))
    total = F.lit(1)
    for n in size:
        total = total * n

    def one(i: Column) -> Column:
        rest, flat, stride, inside = i, F.lit(0), F.lit(1), F.lit(True)
        for extent, first, n in reversed(list(zip(shape, start, size))):
            at = rest % n + first
            inside, flat = inside & (at >= 0) & (at < extent), flat + at * stride
            rest, stride = F.floor(rest / n), stride * extent
        return F.when(inside, _at(v, flat)).otherwise(_num(fill))

    return F.when(total > 0, F.transform(F.sequence(F.lit(0), total - 1), one)).otherwise(F.expr("cast(array() as array<double>)"))


def slice_axes(v: Column, shape: Sequence[int], start: Sequence, size: Sequence, fill=0.0, policy: str = "error") -> Column:
    """A slice along every axis; places outside are an error, filled ("pad") or left out ("trim")."""
    first, long = [_col(x) for x in start], [_col(x) for x in size]
    if policy == "trim":
        low = [F.greatest(x, F.lit(0)) for x in first]
        return window(v, shape, low, [F.greatest(F.lit(0), F.least(x + n, F.lit(m)) - lo) for x, n, m, lo in zip(first, long, shape, low)])
    out = window(v, shape, first, long, fill)
    if policy == "pad":
        return out
    beyond = F.lit(False)
    for x, n, m in zip(first, long, shape):
        beyond = beyond | (x < 0) | (x + n > m)
    return F.when(beyond, F.raise_error(F.lit("slice out of bounds"))).otherwise(out)


def resize_dims(w: int, h: int, dest_w: int = 0, dest_h: int = 0, mode: str = "default", limit: tuple[int, int] | None = None) -> tuple[int, int]:
    """Output (width, height). 0 leaves a side open.

    "stretch" keeps an open side, "default" scales it with the other, and
    "not_smaller"/"not_larger" keep the aspect so that both sides are at least
    or at most as asked.
    """
    half_up = lambda x: int(x + 0.5)
    cap = lambda a, b: (min(a, limit[0]), min(b, limit[1])) if limit else (a, b)
    if mode == "stretch":
        return cap(dest_w or w, dest_h or h)
    if mode == "default":
        if dest_w and dest_h:
            return cap(dest_w, dest_h)
        return cap(dest_w or half_up(w * dest_h / h), dest_h or half_up(h * dest_w / w))
    ratios = [d / s for d, s in ((dest_w, w), (dest_h, h)) if d]
    ratio = max(ratios) if mode == "not_smaller" else min(ratios)
    if limit:
        ratio = min(ratio, limit[0] / w, limit[1] / h)
    return half_up(w * ratio), half_up(h * ratio)


def _place(i: Column, w: int, c: int) -> tuple[Column, Column, Column]:
    """(row, column, channel) of a flat place in an image of w columns and c channels."""
    p = F.floor(i / c)
    return F.floor(p / w), p % w, i % c


def resize_nearest(v: Column, h: int, w: int, oh: int, ow: int, c: int = 1) -> Column:
    """The pixel under the centre of each new one (convention)."""

    def one(i: Column) -> Column:
        row, col, ch = _place(i, ow, c)
        y = F.least(F.lit(h - 1), F.floor((row + 0.5) * (h / oh)))
        x = F.least(F.lit(w - 1), F.floor((col + 0.5) * (w / ow)))
        return _at(v, (y * w + x) * c + ch)

    return F.transform(_index(oh * ow * c), one)


def resize_bilinear(v: Column, h: int, w: int, oh: int, ow: int, c: int = 1) -> Column:
    """Bilinear with pixel centres aligned and edges repeated (convention)."""

    def one(i: Column) -> Column:
        row, col, ch = _place(i, ow, c)
        fy = F.greatest(F.lit(0.0), F.least(F.lit(h - 1.0), (row + 0.5) * (h / oh) - 0.5))
        fx = F.greatest(F.lit(0.0), F.least(F.lit(w - 1.0), (col + 0.5) * (w / ow) - 0.5))
        y0, x0 = F.floor(fy), F.floor(fx)
        y1, x1 = F.least(F.lit(h - 1), y0 + 1), F.least(F.lit(w - 1), x0 + 1)
        pixel = lambda y, x: _at(v, (y * w + x) * c + ch)
        top = pixel(y0, x0) * (1 - (fx - x0)) + pixel(y0, x1) * (fx - x0)
        low = pixel(y1, x0) * (1 - (fx - x0)) + pixel(y1, x1) * (fx - x0)
        return top * (1 - (fy - y0)) + low * (fy - y0)

    return F.transform(_index(oh * ow * c), one)


def _cubic(x: float) -> float:
    x = abs(x)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0


def _lanczos(x: float) -> float:
    sinc = lambda t: 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
    return sinc(x) * sinc(x / 3) if abs(x) < 3 else 0.0


#: Interpolation: (kernel, its reach in source pixels).
KERNELS = {
    "triangular": (lambda x: max(0.0, 1 - abs(x)), 1.0),
    "cubic": (_cubic, 2.0),
    "lanczos": (_lanczos, 3.0),
    "gaussian": (lambda x: math.exp(-2 * x * x) if abs(x) < 2 else 0.0, 2.0),
}


def _taps(n: int, out: int, method: str) -> list[list[tuple[int, float]]]:
    """For each new place the (source, weight) pairs that sum to one; a kernel widens as an image shrinks."""
    kernel, reach = KERNELS[method]
    wide = max(1.0, n / out)
    taps = []
    for o in range(out):
        centre = (o + 0.5) * n / out - 0.5
        near = range(math.ceil(centre - reach * wide), math.floor(centre + reach * wide) + 1)
        weights = [(min(n - 1, max(0, j)), kernel((j - centre) / wide)) for j in near]
        total = sum(k for _, k in weights)
        taps.append([(j, k / total) for j, k in weights])
    return taps


def resize(v: Column, h: int, w: int, oh: int, ow: int, c: int = 1, method: str = "linear") -> Column:
    """Any interpolation: "nearest", "linear", or a kernel of ``KERNELS`` along columns and then rows, edges repeated (convention)."""
    if method == "nearest":
        return resize_nearest(v, h, w, oh, ow, c)
    if method == "linear":
        return resize_bilinear(v, h, w, oh, ow, c)

    def along(values: Column, n: int, out: int, size: int, source) -> Column:
        """``size`` values; ``source`` gives from a place the tap list and the flat place of a tap."""
        table = F.array(*(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(k).alias("k")) for j, k in taps)) for taps in _taps(n, out, method)))

        def one(taps: Column, x: Column, i: Column) -> Column:
            which, place = source(i)
            return F.aggregate(F.get(taps, which.cast("int")), F.lit(0.0), lambda a, t: a + _at(x, place(t["j"])) * t["k"])

        return let(table, lambda taps: let(values, lambda x: F.transform(_index(size), lambda i: one(taps, x, i))))

    def across(i: Column):
        row, col, ch = _place(i, ow, c)
        return col, lambda j: (row * w + j) * c + ch

    def down(i: Column):
        row, col, ch = _place(i, ow, c)
        return row, lambda j: (j * ow + col) * c + ch

    return along(along(v, w, ow, h * ow * c, across), h, oh, oh * ow * c, down)


def roi_resize(v: Column, w: int, y: int, x: int, rh: int, rw: int, oh: int, ow: int, c: int = 1, method: str = "linear") -> Column:
    """A fixed region, resized."""
    return resize(crop(v, w, y, x, rh, rw, c), rh, rw, oh, ow, c, method)


def crop_resize_fixed(v: Column, h: int, w: int, oh: int, ow: int, area: float = 0.75, aspect: float = 1.0, drift_x: float = 0.0, drift_y: float = 0.0, c: int = 1, method: str = "linear") -> Column:
    """A region of a share ``area`` of the image, resized; its sides follow ``aspect`` (width over height), its centre moves by the drifts.

    A drift of -1 or 1 takes the region to the image's edge (convention).
    """
    rw = max(1, min(w, round(math.sqrt(area * h * w * aspect))))
    rh = max(1, min(h, round(math.sqrt(area * h * w / aspect))))
    x, y = (round((n - r) * (1 + d) / 2) for n, r, d in ((w, rw, drift_x), (h, rh, drift_y)))
    return roi_resize(v, w, y, x, rh, rw, oh, ow, c, method)


def resize_crop_mirror(v: Column, h: int, w: int, oh: int, ow: int, ch: int, cw: int, mirror=0, c: int = 1, y=0.5, x=0.5, method: str = "linear") -> Column:
    """Resized, cropped at a relative position (numbers or columns, the centre by default), mirrored where the flag is 1."""
    resized = let(resize(v, h, w, oh, ow, c, method), lambda r: crop(r, ow, crop_anchor(y, oh, ch), crop_anchor(x, ow, cw), ch, cw, c))
    return flip(resized, ch, cw, mirror, 0, c)


def pixelate(v: Column, h: int, w: int, block: int, c: int = 1) -> Column:
    """The mean of each block for all its pixels (convention); blocks at the far edges may be smaller."""

    def mean(i: Column) -> Column:
        row, col, ch = _place(i, w, c)
        y, x = F.floor(row / block) * block, F.floor(col / block) * block
        bh, bw = F.least(F.lit(block), h - y), F.least(F.lit(block), w - x)
        cells = F.transform(F.sequence(F.lit(0).cast("long"), bh * bw - 1), lambda k: _at(v, ((y + F.floor(k / bw)) * w + x + k % bw) * c + ch))
        return F.aggregate(cells, F.lit(0.0), lambda a, b: a + b) / F.size(cells)

    return F.transform(_index(h * w * c), mean)


def blur3(v: Column, h: int, w: int, c: int = 1) -> Column:
    """3 x 3 Gaussian (1 2 1), edges repeated (convention)."""
    taps = F.array(*(F.struct(F.lit(dy).alias("y"), F.lit(dx).alias("x"), F.lit((2 - abs(dy)) * (2 - abs(dx)) / 16.0).alias("k")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    held = lambda x, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), x))

    def one(i: Column) -> Column:
        row, col, ch = _place(i, w, c)
        near = lambda t: _at(v, (held(row + t["y"], h) * w + held(col + t["x"], w)) * c + ch)
        return F.aggregate(taps, F.lit(0.0), lambda a, t: a + near(t) * t["k"])

    return F.transform(_index(h * w * c), one)


# --- normalisation -----------------------------------------------------------


def _mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)


def normalize(v: Column, mean=None, std=None, scale_by: float = 1.0, shift: float = 0.0) -> Column:
    """scale * (x - mean) / std + shift; mean and std are taken from the values where not given.

    A spread of 0 gives ``shift`` everywhere.
    """
    spread = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x) / F.size(c)) if std is None else _num(std)
    scaled = lambda c, s: F.transform(c, lambda x: F.when(s == 0, F.lit(float(shift))).otherwise(x / s * scale_by + shift))
    centred = let(_mean(v) if mean is None else _num(mean), lambda m: F.transform(v, lambda x: x - m))
    return let(centred, lambda c: let(spread(c), lambda s: scaled(c, s)))


def normalize_rows(v: Column, h: int, w: int) -> Column:
    """Each row by its own mean and spread."""
    return F.flatten(F.transform(rows(v, h, w), lambda r: normalize(r)))


def normalize_axes(v: Column, shape: Sequence[int], axes: Sequence[int], mean: Sequence[float] | None = None, std: Sequence[float] | None = None, scale_by: float = 1.0, shift: float = 0.0) -> Column:
    """scale * (x - mean) / std + shift, with a mean and spread for each place on the axes that are not in ``axes``.

    ``mean`` and ``std``, where given, list the values of those places, or one
    value for all. A spread of 0 gives ``shift``.
    """
    strides = [math.prod(shape[k + 1 :]) for k in range(len(shape))]
    kept = [k for k in range(len(shape)) if k not in axes]

    def places(which: Sequence[int]) -> Column:
        out = [0]
        for k in which:
            out = [o + i * strides[k] for o in out for i in range(shape[k])]
        return F.array(*map(F.lit, out))

    groups, members = math.prod(shape[k] for k in kept), math.prod(shape[k] for k in axes)
    # The first member of each group, and the way from there to the others.
    first, others = places(kept), places(list(axes))
    given = lambda x: F.array(*(F.lit(float(y)) for y in (x if len(x) == groups else list(x) * groups)))

    def fold(f) -> Column:
        return let(others, lambda o: F.transform(first, lambda b: F.aggregate(o, F.lit(0.0), lambda a, k: a + f(_at(v, b + k), b)) / float(members)))

    def group(i: Column) -> Column:
        out = F.lit(0)
        for k in kept:
            out = out * shape[k] + F.floor(i / strides[k]) % shape[k]
        return out

    means = fold(lambda x, b: x) if mean is None else given(mean)

    def spread(m: Column) -> Column:
        if std is not None:
            return given(std)
        each = F.transform(F.arrays_zip(first.alias("b"), m.alias("m")), lambda z: F.aggregate(others, F.lit(0.0), lambda a, k: a + (_at(v, z["b"] + k) - z["m"]) * (_at(v, z["b"] + k) - z["m"])))
        return F.transform(each, lambda x: F.sqrt(x / float(members)))

    def scaled(m: Column, s: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            deviation = F.get(s, group(i).cast("int"))
            return F.when(deviation == 0, F.lit(float(shift))).otherwise((x - F.get(m, group(i).cast("int"))) / deviation * scale_by + shift)

        return F.transform(v, one)

    return let(means, lambda m: let(spread(m), lambda s: scaled(m, s)))


def _by_channel(v: Column, mean, std, c: int) -> Column:
    if c == 1 and not isinstance(mean, (list, tuple)):
        return normalize(v, mean, std)
    each = lambda x: F.array(*(F.lit(float(y)) for y in (x if isinstance(x, (list, tuple)) else [x] * c)))
    m, s = each(mean), each(std)
    return F.transform(v, lambda x, i: (x - _at(m, i % c)) / _at(s, i % c))


def crop_mirror_normalize(v: Column, h: int, w: int, ch: int, cw: int, mirror=0, mean=0.0, std=1.0, y=0.5, x=0.5, c: int = 1) -> Column:
    """Crop at a relative position, mirror where the flag is 1, then (x - mean) / std; mean and std may list a value for each channel."""
    cropped = crop(v, w, crop_anchor(y, h, ch), crop_anchor(x, w, cw), ch, cw, c)
    return _by_channel(flip(cropped, ch, cw, mirror, 0, c), mean, std, c)


def resize_mirror_normalize(v: Column, h: int, w: int, oh: int, ow: int, mirror=0, mean=0.0, std=1.0, c: int = 1, method: str = "linear") -> Column:
    """Resized, mirrored where the flag is 1, then (x - mean) / std by channel."""
    return _by_channel(flip(resize(v, h, w, oh, ow, c, method), oh, ow, mirror, 0, c), mean, std, c)


def one_hot(label: Column, classes: int) -> Column:
    """Label k takes slot k - 1 and label 0 the last; labels out of range give zeros."""
    inside = (label >= 0) & (label <= classes)
    return F.transform(_index(classes), lambda i: F.when(inside & (i == F.pmod(label - 1, F.lit(classes))), 1).otherwise(0))
