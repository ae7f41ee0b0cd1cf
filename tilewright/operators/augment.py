"""Chains of effects on images of one shape, by name.

A chain is an expression: each effect is a Column of the Column before it, so
Catalyst plans the whole chain as one projection and no row crosses to Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import effects as E
from tilewright.functions import tensor as T

Shape = tuple[int, int, int]  # height, width, channels


def _same(f: Callable[..., Column]) -> Callable:
    """An effect that looks at shape, sample and seed, and keeps the shape."""
    return lambda v, s, key, seed, **given: (f(v, s[0], s[1], key=key, c=s[2], seed=seed, **given), s)


def _placed(f: Callable[..., Column]) -> Callable:
    """An effect that looks at the shape alone and keeps it."""
    return lambda v, s, key, seed, **given: (f(v, s[0], s[1], c=s[2], **given), s)


def _plain(f: Callable[..., Column]) -> Callable:
    """An effect on the values."""
    return lambda v, s, key, seed, **given: (f(v, **given), s)


def _crop(v: Column, s: Shape, key: Column, seed: int, y: int, x: int, height: int, width: int) -> tuple[Column, Shape]:
    return T.crop(v, s[1], y, x, height, width, s[2]), (height, width, s[2])


def _resize(v: Column, s: Shape, key: Column, seed: int, height: int, width: int) -> tuple[Column, Shape]:
    return T.resize_bilinear(v, *s[:2], height, width, s[2]), (height, width, s[2])


def _random_crop_resize(v: Column, s: Shape, key: Column, seed: int, height: int, width: int, **given) -> tuple[Column, Shape]:
    return E.random_crop_resize(v, s[0], s[1], height, width, key, c=s[2], seed=seed, **given), (height, width, s[2])


def _normalize(v: Column, s: Shape, key: Column, seed: int, mean, std) -> tuple[Column, Shape]:
    return T.crop_mirror_normalize(v, s[0], s[1], s[0], s[1], 0, mean, std, c=s[2]), s


EFFECTS: dict[str, Callable] = {
    "crop": _crop,
    "resize": _resize,
    "random_crop_resize": _random_crop_resize,
    "normalize": _normalize,
    **{f.__name__: _same(f) for f in (E.mirror, E.jitter, E.salt_and_pepper, E.snow, E.rain)},
    **{f.__name__: _placed(f) for f in (E.warp_affine, E.rotate, E.fish_eye, E.lens_correction)},
    **{f.__name__: _plain(f) for f in (E.hue, E.saturation)},
    "color_twist": _plain(E.color_twist_hsv),
}


def chained(v: Column, key: Column, shape: Shape, chain: list[tuple[str, dict]], seed: int = 0) -> Column:
    """``v`` after all effects of ``chain``, each a name and its arguments; each step draws by a seed of its own, the first by ``seed``."""

    def after(x: Column, s: Shape, steps: list, n: int) -> Column:
        if not steps:
            return x
        (name, given), *rest = steps
        made, to = EFFECTS[name](x, s, key, seed + n, **given)
        # An effect looks at many places of what comes before it, which is computed once.
        return T.let(made, lambda y: after(y, to, rest, n + 1)) if rest else made

    return after(v, shape, chain, 0)


def apply(df: DataFrame, key: str, values: str, shape: Shape, chain: list[tuple[str, dict]], seed: int = 0) -> DataFrame:
    """(key, values) after all effects of ``chain``. A null stays null."""
    v = F.col(values).cast("array<double>")
    out = F.when(F.col(values).isNotNull(), T.let(v, lambda x: chained(x, F.col(key), shape, chain, seed)))
    return df.select(F.col(key), out.alias(values))
