"""Random values as pure functions of (seed, operator, epoch, sample, draw).

The same arguments give the same value on any partitioning and after any
retry, which session-level generators do not promise. Bits come from MD5 over
the arguments as text, so that any engine can tell the same values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that are used; they fit a double exactly.
_DIGITS = 13


def uniform(seed: int, name: str, key: Column, epoch: int | Column = 0, draw: int | Column = 0) -> Column:
    """A double in [0, 1)."""
    as_text = lambda x: F.coalesce((x if isinstance(x, Column) else F.lit(x)).cast("string"), F.lit("null"))
    digest = F.md5(F.concat_ws(":", as_text(seed), as_text(name), as_text(epoch), as_text(key), as_text(draw)).cast("binary"))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long") / F.lit(float(1 << 4 * _DIGITS))


def uniform_range(u: Column, low: float, high: float) -> Column:
    return u * F.lit(float(high - low)) + F.lit(float(low))


def uniform_int(u: Column, low: int, high: int) -> Column:
    """An integer in [low, high], both inclusive."""
    return (F.floor(u * (high - low + 1)) + low).cast("int")


def normal(u1: Column, u2: Column, mean: float = 0.0, stddev: float = 1.0) -> Column:
    """Box-Muller; ``1 - u1`` is in (0, 1], so its logarithm is finite."""
    return F.sqrt(-2 * F.log(1 - u1)) * F.cos(2 * F.pi() * u2) * stddev + mean


def coin(u: Column, probability: float = 0.5) -> Column:
    return (u < probability).cast("int")


def discrete(u: Column, values: Sequence, frequencies: Sequence[float]) -> Column:
    """The value whose share of the cumulative frequencies holds ``u``."""
    total, upto = float(sum(frequencies)), 0.0
    out = None
    for value, frequency in zip(values[:-1], frequencies[:-1]):
        upto += frequency / total
        out = F.when(u < upto, F.lit(value)) if out is None else out.when(u < upto, F.lit(value))
    return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))


#: The ranges from which an effect draws what it isn't given; whole ends mean whole numbers.
RANGES = {
    "brightness": {"alpha": (0.1, 1.95), "beta": (0.0, 25.0)},
    "contrast": {"factor": (0.1, 1.95), "center": (60.0, 90.0)},
    "gamma": {"value": (0.3, 7.0)},
    "exposure": {"factor": (0.15, 0.95)},
    "hue": {"degrees": (-359.0, 359.0)},
    "saturation": {"factor": (-0.5, 0.5)},
    "color_temperature": {"adjustment": (-99, 99)},
    "color_twist": {"alpha": (0.1, 1.95), "beta": (0.1, 25.0), "degrees": (5.0, 170.0), "factor": (0.1, 0.4)},
    "blend": {"ratio": (0.1, 0.9)},
    "vignette": {"sdev": (40.0, 60.0)},
    "rotate": {"degrees": (0.0, 180.0)},
    "warp_affine": {"x0": (-0.35, 0.35), "x1": (0.65, 1.35), "y0": (-0.35, 0.35), "y1": (0.65, 1.35), "o0": (-10.0, 10.0), "o1": (-10.0, 10.0)},
    "flip": {"horizontal": (0, 1), "vertical": (0, 1)},
    "mirror": {"mirror": (0, 1)},
    "snow": {"amount": (0.1, 0.8)},
    "fog": {"intensity": (0.1, 0.5), "gray": (0.2, 0.8)},
    "rain": {"transparency": (0.2, 0.3)},
    "salt_and_pepper": {"noise": (0.1, 1.0), "salt": (0.1, 1.0), "salt_value": (0.1, 1.0), "pepper_value": (0.0, 0.5)},
    "crop": {"drift_x": (0.01, 0.99), "drift_y": (0.01, 0.99), "height": (0.55, 0.95), "width": (0.55, 0.95)},
}


def drawn(effect: str, seed: int, key: Column, epoch: int | Column = 0, **given) -> dict[str, Column]:
    """The parameters of an effect by name: those given, and draws from ``RANGES`` for the others."""
    out = {}
    for name, (low, high) in RANGES[effect].items():
        u = uniform(seed, f"{effect} {name}", key, epoch)
        pick = uniform_int if isinstance(low, int) else uniform_range
        out[name] = given[name] if name in given else pick(u, low, high)
    return out
