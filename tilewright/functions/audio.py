"""Audio operators as Column functions over ``array<double>`` samples."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.tensor import let


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def preemphasis(v: Column, coefficient=0.97, border: str = "clamp") -> Column:
    """x[t] - c * x[t-1]; x[-1] is 0 ("zero"), x[0] ("clamp") or x[1] ("reflect")."""
    before = {"zero": F.lit(0.0), "clamp": F.get(v, F.lit(0)), "reflect": F.coalesce(F.get(v, F.lit(1)), F.get(v, F.lit(0)))}[border]
    return F.transform(v, lambda x, i: x - _num(coefficient) * F.when(i == 0, before).otherwise(F.get(v, i - 1)))


def to_decibels(v: Column, multiplier: float = 10.0, reference: float = 1.0, cutoff_db: float = -200.0) -> Column:
    """multiplier * log10(max(10 ** (cutoff / multiplier), x / reference))."""
    least = 10.0 ** (cutoff_db / multiplier)
    return F.transform(v, lambda x: F.log10(F.greatest(F.lit(least), x / reference)) * multiplier)


def downmix(channels: Column) -> Column:
    """Mean over the channels of each frame; frames are arrays."""
    return F.transform(channels, lambda f: F.aggregate(f, F.lit(0.0), lambda a, x: a + x) / F.size(f))


_BLOCK = 64


def running_sums(v: Column) -> Column:
    """The sums of no, one, two and so on up to all values.

    An array is copied when a value is appended, so sums are taken by blocks,
    and then over the blocks.
    """
    none = F.struct(F.lit(0.0).alias("at"), F.expr("cast(array() as array<double>)").alias("seen"))
    add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["seen"], F.array(acc["at"] + x)).alias("seen"))
    within = lambda block: F.aggregate(block, none, add)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(v)), F.lit(_BLOCK))

    def joined(parts: Column) -> Column:
        before = lambda totals, k: F.when(k == 0, F.lit(0.0)).otherwise(F.get(totals, k - 1))
        moved = lambda totals: F.transform(parts, lambda p, k: let(before(totals, k), lambda o: F.transform(p["seen"], lambda x: x + o)))
        return let(within(F.transform(parts, lambda p: p["at"]))["seen"], lambda totals: F.concat(F.array(F.lit(0.0)), F.flatten(moved(totals))))

    return let(F.transform(starts, lambda i: within(F.slice(v, i, F.lit(_BLOCK)))), joined)


def moving_power(v: Column, window: int, reset: int = 8192) -> Column:
    """For each sample the mean square of the ``window`` samples that end there; those before the start count 0.

    Running sums begin anew every ``reset`` samples (or every window, if that
    is longer), so their precision doesn't fall over a long signal; a window
    that goes over such a place is the end of one run and the start of the next.
    """
    every = max(reset, window)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(v)), F.lit(every))
    runs = F.transform(starts, lambda i: running_sums(F.transform(F.slice(v, i, F.lit(every)), lambda x: x * x)))

    def power(runs: Column, i: Column) -> Column:
        run, at, first = F.floor(i / every).cast("int"), i % every + 1, i % every + 1 - window
        own = lambda r: F.get(r, at) - F.get(r, F.greatest(F.lit(0), first))
        tail = lambda r: F.element_at(r, -1) - F.get(r, first + every)
        before = F.when((first < 0) & (run > 0), let(F.get(runs, run - 1), tail)).otherwise(F.lit(0.0))
        # Sums that cancel can leave a trace below zero.
        return F.greatest(F.lit(0.0), let(F.get(runs, run), own) + before) / float(window)

    return let(runs, lambda r: F.transform(v, lambda _, i: power(r, i)))


def nonsilent_region(v: Column, cutoff_db: float = -60.0, reference: float = 0.0, window: int = 3, reset: int = 8192) -> Column:
    """(begin, length) between the first and last window whose mean power is above the cutoff.

    The power of a window is averaged over its ``window`` samples, those before
    the start counting 0. A ``reference`` of 0 takes the loudest window's power.
    All silent: (0, 0). Time is in proportion to the samples, whatever the window.
    """
    none = F.struct(F.lit(0).alias("begin"), F.lit(0).alias("length"))

    def region(loud: Column) -> Column:
        begin = F.greatest(F.lit(0), F.array_min(loud) - (window - 1))
        return F.when(F.size(loud) > 0, F.struct(begin.alias("begin"), (F.array_max(loud) - begin + 1).alias("length"))).otherwise(none)

    def places(p: Column) -> Column:
        base = _num(reference) if reference else F.array_max(p)
        above = lambda least: F.filter(F.transform(p, lambda x, i: F.when((x >= least) & (x > 0), i)), lambda i: i.isNotNull())
        return let(base * 10.0 ** (cutoff_db / 10.0), above)

    return let(moving_power(v, window, reset), lambda p: let(places(p), region))


def frames(v: Column, window: int, step: int) -> Column:
    """Overlapping frames; samples that fill no frame are left out."""
    count = F.floor((F.size(v) - window) / step) + 1
    at = F.when(F.size(v) >= window, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(at, lambda k: F.slice(v, k * step + 1, F.lit(window)))


def hann(n: int) -> list[float]:
    return [0.5 - 0.5 * math.cos(2 * math.pi * i / n) for i in range(n)]


def spectrogram(v: Column, nfft: int, window: int, step: int, power: int = 2) -> Column:
    """|DFT| ** power of Hann-windowed frames, nfft // 2 + 1 bins by frame, uncentred.

    The sums are written out, which suits short frames; ``operators.spectral``
    has the FFT for long ones.
    """
    shape = F.array(*(F.lit(x) for x in hann(window)))
    bins = F.sequence(F.lit(0), F.lit(nfft // 2))
    turn = 2.0 * math.pi / nfft

    def spectrum(frame: Column) -> Column:
        part = lambda f, x, k: F.aggregate(F.transform(x, lambda y, i: y * f(i * k * turn)), F.lit(0.0), lambda a, y: a + y)
        squared = lambda x, k: let(F.struct(part(F.cos, x, k).alias("re"), part(F.sin, x, k).alias("im")), lambda z: z["re"] * z["re"] + z["im"] * z["im"])
        level = (lambda x, k: squared(x, k)) if power == 2 else (lambda x, k: F.sqrt(squared(x, k)))
        return let(F.zip_with(frame, shape, lambda x, k: x * k), lambda x: F.transform(bins, lambda k: level(x, k)))

    return F.transform(frames(v, window, step), spectrum)


def mel_points(low: float, high: float, filters: int, formula: str = "slaney") -> list[float]:
    """filters + 2 frequencies, evenly spaced on the mel scale."""
    if formula == "htk":
        to = lambda f: 2595.0 * math.log10(1 + f / 700.0)
        back = lambda m: 700.0 * (10 ** (m / 2595.0) - 1)
    else:  # linear below 1 kHz, logarithmic above
        step, knee = math.log(6.4) / 27.0, 1000.0
        to = lambda f: f * 3 / 200 if f < knee else 15 + math.log(f / knee) / step
        back = lambda m: m * 200 / 3 if m < 15 else knee * math.exp(step * (m - 15))
    a, b = to(low), to(high)
    return [back(a + (b - a) * i / (filters + 1)) for i in range(filters + 2)]


def mel_weights(nfft: int, rate: float, filters: int, low: float = 0.0, high: float | None = None, formula: str = "slaney", normalize: bool = True) -> list[list[float]]:
    """Triangular filters over the bins; normalised ones have unit area."""
    points = mel_points(low, high or rate / 2, filters, formula)
    out = []
    for a, b, c in zip(points, points[1:], points[2:]):
        row = [max(0.0, min((k * rate / nfft - a) / (b - a), (c - k * rate / nfft) / (c - b))) for k in range(nfft // 2 + 1)]
        out.append([x * 2.0 / (c - a) for x in row] if normalize else row)
    return out


def mel_filter_bank(spectra: Column, weights: list[list[float]]) -> Column:
    """For each frame the dot products of its bins with the filters."""
    bank = F.array(*(F.array(*(F.lit(x) for x in row)) for row in weights))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.transform(spectra, lambda s: F.transform(bank, lambda row: dot(s, row)))


def resample_linear(v: Column, rate_in, rate_out) -> Column:
    """Linear interpolation to another rate; ceil(n * out / in) samples. ``operators.spectral`` has the sinc filter."""
    ratio = _num(rate_in) / _num(rate_out)
    n = F.ceil(F.size(v) / ratio).cast("int")

    def one(i: Column) -> Column:
        at = F.least(F.size(v) - 1.0, i * ratio)
        lo = F.floor(at).cast("int")
        return F.get(v, lo) * (1 - (at - lo)) + F.get(v, F.least(F.size(v) - 1, lo + 1)) * (at - lo)

    return F.transform(F.sequence(F.lit(0), n - 1), one)
