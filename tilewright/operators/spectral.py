"""FFT spectrogram and sinc resampling, Arrow-batched."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mapped(df: DataFrame, key: str, values: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [f(v.values.to_numpy(zero_copy_only=False).astype(float)) if v.is_valid else None for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=[key, values])

    return df.select(F.col(key).cast("long").alias(key), F.col(values).cast("array<double>").alias(values)).mapInArrow(run, f"`{key}` long, `{values}` array<double>")


def spectrogram(df: DataFrame, key: str, values: str, nfft: int = 512, window: int = 512, step: int = 256, power: int = 2, center: bool = True, reflect: bool = True, shape: list[float] | None = None) -> DataFrame:
    """Frames by bins, flat; ``center`` pads half a window on either side. ``shape`` replaces the Hann window."""
    taper = np.asarray(shape) if shape is not None else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)

    def one(x: np.ndarray) -> np.ndarray:
        if center:
            x = np.pad(x, window // 2, mode="reflect" if reflect and len(x) > window // 2 else "constant")
        if len(x) < window:
            return np.empty(0)
        spectrum = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, window)[::step] * taper, nfft, axis=1))
        return (spectrum**power).ravel()

    return _mapped(df, key, values, one)


def resample(df: DataFrame, key: str, values: str, rate_in, rate_out, quality: float = 50.0) -> DataFrame:
    """Hann-windowed sinc interpolation; ``quality`` sets the number of lobes. Rates are numbers, or columns that give each sample its own."""
    lobes = max(3, math.ceil((0.007 * quality - 0.09) * quality + 3))

    def one(x: np.ndarray, ratio: float) -> np.ndarray:
        cut = min(1.0, 1.0 / ratio)
        reach = lobes / cut
        n = math.ceil(len(x) / ratio)
        at = np.arange(n) * ratio
        idx = np.floor(at).astype(int)[:, None] + np.arange(-math.ceil(reach) + 1, math.ceil(reach) + 1)
        d = at[:, None] - idx
        k = np.where(np.abs(d) < reach, cut * np.sinc(d * cut) * (0.5 + 0.5 * np.cos(np.pi * d / reach)), 0.0)
        ok = (idx >= 0) & (idx < len(x))
        return (np.where(ok, x[np.clip(idx, 0, max(0, len(x) - 1))], 0.0) * k).sum(axis=1) if len(x) else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                one(v.values.to_numpy(zero_copy_only=False).astype(float), r.as_py()) if v.is_valid and r.is_valid else None
                for v, r in zip(batch.column(1), batch.column(2))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=[key, values])

    as_column = lambda r: (r if isinstance(r, Column) else F.lit(r)).cast("double")
    rows = df.select(F.col(key).cast("long").alias(key), F.col(values).cast("array<double>").alias(values), (as_column(rate_in) / as_column(rate_out)).alias("_ratio"))
    return rows.mapInArrow(run, f"`{key}` long, `{values}` array<double>")
