"""Tensor, audio and box operators on the ``embeddings`` table: each vector is an 8 x 8 image or a signal of 64 samples."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import audio as A
from tilewright.functions import boxes as B
from tilewright.functions import tensor as T
from tilewright.operators import batches as BT
from tilewright.operators import matching as M

H = W = 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_DOUBLES = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_PIXELS = "list_transform(embedding, lambda x: greatest(0.0, least(255.0, floor((CAST(x AS DOUBLE) + 0.5) * 255.0))))"


def vectors(spark: SparkSession, sf_dir: str, pixels: bool) -> DataFrame:
    """(vec_id, label, v, u): the values and a second tensor, the first reversed."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = T.pixels(F.col("embedding")) if pixels else F.transform("embedding", lambda x: x.cast("double"))
    return e.select("vec_id", "label", v.alias("v")).select("*", F.reverse("v").alias("u"))


def long_form(df: DataFrame, out: Column, digits: int = 6) -> DataFrame:
    return df.select("vec_id", F.posexplode(out).alias("idx", "_x")).select("vec_id", "idx", (F.round(F.col("_x").cast("double"), digits) + 0.0).alias("value"))


def tensor(name: str, out: Callable[[], Column], sql: str, pixels: bool = True, digits: int = 6) -> None:
    """Registers an operator whose output is an array, compared element by element."""
    QUERIES[name] = lambda spark, d: long_form(vectors(spark, d, pixels), out(), digits)
    ORACLES[name] = f"""
        WITH e AS (SELECT vec_id, label, {_PIXELS if pixels else _DOUBLES} AS v FROM embeddings),
        p AS (SELECT *, list_reverse(v) AS u FROM e),
        o AS (SELECT vec_id, {sql} AS o FROM p)
        SELECT vec_id, CAST(i AS INT) AS idx, round(CAST(o[i + 1] AS DOUBLE), {digits}) + 0.0::DOUBLE AS value
        FROM (SELECT vec_id, o, unnest(range(0, len(o))) AS i FROM o)"""


def _u8(x: str) -> str:
    return f"greatest(0.0, least(255.0, floor(({x}) + 0.5)))"


def _map(x: str, v: str = "v") -> str:
    return f"list_transform({v}, lambda x, i: {x})"


def _gather(n: int, index: str) -> str:
    """Elements by a zero-based index; ``i`` is the zero-based place in the output."""
    return f"list_transform(range(0, {n}), lambda i: v[CAST({index} AS BIGINT) + 1])"


v = lambda: F.col("v")
u = lambda: F.col("u")

tensor("brightness", lambda: T.brightness(v(), 1.2, 10.0), _map(_u8("x * 1.2 + 10")))
tensor("contrast", lambda: T.contrast(v(), 1.5, 100.0), _map(_u8("(x - 100) * 1.5 + 100")))
tensor("gamma", lambda: T.gamma(v(), 0.7), _map(_u8("pow(x / 255.0, 0.7) * 255.0")))
tensor("exposure", lambda: T.exposure(v(), 0.5), _map(_u8("x * pow(2.0, 0.5)")))
tensor("fog", lambda: T.fog(v(), 0.25, 0.8), _map(_u8("x * 0.75 + 51")))
tensor("color_temperature", lambda: T.color_temperature(v(), 20, 4), _map(_u8("x + CASE (i - 1) % 4 WHEN 0 THEN 20 WHEN 2 THEN -20 ELSE 0 END")))
tensor("vignette", lambda: T.vignette(v(), H, W, 3.0), _map(_u8("x * exp(-(pow((i - 1) // 8 - 3.5, 2) + pow((i - 1) % 8 - 3.5, 2)) / 18.0)")))
tensor("blend", lambda: T.blend(v(), u(), 0.3), "list_transform(range(1, 65), lambda i: 0.3 * v[i] + (1.0 - 0.3) * u[i])")
tensor("add_tensor", lambda: T.add(v(), u()), "list_transform(range(1, 65), lambda i: v[i] + u[i])", False)
tensor("mul_scalar", lambda: T.scale(v(), 2.5), _map("x * 2.5"), False)
tensor("log1p", lambda: T.log1p(F.transform(v(), F.abs)), _map("ln(1 + abs(x))"), False)
tensor("copy", v, "v", False)
tensor("color_twist", lambda: T.contrast(T.brightness(v(), 1.1, 5.0), 0.8, 128.0), _map(_u8("(x - 128) * 0.8 + 128"), _map(_u8("x * 1.1 + 5"))))
tensor("to_tensor", lambda: T.to_tensor(v(), [0.5, 0.25], [1.0, 2.0], True), "list_transform(range(0, 64), lambda i: CASE i % 2 WHEN 0 THEN 1.0 + 0.5 * v[i + 2] ELSE 2.0 + 0.25 * v[i] END)")
tensor("to_planes", lambda: T.to_planes(v(), 8, 4, 2), _gather(64, "(i % 32) * 2 + i // 32"))
tensor("crop", lambda: T.crop(v(), W, 2, 1, 4, 5), _gather(20, "(2 + i // 5) * 8 + 1 + i % 5"))
tensor("center_crop", lambda: T.center_crop(v(), H, W, 5, 3), _gather(15, "(2 + i // 3) * 8 + 2 + i % 3"))
tensor("flip_h", lambda: T.flip(v(), H, W, 1, 0), _gather(64, "(i // 8) * 8 + 7 - i % 8"))
tensor("flip_v", lambda: T.flip(v(), H, W, 0, 1), _gather(64, "(7 - i // 8) * 8 + i % 8"))
tensor("flip_flagged", lambda: T.flip(v(), H, W, F.col("label") % 2, F.col("label") % 3 % 2), "list_transform(range(0, 64), lambda i: v[CAST(CASE WHEN label % 3 % 2 = 1 THEN 7 - i // 8 ELSE i // 8 END * 8 + CASE WHEN label % 2 = 1 THEN 7 - i % 8 ELSE i % 8 END AS BIGINT) + 1])")
tensor("transpose", lambda: T.transpose(v(), H, W), _gather(64, "(i % 8) * 8 + i // 8"))
tensor("permute", lambda: T.permute(v(), [4, 8, 2], [2, 0, 1]), _gather(64, "((i // 8) % 4) * 16 + (i % 8) * 2 + i // 32"))
tensor("sequence_rearrange", lambda: F.flatten(T.sequence_rearrange(T.rows(v(), 8, 8), [7, 0, 0, 3])), _gather(32, "[7, 0, 0, 3][i // 8 + 1] * 8 + i % 8"))
tensor("slice_pad", lambda: T.slice_pad(v(), 60, 8, 9.0), "list_transform(range(60, 68), lambda i: CASE WHEN i < 64 THEN v[i + 1] ELSE 9.0 END)")
tensor("slice_trim", lambda: T.slice_pad(v(), 60, 8, policy="trim"), "v[61:64]")
# A vector as 4 x 8 pixels of two channels, cut along all three axes.
_CUT = lambda y, x, c: f"CASE WHEN {y} BETWEEN 0 AND 3 AND {x} BETWEEN 0 AND 7 AND {c} BETWEEN 0 AND 1 THEN v[CAST(({y} * 8 + {x}) * 2 + {c} AS BIGINT) + 1] ELSE -1 END"
tensor("slice_axes", lambda: T.slice_axes(v(), [4, 8, 2], [1, F.col("label") % 4, 0], [2, 3, 1]), f"list_transform(range(0, 6), lambda i: {_CUT('(1 + i // 3)', '(label % 4 + i % 3)', '0')})")
tensor("slice_axes_pad", lambda: T.slice_axes(v(), [4, 8, 2], [-1, 5, F.col("label") % 2], [3, 4, 2], -1.0, "pad"), f"list_transform(range(0, 24), lambda i: {_CUT('(i // 8 - 1)', '(5 + i // 2 % 4)', '(label % 2 + i % 2)')})")
tensor("slice_axes_trim", lambda: T.slice_axes(v(), [4, 8, 2], [-1, 6, 0], [3, 4, 2], policy="trim"), f"list_transform(range(0, 8), lambda i: {_CUT('(i // 4)', '(6 + i // 2 % 2)', '(i % 2)')})")
tensor("resize_nearest", lambda: T.resize_nearest(v(), H, W, 5, 3), _gather(15, "least(7, floor((i // 3 + 0.5) * (8 / 5.0))) * 8 + least(7, floor((i % 3 + 0.5) * (8 / 3.0)))"))
_FY, _FX = "greatest(0.0, least(7.0, (i // 12 + 0.5) * (8 / 6.0) - 0.5))", "greatest(0.0, least(7.0, (i % 12 + 0.5) * (8 / 12.0) - 0.5))"
_P = lambda y, x: f"v[CAST(least(7, floor({_FY}) + {y}) * 8 + least(7, floor({_FX}) + {x}) AS BIGINT) + 1]"
_DX, _DY = f"({_FX} - floor({_FX}))", f"({_FY} - floor({_FY}))"
tensor("resize_bilinear", lambda: T.resize_bilinear(v(), H, W, 6, 12), f"list_transform(range(0, 72), lambda i: ({_P(0, 0)} * (1 - {_DX}) + {_P(0, 1)} * {_DX}) * (1 - {_DY}) + ({_P(1, 0)} * (1 - {_DX}) + {_P(1, 1)} * {_DX}) * {_DY})")
tensor("pixelate", lambda: T.pixelate(v(), H, W, 4), "list_transform(range(0, 64), lambda i: list_avg(list_transform(range(0, 16), lambda k: v[(i // 32 * 4 + k // 4) * 8 + i % 8 // 4 * 4 + k % 4 + 1])))")
tensor("blur", lambda: T.blur3(v(), H, W), "list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 9), lambda k: v[least(7, greatest(0, i // 8 + k // 3 - 1)) * 8 + least(7, greatest(0, i % 8 + k % 3 - 1)) + 1] * (2 - abs(k // 3 - 1)) * (2 - abs(k % 3 - 1)) / 16.0)))")
# Three and two channels: a vector as 4 x 8 pixels of two, its first 48 values as 4 x 4 pixels of three.
tensor("resize_nearest_channels", lambda: T.resize_nearest(v(), 4, 8, 3, 5, 2), _gather(30, "(least(3, floor((i // 10 + 0.5) * (4 / 3.0))) * 8 + least(7, floor((i // 2 % 5 + 0.5) * (8 / 5.0)))) * 2 + i % 2"))
_CY, _CX = "greatest(0.0, least(3.0, (i // 20 + 0.5) * (4 / 6.0) - 0.5))", "greatest(0.0, least(7.0, (i // 2 % 10 + 0.5) * (8 / 10.0) - 0.5))"
_CP = lambda y, x: f"v[CAST((least(3, floor({_CY}) + {y}) * 8 + least(7, floor({_CX}) + {x})) * 2 + i % 2 AS BIGINT) + 1]"
_CDX, _CDY = f"({_CX} - floor({_CX}))", f"({_CY} - floor({_CY}))"
tensor("resize_bilinear_channels", lambda: T.resize_bilinear(v(), 4, 8, 6, 10, 2), f"list_transform(range(0, 120), lambda i: ({_CP(0, 0)} * (1 - {_CDX}) + {_CP(0, 1)} * {_CDX}) * (1 - {_CDY}) + ({_CP(1, 0)} * (1 - {_CDX}) + {_CP(1, 1)} * {_CDX}) * {_CDY})")
tensor("blur_channels", lambda: T.blur3(v(), 4, 8, 2), "list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 9), lambda k: v[(least(3, greatest(0, i // 16 + k // 3 - 1)) * 8 + least(7, greatest(0, i // 2 % 8 + k % 3 - 1))) * 2 + i % 2 + 1] * (2 - abs(k // 3 - 1)) * (2 - abs(k % 3 - 1)) / 16.0)))")
tensor("pixelate_channels", lambda: T.pixelate(F.slice(v(), 1, 48), 4, 4, 3, 3), "list_transform(range(0, 48), lambda i: list_avg(list_transform(list_filter(range(0, 16), lambda k: k // 4 // 3 = i // 12 // 3 AND k % 4 // 3 = i // 3 % 4 // 3), lambda k: v[k * 3 + i % 3 + 1])))")
tensor("crop_mirror_normalize_channels", lambda: T.crop_mirror_normalize(F.slice(v(), 1, 48), 4, 4, 2, 3, F.col("label") % 2, [120.0, 110.0, 100.0], [60.0, 50.0, 40.0], 1.0, 0.0, 3), "list_transform(range(0, 18), lambda i: (v[CAST(((2 + i // 9) * 4 + CASE WHEN label % 2 = 1 THEN 2 - i // 3 % 3 ELSE i // 3 % 3 END) * 3 + i % 3 AS BIGINT) + 1] - [120, 110, 100][i % 3 + 1]) / [60, 50, 40][i % 3 + 1])")
tensor("resize_mirror_normalize_channels", lambda: T.resize_mirror_normalize(F.slice(v(), 1, 48), 4, 4, 2, 2, 1, [120.0, 110.0, 100.0], [60.0, 50.0, 40.0], 3, "nearest"), "list_transform(range(0, 12), lambda i: (v[CAST(((i // 6 * 2 + 1) * 4 + (1 - i // 3 % 2) * 2 + 1) * 3 + i % 3 AS BIGINT) + 1] - [120, 110, 100][i % 3 + 1]) / [60, 50, 40][i % 3 + 1])")
tensor("resize_crop_mirror_channels", lambda: T.resize_crop_mirror(v(), 4, 8, 4, 8, 2, 3, F.col("label") % 2, 2, F.col("label") / 9.0, F.col("vec_id") % 5 / 4.0, "nearest"), "list_transform(range(0, 12), lambda i: v[CAST(((CAST(round_even(label / 9.0::DOUBLE * 2, 0) AS BIGINT) + i // 6) * 8 + CAST(round_even(vec_id % 5 / 4.0::DOUBLE * 5, 0) AS BIGINT) + CASE WHEN label % 2 = 1 THEN 2 - i // 2 % 3 ELSE i // 2 % 3 END) * 2 + i % 2 AS BIGINT) + 1])")
tensor("crop_resize_fixed", lambda: T.crop_resize_fixed(v(), H, W, 2, 2, 0.25, 1.0, 1.0, -1.0), "list_transform(range(0, 4), lambda i: (v[i // 2 * 16 + 4 + i % 2 * 2 + 1] + v[i // 2 * 16 + 4 + i % 2 * 2 + 2] + v[i // 2 * 16 + 8 + 4 + i % 2 * 2 + 1] + v[i // 2 * 16 + 8 + 4 + i % 2 * 2 + 2]) / 4)")


def _kernel(name: str, sql: str, reach: int) -> None:
    """8 x 8 pixels to 6 x 12 with a kernel; ``sql`` is the kernel of d."""
    QUERIES[f"resize_{name}"] = lambda spark, d: long_form(vectors(spark, d, True), T.resize(v(), H, W, 6, 12, 1, name), 4)
    one = lambda n, out: f"""(SELECT o, least(7, greatest(0, j)) AS j, k / sum(k) OVER (PARTITION BY o) AS k FROM (
        SELECT o, j, {sql} AS k FROM (SELECT o, j, (j - ((o + 0.5) * {n} / {out} - 0.5)) / greatest(1, {n} / {out}) AS d FROM range(0, {out}) a(o), range(-12, 24) b(j)) WHERE abs(d) <= {reach}))"""  # noqa: E731
    ORACLES[f"resize_{name}"] = f"""
        WITH e AS (SELECT vec_id, {_PIXELS} AS v FROM embeddings),
        x AS {one("8.0::DOUBLE", "12")}, y AS {one("8.0::DOUBLE", "6")}
        SELECT vec_id, CAST(y.o * 12 + x.o AS INT) AS idx, round(sum(v[y.j * 8 + x.j + 1] * y.k * x.k), 4) + 0.0::DOUBLE AS value FROM e, x, y GROUP BY vec_id, y.o, x.o"""


_SINC = lambda t: f"CASE WHEN {t} = 0 THEN 1 ELSE sin(pi() * {t}) / (pi() * {t}) END"
_kernel("triangular", "1 - abs(d)", 1)
_kernel("cubic", "CASE WHEN abs(d) < 1 THEN 1.5 * pow(abs(d), 3) - 2.5 * d * d + 1 ELSE -0.5 * pow(abs(d), 3) + 2.5 * d * d - 4 * abs(d) + 2 END", 2)
_kernel("lanczos", f"{_SINC('d')} * {_SINC('(d / 3)')}", 3)
_kernel("gaussian", "exp(-2 * d * d)", 2)

_AXES = lambda part: f"list_transform(range(0, 64), lambda i: (v[i + 1] - list_avg({part})) / sqrt(list_avg(list_transform({part}, lambda z: (z - list_avg({part})) * (z - list_avg({part}))))) * 2 + 1)"
tensor("normalize_axis_0", lambda: T.normalize_axes(v(), [4, 8, 2], [0], scale_by=2.0, shift=1.0), _AXES("list_transform(range(0, 4), lambda k: v[k * 16 + i % 16 + 1])"), False, 5)
tensor("normalize_axes_0_1", lambda: T.normalize_axes(v(), [4, 8, 2], [0, 1], scale_by=2.0, shift=1.0), _AXES("list_transform(range(0, 32), lambda k: v[k * 2 + i % 2 + 1])"), False, 5)
tensor("normalize_axes_0_2", lambda: T.normalize_axes(v(), [4, 8, 2], [0, 2], scale_by=2.0, shift=1.0), _AXES("list_transform(range(0, 8), lambda k: v[k // 2 * 16 + i // 2 % 8 * 2 + k % 2 + 1])"), False, 5)
tensor("normalize_channels_given", lambda: T.normalize_axes(v(), [4, 8, 2], [0, 1], [0.1, -0.1], [0.5, 0.25]), "list_transform(range(0, 64), lambda i: (v[i + 1] - [0.1, -0.1][i % 2 + 1]) / [0.5, 0.25][i % 2 + 1])", False)

_MEAN, _STD = "list_avg(v)", "sqrt(list_avg(list_transform(v, lambda y: (y - list_avg(v)) * (y - list_avg(v)))))"
tensor("normalize_all", lambda: T.normalize(v(), scale_by=2.0, shift=1.0), _map(f"(x - {_MEAN}) / {_STD} * 2.0 + 1.0"), False, 5)
tensor("normalize_given", lambda: T.normalize(v(), 0.1, 0.5), _map("(x - 0.1) / 0.5"), False)
tensor("normalize_mean_given", lambda: T.normalize(v(), 0.1), _map("(x - 0.1) / sqrt(list_avg(list_transform(v, lambda y: (y - 0.1) * (y - 0.1))))"), False)
_ROW = "v[(i // 8) * 8 + 1:(i // 8) * 8 + 8]"
tensor("normalize_rows", lambda: T.normalize_rows(v(), H, W), f"list_transform(range(0, 64), lambda i: (v[i + 1] - list_avg({_ROW})) / sqrt(list_avg(list_transform({_ROW}, lambda y: (y - list_avg({_ROW})) * (y - list_avg({_ROW}))))))", False, 5)
tensor("crop_mirror_normalize", lambda: T.crop_mirror_normalize(v(), H, W, 4, 4, F.col("label") % 2, 100.0, 50.0), "list_transform(range(0, 16), lambda i: (v[CAST((2 + i // 4) * 8 + 2 + CASE WHEN label % 2 = 1 THEN 3 - i % 4 ELSE i % 4 END AS BIGINT) + 1] - 100.0) / 50.0)")
tensor("resize_mirror_normalize", lambda: T.normalize(T.flip(T.resize_nearest(v(), H, W, 4, 4), 4, 4, 1), 100.0, 50.0), "list_transform(range(0, 16), lambda i: (v[CAST(least(7, floor((i // 4 + 0.5) * 2)) * 8 + least(7, floor((3 - i % 4 + 0.5) * 2)) AS BIGINT) + 1] - 100.0) / 50.0)")
tensor("roi_resize", lambda: T.roi_resize(v(), W, 2, 1, 4, 4, 2, 2), "list_transform(range(0, 4), lambda i: (v[(2 + i // 2 * 2) * 8 + 1 + i % 2 * 2 + 1] + v[(2 + i // 2 * 2) * 8 + 2 + i % 2 * 2 + 1] + v[(3 + i // 2 * 2) * 8 + 1 + i % 2 * 2 + 1] + v[(3 + i // 2 * 2) * 8 + 2 + i % 2 * 2 + 1]) / 4)")
tensor("resize_crop_mirror", lambda: T.resize_crop_mirror(v(), H, W, 4, 4, 2, 2, 1), "list_transform(range(0, 4), lambda i: (v[(2 + i // 2 * 2) * 8 + 2 + (1 - i % 2) * 2 + 1] + v[(2 + i // 2 * 2) * 8 + 3 + (1 - i % 2) * 2 + 1] + v[(3 + i // 2 * 2) * 8 + 2 + (1 - i % 2) * 2 + 1] + v[(3 + i // 2 * 2) * 8 + 3 + (1 - i % 2) * 2 + 1]) / 4)")
tensor("one_hot", lambda: T.one_hot(F.col("label"), 10), "list_transform(range(0, 10), lambda i: CASE WHEN i = (label + 9) % 10 THEN 1 ELSE 0 END)")

for _border, _first in (("zero", "0"), ("clamp", "v[1]"), ("reflect", "v[2]")):
    tensor(f"preemphasis_{_border}", lambda b=_border: A.preemphasis(v(), 0.97, b), _map(f"x - 0.97 * CASE WHEN i = 1 THEN {_first} ELSE v[i - 1] END"), False)
tensor("to_decibels", lambda: A.to_decibels(F.transform(v(), F.abs), 10.0, 1.0, -30.0), _map("10.0 * log10(greatest(0.001, abs(x)))"), False)
tensor("downmix", lambda: A.downmix(T.rows(v(), 32, 2)), "list_transform(range(0, 32), lambda i: (v[2 * i + 1] + v[2 * i + 2]) / 2)", False)
tensor("resample_linear", lambda: A.resample_linear(v(), 4, 3), "list_transform(range(0, 48), lambda i: v[CAST(floor(least(63.0, i * 4 / 3.0)) AS BIGINT) + 1] * (1 - (least(63.0, i * 4 / 3.0) - floor(least(63.0, i * 4 / 3.0)))) + v[least(63, CAST(floor(least(63.0, i * 4 / 3.0)) AS BIGINT) + 1) + 1] * (least(63.0, i * 4 / 3.0) - floor(least(63.0, i * 4 / 3.0))))", False)
_TURN = 2 * math.pi / 16
_PART = lambda f, frame, k: f"list_sum(list_transform(range(0, 16), lambda t: v[{frame} * 8 + t + 1] * (0.5 - 0.5 * cos({_TURN!r} * t)) * {f}(t * {k} * {_TURN!r})))"
_POWER = lambda frame, k: f"pow({_PART('cos', frame, k)}, 2) + pow({_PART('sin', frame, k)}, 2)"
tensor("spectrogram", lambda: F.flatten(A.spectrogram(v(), 16, 16, 8)), f"list_transform(range(0, 63), lambda i: {_POWER('(i // 9)', '(i % 9)')})", False)
_BANK = A.mel_weights(16, 16000.0, 4)
_BANK_SQL = "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in r) + "]" for r in _BANK) + "]"
tensor("mel_filter_bank", lambda: F.flatten(F.transform(A.mel_filter_bank(A.spectrogram(v(), 16, 16, 8), _BANK), lambda r: T.scale(r, 1000.0))), f"list_transform(range(0, 28), lambda i: 1000.0 * list_sum(list_transform(range(0, 9), lambda k: {_BANK_SQL}[i % 4 + 1][k + 1] * ({_POWER('(i // 4)', 'k')}))))", False)


def _nonsilent(spark: SparkSession, d: str) -> DataFrame:
    r = A.nonsilent_region(v(), -3.0, 0.0, 4)
    return vectors(spark, d, False).select("vec_id", r.alias("r")).select("vec_id", "r.begin", "r.length")


QUERIES["nonsilent_region"] = _nonsilent
ORACLES["nonsilent_region"] = f"""
    WITH e AS (SELECT vec_id, {_DOUBLES} AS v FROM embeddings),
    p AS (SELECT vec_id, list_transform(range(0, 64), lambda i: list_sum(list_transform(v[greatest(1, i - 2):i + 1], lambda x: x * x)) / 4.0) AS p FROM e),
    l AS (SELECT vec_id, list_filter(range(0, 64), lambda i: p[i + 1] >= list_max(p) * pow(10.0, -0.3) AND p[i + 1] > 0) AS l FROM p)
    SELECT vec_id, CAST(greatest(0, list_min(l) - 3) AS INT) AS begin, CAST(list_max(l) - greatest(0, list_min(l) - 3) + 1 AS INT) AS length FROM l"""

tensor("resize_mirror_masks", lambda: F.flatten(F.flatten(B.resize_mirror_masks(F.transform(T.rows(v(), 4, 16), lambda r: F.array(F.slice(r, 1, 6), F.slice(r, 7, 10))), 100, 80, 50, 160, F.col("label") % 2))), "list_transform(range(0, 64), lambda i: CASE WHEN i % 2 = 1 THEN v[i + 1] * 2 WHEN label % 2 = 1 THEN 50 - v[i + 1] * 0.5 - 1 ELSE v[i + 1] * 0.5 END)")


# --- boxes: three of them from the first twelve values of a vector, in a 100 x 100 image ---


def boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, boxes, labels)."""
    e = vectors(spark, sf_dir, False)
    at = lambda k: F.abs(F.get("v", F.lit(k))) * 200.0
    one = lambda k: B.box(at(k), at(k + 1), at(k) + at(k + 2) + 5.0, at(k + 1) + at(k + 3) + 5.0)
    return e.select("vec_id", "label", F.array(one(0), one(4), one(8)).alias("boxes"), F.array(*(F.col("label") + i for i in range(3))).alias("labels"))


_BOX = lambda k: f"{{'l': abs(v[{k + 1}]) * 200.0, 't': abs(v[{k + 2}]) * 200.0, 'r': abs(v[{k + 1}]) * 200.0 + abs(v[{k + 3}]) * 200.0 + 5.0, 'b': abs(v[{k + 2}]) * 200.0 + abs(v[{k + 4}]) * 200.0 + 5.0}}"
_BOXED = f"""
    e AS (SELECT vec_id, label, {_DOUBLES} AS v FROM embeddings),
    x AS (SELECT vec_id, label, unnest([0, 1, 2]) AS box_id, unnest([{_BOX(0)}, {_BOX(4)}, {_BOX(8)}]) AS x FROM e),
    bx AS (SELECT vec_id, label AS flag, box_id, label + box_id AS label, x.l AS l, x.t AS t, x.r AS r, x.b AS b FROM x)"""


def _boxes_out(df: DataFrame) -> DataFrame:
    """struct(boxes, labels) as rows."""
    return df.select("vec_id", F.posexplode(F.arrays_zip("o.boxes", "o.labels")).alias("idx", "_p")).select(
        "vec_id", "idx", F.col("_p.labels").alias("label"), *(F.round(f"_p.boxes.{c}", 4).alias(c) for c in "ltrb")
    )


def box_query(name: str, out: Callable[[], Column], change: str, keep: str = "TRUE", dummy: str = "0, 0, 1, 1") -> None:
    """``change``: the four coordinates; ``keep``: the test; both in SQL over one box."""
    QUERIES[name] = lambda spark, d: _boxes_out(boxed(spark, d).select("vec_id", out().alias("o")))
    ORACLES[name] = f"""
        WITH {_BOXED},
        k AS (SELECT vec_id, box_id, label, {change} FROM bx WHERE {keep}),
        n AS (SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY box_id) - 1 AS INT) AS idx, label, nl, nt, nr, nb FROM k
            UNION ALL SELECT q.vec_id, 0, 0, d.* FROM (SELECT vec_id FROM e WHERE vec_id NOT IN (SELECT vec_id FROM k)) q, (VALUES ({dummy})) d)
        SELECT vec_id, idx, CAST(label AS INT) AS label, round(CAST(nl AS DOUBLE), 4) AS l, round(CAST(nt AS DOUBLE), 4) AS t, round(CAST(nr AS DOUBLE), 4) AS r, round(CAST(nb AS DOUBLE), 4) AS b FROM n"""


def _both(boxes: Column) -> Column:
    return F.struct(boxes.alias("boxes"), F.col("labels").alias("labels"))


_C = lambda: (F.col("boxes"), F.col("labels"))
_IN = lambda x, y, w, h: f"greatest(0, least(r, {x + w}) - greatest(l, {x})) * greatest(0, least(b, {y + h}) - greatest(t, {y})) / ((r - l) * (b - t)) >= 0.25"
box_query("resize_boxes", lambda: _both(B.resize(F.col("boxes"), 100, 100, 50, 200)), "l * 0.5 AS nl, t * 2 AS nt, r * 0.5 AS nr, b * 2 AS nb")
box_query("flip_boxes", lambda: _both(B.flip(F.col("boxes"), 100, 100, F.col("label") % 2, 1)), "CASE WHEN flag % 2 = 1 THEN 100 - r ELSE l END AS nl, 100 - b AS nt, CASE WHEN flag % 2 = 1 THEN 100 - l ELSE r END AS nr, 100 - t AS nb")
box_query("crop_boxes", lambda: B.crop(*_C(), 20, 20, 30, 40), "greatest(l, 20) - 20 AS nl, greatest(t, 20) - 20 AS nt, least(r, 50) - 20 AS nr, least(b, 60) - 20 AS nb", _IN(20, 20, 30, 40), "0, 0, 30, 40")
box_query("crop_mirror_boxes", lambda: B.crop(*_C(), 20, 20, 30, 40, F.col("label") % 2), "CASE WHEN flag % 2 = 1 THEN 50 - least(r, 50) ELSE greatest(l, 20) - 20 END AS nl, greatest(t, 20) - 20 AS nt, CASE WHEN flag % 2 = 1 THEN 50 - greatest(l, 20) ELSE least(r, 50) - 20 END AS nr, least(b, 60) - 20 AS nb", _IN(20, 20, 30, 40), "0, 0, 30, 40")
box_query("crop_resize_boxes", lambda: B.crop(*_C(), 20, 20, 30, 40, 0, 60, 20), "(greatest(l, 20) - 20) * 2 AS nl, (greatest(t, 20) - 20) * 0.5 AS nt, (least(r, 50) - 20) * 2 AS nr, (least(b, 60) - 20) * 0.5 AS nb", _IN(20, 20, 30, 40), "0, 0, 60, 20")
box_query("resize_crop_mirror_boxes", lambda: B.crop(*_C(), 10, 10, 50, 50, 1, 25, 25), "(60 - least(r, 60)) * 0.5 AS nl, (greatest(t, 10) - 10) * 0.5 AS nt, (60 - greatest(l, 10)) * 0.5 AS nr, (least(b, 60) - 10) * 0.5 AS nb", _IN(10, 10, 50, 50), "0, 0, 25, 25")
box_query("resize_mirror_boxes", lambda: _both(B.resize_mirror(F.col("boxes"), 100, 100, 50, 50, F.col("label") % 2)), "CASE WHEN flag % 2 = 1 THEN 50 - r * 0.5 - 1 ELSE l * 0.5 END AS nl, t * 0.5 AS nt, CASE WHEN flag % 2 = 1 THEN 50 - l * 0.5 - 1 ELSE r * 0.5 END AS nr, b * 0.5 AS nb")
box_query("bbox_crop_update", lambda: B.centre_crop_update(*_C(), B.box(10, 10, 40, 40)), "greatest(l, 10) - 10 AS nl, greatest(t, 10) - 10 AS nt, least(r, 40) - 10 AS nr, least(b, 40) - 10 AS nb", "(l + r) / 2 > 10 AND (l + r) / 2 < 40 AND (t + b) / 2 > 10 AND (t + b) / 2 < 40", "0, 0, 0, 0")
_IOU40 = "greatest(0, least(r, 60) - greatest(l, 0)) * greatest(0, least(b, 60) - greatest(t, 0))"
box_query("ssd_crop_update", lambda: B.ssd_crop_update(*_C(), B.box(0, 0, 60, 60), 0.05, 0.9), "greatest(l, 0) / 60 AS nl, greatest(t, 0) / 60 AS nt, least(r, 60) / 60 AS nr, least(b, 60) / 60 AS nb", f"(l + r) / 2 BETWEEN 0 AND 60 AND (t + b) / 2 BETWEEN 0 AND 60 AND ({_IOU40}) / ((r - l) * (b - t) + 3600 - ({_IOU40})) BETWEEN 0.05 AND 0.9", "0, 0, 1, 1")
_COS, _SIN = math.cos(-math.pi / 6), math.sin(-math.pi / 6)
_RX = lambda x, y: f"({_COS!r} * ({x} - 50) + {_SIN!r} * ({y} - 50) + 50)"
_RY = lambda x, y: f"(-({_SIN!r}) * ({x} - 50) + {_COS!r} * ({y} - 50) + 50)"
_CORNERS = [(x, y) for x in "lr" for y in "tb"]
_HULL = [f"{f}({', '.join(g(*c) for c in _CORNERS)})" for f, g in (("least", _RX), ("least", _RY), ("greatest", _RX), ("greatest", _RY))]
box_query("rotate_boxes", lambda: B.rotate(*_C(), 100, 100, 100, 100, 30), f"greatest({_HULL[0]}, 0) AS nl, greatest({_HULL[1]}, 0) AS nt, least({_HULL[2]}, 100) AS nr, least({_HULL[3]}, 100) AS nb", f"greatest(0, least({_HULL[2]}, 100) - greatest({_HULL[0]}, 0)) * greatest(0, least({_HULL[3]}, 100) - greatest({_HULL[1]}, 0)) / (({_HULL[2]} - {_HULL[0]}) * ({_HULL[3]} - {_HULL[1]})) >= 0.25", "0, 0, 100, 100")

ANCHORS = [(x, y, x + 30, y + 30) for y in range(0, 80, 20) for x in range(0, 80, 20)]
_PAIRS = f"""
    {_BOXED},
    a AS (SELECT y * 4 + x AS anchor_id, x * 20.0 AS al, y * 20.0 AS tp, x * 20.0 + 30 AS ar, y * 20.0 + 30 AS ab FROM range(0, 4) ys(y), range(0, 4) xs(x)),
    i AS (SELECT *, greatest(0.0, least(r, ar) - greatest(l, al)) * greatest(0.0, least(b, ab) - greatest(t, tp)) AS inter FROM bx, a),
    pr AS (SELECT *, inter / ((r - l) * (b - t) + 900 - inter) AS iou FROM i)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return M.pairs(boxed(spark, d), M.anchor_table(spark, ANCHORS), "vec_id")


QUERIES["box_iou_matrix"] = lambda spark, d: _pairs(spark, d).select("vec_id", "box_id", "anchor_id", F.round("iou", 6).alias("iou"))
ORACLES["box_iou_matrix"] = f"WITH {_PAIRS} SELECT vec_id, CAST(box_id AS INT) AS box_id, CAST(anchor_id AS INT) AS anchor_id, round(iou, 6) AS iou FROM pr"
QUERIES["iou_matcher"] = lambda spark, d: M.match(boxed(spark, d), ANCHORS, "vec_id", 0.5, 0.2).select("vec_id", F.posexplode("matches").alias("anchor_id", "match"))
ORACLES["iou_matcher"] = f"""
    WITH {_PAIRS},
    q AS (SELECT *, abs(iou - max(iou) OVER (PARTITION BY vec_id, box_id)) < 1e-6 AS low_ok FROM pr),
    w AS (SELECT *, row_number() OVER (PARTITION BY vec_id, anchor_id ORDER BY iou DESC, box_id) AS rn, max(low_ok::INT) OVER (PARTITION BY vec_id, anchor_id) AS ok FROM q)
    SELECT vec_id, CAST(anchor_id AS INT) AS anchor_id, CAST(CASE WHEN ok = 1 THEN box_id WHEN iou < 0.2 THEN -1 WHEN iou < 0.5 THEN -2 ELSE box_id END AS INT) AS match FROM w WHERE rn = 1"""


def _encoded(offset: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = M.encode(boxed(spark, d), ANCHORS, "vec_id", 0.3, (0.0, 0.0, 0.0, 0.0), (0.1, 0.1, 0.2, 0.2), offset)
        each = out.select("vec_id", "encoded_boxes", F.posexplode("encoded_labels").alias("anchor_id", "label"))
        return each.select("vec_id", "anchor_id", "label", *(F.round(F.get("encoded_boxes", F.col("anchor_id") * 4 + i), 5).alias(f"c{i}") for i in range(4)))

    return run


_ENC = f"""
    WITH {_PAIRS},
    f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY vec_id, box_id ORDER BY iou DESC, anchor_id) = 1 THEN 2.0 ELSE iou END AS score FROM pr),
    w AS (SELECT *, row_number() OVER (PARTITION BY vec_id, anchor_id ORDER BY score DESC, box_id DESC) AS rn FROM f)
    SELECT vec_id, CAST(anchor_id AS INT) AS anchor_id, CAST(CASE WHEN score > 0.3 THEN label ELSE 0 END AS INT) AS label, """
_ENC_ROW = lambda hit, rest: ", ".join(f"round(CAST(CASE WHEN score > 0.3 THEN {a} ELSE {b} END AS DOUBLE), 5) AS c{i}" for i, (a, b) in enumerate(zip(hit, rest))) + " FROM w WHERE rn = 1"
QUERIES["box_encoder"] = _encoded(False)
ORACLES["box_encoder"] = _ENC + _ENC_ROW(["(l + r) / 2", "(t + b) / 2", "r - l", "b - t"], ["al + 15", "tp + 15", "30", "30"])
QUERIES["box_encoder_offset"] = _encoded(True)
ORACLES["box_encoder_offset"] = _ENC + _ENC_ROW(["((l + r) / 2 - al - 15) / 30 / 0.1", "((t + b) / 2 - tp - 15) / 30 / 0.1", "ln((r - l) / 30) / 0.2", "ln((b - t) / 30) / 0.2"], ["0", "0", "0", "0"])


def _flat_encodings(spark: SparkSession, d: str) -> DataFrame:
    """Labels and boxes of batches of 16 samples, end to end."""
    out = M.encode(boxed(spark, d), ANCHORS, "vec_id", 0.3)
    flat = BT.flat_encodings(out.select("*", F.floor(F.col("vec_id") / 16).alias("batch"), (F.col("vec_id") % 16).alias("slot")), "batch", "slot")
    each = flat.select("batch", "boxes", F.posexplode("labels").alias("place", "label"))
    return each.select("batch", "place", "label", *(F.round(F.get("boxes", F.col("place") * 4 + i), 5).alias(f"c{i}") for i in range(4)))


QUERIES["encoded_batch"] = _flat_encodings
ORACLES["encoded_batch"] = f"""
    SELECT vec_id // 16 AS batch, CAST(row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id % 16, anchor_id) - 1 AS INT) AS place, label, c0, c1, c2, c3
    FROM ({ORACLES["box_encoder"]})"""


def _padded(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of 1 to 4 rows and 1 to 5 columns, in batches of 8, filled up to the largest of their batch."""
    e = vectors(spark, d, True)
    shape = F.array((F.col("label") % 4 + 1).cast("int"), (F.col("vec_id") % 5 + 1).cast("int"))
    cut = T.window(v(), [8, 8], [0, 0], [F.get("shape", F.lit(0)), F.get("shape", F.lit(1))])
    small = e.withColumn("shape", shape).select("vec_id", F.floor(F.col("vec_id") / 8).alias("batch"), "shape", cut.alias("v"))
    out = BT.pad_to_largest(small, "batch", "v", "shape", 2, -1.0)
    return out.select("vec_id", F.array_join("padded_shape", "x").alias("shape"), F.posexplode("v").alias("idx", "value"))


QUERIES["pad_to_largest"] = _padded
ORACLES["pad_to_largest"] = f"""
    WITH e AS (SELECT vec_id, vec_id // 8 AS batch, label % 4 + 1 AS h, vec_id % 5 + 1 AS w, {_PIXELS} AS v FROM embeddings),
    m AS (SELECT *, max(h) OVER (PARTITION BY batch) AS mh, max(w) OVER (PARTITION BY batch) AS mw FROM e),
    i AS (SELECT *, unnest(range(0, mh * mw)) AS i FROM m)
    SELECT vec_id, mh || 'x' || mw AS shape, CAST(i AS INT) AS idx, CAST(CASE WHEN i // mw < h AND i % mw < w THEN v[CAST(i // mw * 8 + i % mw AS BIGINT) + 1] ELSE -1 END AS DOUBLE) AS value FROM i"""
QUERIES["box_count"] = lambda spark, d: boxed(spark, d).select((F.col("vec_id") % 32).alias("batch"), F.filter("boxes", lambda a: B.area(a) > 200).alias("k")).groupBy("batch").agg(F.sum(F.size("k")).alias("n_boxes"))
ORACLES["box_count"] = f"WITH {_BOXED} SELECT vec_id % 32 AS batch, CAST(count(*) FILTER ((r - l) * (b - t) > 200) AS BIGINT) AS n_boxes FROM bx GROUP BY 1"
