"""Queries on the vectors take all 64 values of each."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tilewright.operators import augment
from tilewright.plans import tables
from tilewright.plans.vectors import vectors

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


def by_vector(rows):
    found = {}
    for r in rows.orderBy("vec_id", "idx").collect():
        found.setdefault(r.vec_id, []).append(r.value)
    return found


def test_spectrogram_frames(spark):
    whole, first = by_vector(tables.spectrogram_fft_frames(spark, DATA)), by_vector(tables.spectrogram_fft(spark, DATA))
    assert whole and {len(v) for v in whole.values()} == {51} and {k: v[:17] for k, v in whole.items()} == first


def test_colour_queries(spark):
    n = vectors(spark, DATA, True).count()
    got, twisted = by_vector(tables.hue_saturation(spark, DATA)), by_vector(tables.color_twist_hsv(spark, DATA))
    assert len(got) == len(twisted) == n and {len(v) for v in [*got.values(), *twisted.values()]} == {66}
    chain = [("hue", {"degrees": 40.0}), ("saturation", {"factor": 1.3})]
    tail = vectors(spark, DATA, True).select("vec_id", F.slice("v", 61, 3).alias("v"))
    alone = {r.vec_id: [round(x, 4) for x in r.v] for r in augment.apply(tail, "vec_id", "v", (1, 1, 3), chain, seed=42).collect()}
    assert all(got[k][60:63] == pytest.approx(alone[k], abs=1e-3) for k in got)
