"""The k best against all pairs multiplied as Python integers."""

from __future__ import annotations

import math
import random

import numpy as np

from tilewright.llm import topk as T


def plain(rows, divisor=100, k=10):
    """(query row's place, rank, id, score) by reading the definition."""
    sound = []
    for place, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            sound.append((place, i, [math.floor(1024 * x) for x in v]))
    out = []
    for place, i, q in sound:
        if i % divisor == 0:
            score = lambda c: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, c))))
            others = sorted(((-score(c), j) for other, j, c in sound if other != place and len(c) == len(q)))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(others[:k], 1)]
    return sorted(out)


def got(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, row int, rank int").repartition(parts)
    return sorted(tuple(r) for r in T.search(df, **SMALL | kw).select("query_id", "rank", "vec_id", "score").collect())


def vectors(n, dims, seed, kinds=40):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(kinds)]
    return [(i, [m + r.gauss(0, 0.3) for m in r.choice(middles)]) for i in range(n)]


SMALL = {"block_rows": 64, "group": 8, "first": 3}


def test_random_vectors(spark):
    rows = vectors(900, 40, 1)
    assert got(spark, rows, divisor=20) == plain(rows, 20)


def test_rounds(spark, monkeypatch):
    monkeypatch.setattr(T, "TILE", 3)
    rows = vectors(400, 20, 2)
    assert got(spark, rows, divisor=10, k=3, round_bytes=900) == plain(rows, 10, 3)


def test_defined_results(spark):
    v = [1.0, -2.0, 0.5]
    rows = [(0, v), (1, v), (2, v), (2, v), (100, None), (200, [1.0, None, 2.0]), (300, [1.0, math.nan, 2.0]), (400, [math.inf, 0.0, 0.0]), (None, v), (500, []), (501, []), (600, [3.0]), (700, v), (700, v)]
    rows += [(i, [0.0005 * i, 0.3, -0.0001]) for i in range(1001, 1040)]
    assert got(spark, rows) == plain(rows)
    assert not got(spark, [(1, v)]) and not got(spark, [])
    assert got(spark, [(0, v)]) == []


def test_large_components(spark):
    r = random.Random(3)
    rows = [(i, [r.choice((1e3, 1e9, -1e12, 1e200, 2.0**41 + 0.3, 1e-9)) * r.random() for _ in range(4)]) for i in range(60)]
    assert got(spark, rows, divisor=10) == plain(rows, 10)


def test_many_equal_vectors(spark):
    rows = [(i, [0.1] * 9) for i in range(500)] + vectors(100, 9, 5)
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    assert got(spark, rows) == plain(rows)


def test_pruning(monkeypatch):
    """Most candidates leave before their last group, and the result stays that of all products."""
    rng = np.random.default_rng(4)
    middles = rng.normal(0, 300, (30, 64))
    all_rows = np.floor(middles[rng.integers(0, 30, 4000)] + rng.normal(0, 60, (4000, 64)))
    groups = lambda m: [m[:, g : g + 16].T for g in range(0, 64, 16)]
    ids = np.arange(4000)
    tile = T.Tile(ids[:40], ids[:40], groups(all_rows[:40]), 10, np.full(40, -np.inf))
    left = []
    pairs = T.Tile._pairs
    monkeypatch.setattr(T.Tile, "_pairs", lambda self, g, qi, *a: (left.append((g, len(qi))), pairs(self, g, qi, *a)))
    for at in range(0, 4000, 500):
        some = groups(all_rows[at : at + 500])
        tile.meet(ids[at : at + 500], ids[at : at + 500], some, T._rest(some, 500), 1e4)
    score = (all_rows[:40] @ all_rows.T).astype(np.int64)
    np.fill_diagonal(score, -(1 << 60))
    want = [sorted(range(4000), key=lambda j: (-score[i, j], j))[:10] for i in range(40)]
    assert tile.vec.reshape(40, 10).tolist() == want
    assert len(left) >= 6 and all(n < 40 * 500 / T.SPARSE for _, n in left)
