"""Operators on the samples of a batch, default parameters and what the facade tells."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from tilewright.functions import rng
from tilewright.functions import tensor as T
from tilewright.operators import batches, sharding
from tilewright.plans.pipeline import Pipeline


def test_failed_samples(spark):
    rows = [(0, 0, None, True), (0, 1, "b", False), (0, 2, "c", False), (0, 3, None, None), (1, 0, "e", False)]
    df = spark.createDataFrame(rows, "batch int, slot int, x string, failed boolean")
    got = batches.replace_failed(df, "batch", "slot", "failed", ["x"]).orderBy("batch", "slot").collect()
    assert [(r.x, r.replaced) for r in got] == [("c", True), ("b", False), ("c", False), ("c", True), ("e", False)]
    assert batches.replace_failed(df.limit(0), "batch", "slot", "failed", ["x"]).count() == 0
    lost = spark.createDataFrame([(7, 0, None, True)], df.schema)
    with pytest.raises(Exception, match="all samples failed in batch 7"):
        batches.replace_failed(df.unionByName(lost), "batch", "slot", "failed", ["x"]).collect()


def test_padding_to_the_largest(spark):
    rows = [(0, [1.0, 2.0], [1, 2]), (0, [3.0, 4.0], [2, 1]), (1, [5.0], [1, 1]), (1, None, [0, 0]), (None, [], [0, 0])]
    df = spark.createDataFrame(rows, "b int, v array<double>, s array<int>")
    got = {(r.b, tuple(r.s)): (r.v, r.padded_shape) for r in batches.pad_to_largest(df, "b", "v", "s", 2, 9.0).collect()}
    assert got[0, (1, 2)] == ([1.0, 2.0, 9.0, 9.0], [2, 2]) and got[0, (2, 1)] == ([3.0, 9.0, 4.0, 9.0], [2, 2])
    assert got[1, (1, 1)][0] == [5.0] and got[1, (0, 0)][0] is None and got[None, (0, 0)] == ([], [0, 0])


def test_slices(spark):
    v = F.array(*(F.lit(float(i)) for i in range(6)))
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.slice_axes(v, [2, 3], [0, 1], [2, 2])) == [1.0, 2.0, 4.0, 5.0]
    assert one(T.slice_axes(v, [2, 3], [1, 2], [2, 2], 7.0, "pad")) == [5.0, 7.0, 7.0, 7.0]
    assert one(T.slice_axes(v, [2, 3], [1, 2], [2, 2], policy="trim")) == [5.0] and one(T.slice_axes(v, [2, 3], [4, 0], [2, 2], policy="trim")) == []
    with pytest.raises(Exception, match="out of bounds"):
        one(T.slice_axes(v, [2, 3], [1, 2], [2, 2]))


def test_drawn_parameters(spark):
    ends = spark.range(200).select(*(c.alias(f"{e}_{n}") for e in rng.RANGES for n, c in rng.drawn(e, 3, F.col("id")).items()))
    for effect, own in rng.RANGES.items():
        for name, (low, high) in own.items():
            r = ends.agg(F.min(f"{effect}_{name}").alias("a"), F.max(f"{effect}_{name}").alias("b")).first()
            assert low <= r.a < r.b <= high
    assert rng.drawn("fog", 1, F.col("id"), gray=0.5)["gray"] == 0.5


def test_facade(spark):
    p = Pipeline(batch_size=3, key="id", last_batch="partial")
    assert not p.verify() and "source" in p.error
    p.source(spark.range(5).select("id", F.sequence(F.lit(0), F.col("id").cast("int")).alias("v"), (F.col("id") * 2).alias("width")), "id").set_outputs("v", "height")
    assert not p.verify() and "height" in p.error
    p.set_outputs("v")
    assert p.verify() and p.error == "" and p.augmentation_branches() == 1
    assert p.output_maxima("v", "width") == {"v": 5, "width": 8}
    got = list(p.padded("v"))
    assert [g.shape for g in got] == [(3, 5), (2, 5)] and got[1][1].tolist() == [0, 1, 2, 3, 4]
    assert p.seconds["wait"] > 0


def test_a_shard_is_numbered_by_key_alone(spark):
    """Tensors are made for the shard's own samples, after its keys are found; the written positions hold keys."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(i):
        seen.add(1)
        return [float(i)] * 4

    rows = spark.range(300).withColumnRenamed("id", "sample_id")
    p = Pipeline(batch_size=7, shard_id=1, num_shards=5, last_batch="fill").source(rows).apply(t=counted("sample_id")).set_outputs("t")
    got = p.build().collect()
    assert sorted({r.sample_id for r in got}) == list(range(60, 120)) and len(got) == 63 and all(r.t == [float(r.sample_id)] * 4 for r in got)
    assert seen.value <= 70
    plan = p.build()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") > plan.index("counted") or "ArrowEvalPython" in plan or "BatchEvalPython" in plan


def test_shards_by_arithmetic(spark):
    """Fillings and paddings at many shards take about as long as at few, and are those of a plain walk."""
    def fills(n, shards, batch):
        out = []
        for k in range(shards):
            a, b = n * k // shards, n * (k + 1) // shards
            for t in range(-(b - a) % batch if b > a else 0):
                out.append(((b + t) % n, k, b - a + t))
        return sorted(out)

    for n, shards, batch in ((10, 3, 4), (7, 7, 5), (5, 9, 4), (3, 2, 11), (40, 6, 7), (23, 1, 10)):
        placed = spark.range(n).select(F.col("id").alias("pos"))
        got = sharding.fill_from_next(placed, n, shards, batch).where("is_pad").select("pos", "shard", "shard_pos").collect()
        assert sorted(map(tuple, got)) == fills(n, shards, batch), (n, shards, batch)
        s = sharding.assign_shards(placed, n, shards)
        pads = {r.shard: r["n"] for r in sharding.pad_batches(s, n, shards, batch).where("is_pad").groupBy("shard").agg(F.count("*").alias("n")).collect()}
        assert {k: p for k, p in enumerate(sharding.pad_counts(n, shards, batch)) if p} == pads

    def seconds(f):
        began = time.perf_counter()
        f().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    n = 100_000
    placed = spark.range(n).select(F.col("id").alias("pos"))
    both = lambda shards: sharding.fill_from_next(placed, n, shards, 16).unionByName(sharding.pad_batches(sharding.assign_shards(placed, n, shards), n, shards, 16), allowMissingColumns=True)
    seconds(lambda: both(4))
    assert seconds(lambda: both(2000)) < 3 * seconds(lambda: both(4)) + 1


def test_wide_places(spark):
    """Places and shards whose products pass 64 bits."""
    n, shards = 10**15, 100_000
    row = spark.sql("SELECT 999999999999999L AS pos").select(sharding.shard_of(F.col("pos"), n, shards).alias("k"), sharding.shard_start(F.lit(99_999), n, shards).alias("a")).first()
    assert (row.k, row.a) == (99_999, n * 99_999 // shards)


def test_permutations(spark):
    """A bijection for any size, another for each seed, name and epoch; no exchange beyond the numbering."""
    for n in (1, 2, 3, 5, 16, 17, 97, 1000, 4099):
        places = spark.range(n).withColumnRenamed("id", "pos")
        got = lambda seed, epoch: [r.p for r in places.select("pos", sharding.permuted(F.col("pos"), n, seed, "x", epoch).alias("p")).orderBy("pos").collect()]
        one = got(1, 0)
        assert sorted(one) == list(range(n)) and one == got(1, 0)
        if n > 90:
            assert len({tuple(one), tuple(got(2, 0)), tuple(got(1, 1))}) == 3
            # Neighbours part, and no place is favoured.
            assert sum(abs(a - b) for a, b in zip(one, one[1:])) / n > n / 6 and sum(i == p for i, p in enumerate(one)) < 20
    plan = sharding.permuted_positions(spark.range(50).withColumnRenamed("id", "pos"), 50, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_two_levels(spark):
    rows = [(i, 10 if i % 3 else 30, 20) for i in range(103)]
    df = spark.createDataFrame(rows, "id long, w int, h int")
    placed, wide, other = sharding.aspect_places(df, F.col("w"), F.col("h"), "id")
    assert (wide, other) == (35, 68)
    epochs = [sharding.aspect_epoch(placed, wide, other, 8, 5, e).collect() for e in range(2)]
    for got in epochs:
        batches_ = {}
        for r in got:
            batches_.setdefault(r.batch_id, []).append(r)
        assert sorted(batches_) == list(range(5 + 9)) and sorted(r.id for r in got) == list(range(103))
        assert all(len({r.wide for r in b}) == 1 and sorted(r.slot for r in b) == list(range(len(b))) for b in batches_.values())
        kinds = [batches_[i][0].wide for i in range(14)]
        assert kinds != sorted(kinds) and kinds != sorted(kinds, reverse=True)
    assert [tuple(r) for r in epochs[0]] != [tuple(r) for r in epochs[1]]


def test_a_pipeline_is_numbered_once(spark):
    p = Pipeline(batch_size=5, num_shards=3, shard_id=1, shuffle=True, seed=4, last_batch="partial").source(spark.range(60).withColumnRenamed("id", "sample_id")).set_outputs()
    first = {r.sample_id for r in p.build().collect()}
    placed = p.placed
    second = {r.sample_id for r in p.reset().build().collect()}
    assert p.placed is placed and len(first) == len(second) == 20 and first != second


def test_delivery_to_ranks(spark, tmp_path):
    """Each rank gets its own batches in order, in one task; if one fails, all begin anew."""
    def plan(**k):
        rows = spark.range(53).withColumnRenamed("id", "sample_id")
        return Pipeline(batch_size=4, num_shards=3, seed=2, **k).source(rows).apply(t=F.array(F.col("sample_id") * 2)).set_outputs("t")

    folder = str(tmp_path)

    def consume(rank, batches):
        with open(f"{folder}/starts-{rank}", "a") as f:
            f.write("x")
        with open(f"{folder}/rank-{rank}", "w") as f:
            for n, b in enumerate(batches):
                # One rank fails once, after its second batch.
                if rank == 1 and n == 1 and not os.path.exists(f"{folder}/failed"):
                    open(f"{folder}/failed", "w").close()
                    raise RuntimeError("a rank is lost")
                f.write(",".join(map(str, b["sample_id"])) + "\n")
                assert b["t"] == [[2 * i] for i in b["sample_id"]]

    told = plan(shuffle=True).deliver(consume).collect()
    assert sorted((r.rank, r.batches) for r in told) == [(0, 5), (1, 5), (2, 5)]
    assert all(open(f"{folder}/starts-{k}").read() == "xx" for k in range(3))
    for k in range(3):
        own = [[int(x) for x in line.split(",")] for line in open(f"{folder}/rank-{k}")]
        want = {}
        for r in plan(shuffle=True, shard_id=k).build().orderBy("batch_id", "slot").collect():
            want.setdefault(r.batch_id, []).append(r.sample_id)
        assert own == [want[i] for i in sorted(want)] and {len(b) for b in own} == {4}


def test_rotation_by_rank(spark):
    rows = spark.range(20).withColumnRenamed("id", "sample_id")
    for epoch in range(3):
        got = [sorted(r.sample_id for r in Pipeline(batch_size=3, shard_id=k, num_shards=3, last_batch="partial", rotate_shards=True, epoch=epoch).source(rows).set_outputs().build().collect()) for k in range(3)]
        cut = [list(range(20 * s // 3, 20 * (s + 1) // 3)) for s in range(3)]
        assert got == [cut[(k + epoch) % 3] for k in range(3)]
