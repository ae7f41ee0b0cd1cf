"""Sharding, boxes, tensors, pipeline and stream: micro fixtures and properties."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import audio as A
from tilewright.functions import boxes as B
from tilewright.functions import rng
from tilewright.functions import tensor as T
from tilewright.operators import augment, labels, matching, random_crops, sequences, sharding, spectral
from tilewright.plans.pipeline import Pipeline, pipeline_def
from tilewright.streaming import external


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def values(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_positions_are_global(spark):
    df = spark.range(0, 1000).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(1009)))
    got = [r.pos for r in sharding.positions(df, "k", partitions=7).orderBy("k").collect()]
    assert got == list(range(1000))
    assert sharding.positions(df.limit(0), "k").count() == 0


@pytest.mark.parametrize(("n", "shards", "batch", "sizes", "pads"), [(10, 3, 4, [3, 3, 4], [1, 1, 0]), (9, 2, 4, [4, 5], [4, 3])])
def test_shards_and_padding(spark, n, shards, batch, sizes, pads):
    s = sharding.assign_shards(sharding.positions(spark.range(n), "id"), n, shards)
    assert [r["count"] for r in s.groupBy("shard").count().orderBy("shard").collect()] == sizes
    assert sharding.pad_counts(n, shards, batch) == pads
    padded = sharding.pad_batches(s, n, shards, batch)
    assert [r["count"] for r in padded.groupBy("shard").count().orderBy("shard").collect()] == [a + b for a, b in zip(sizes, pads)]
    assert padded.where("not is_pad").count() == n


def test_last_batch_policies(spark):
    s = sharding.assign_shards(sharding.positions(spark.range(1, 8), "id"), 7, 1)
    got = lambda p: [r.id for r in sharding.last_batch(s, 7, 1, 2, p).orderBy("shard_pos").collect()]
    assert got("fill") == [1, 2, 3, 4, 5, 6, 7, 1] and got("drop") == [1, 2, 3, 4, 5, 6] and got("partial") == [1, 2, 3, 4, 5, 6, 7]
    small = sharding.assign_shards(sharding.positions(spark.range(2), "id"), 2, 1)
    assert [r.id for r in sharding.last_batch(small, 2, 1, 5, "fill").orderBy("shard_pos").collect()] == [0, 1, 0, 1, 0]
    assert sharding.last_batch_padded_size(7, 2) == 1 and sharding.remaining(7, 2, 1) == 6 and sharding.remaining(7, 2, 1, "drop") == 4


def test_shuffle_is_a_permutation_and_repeats(spark):
    order = lambda e: [r.id for r in sharding.shuffled_positions(spark.range(50), "id", 1, e).orderBy("pos").collect()]
    assert sorted(order(0)) == list(range(50)) and order(0) == order(0) and order(0) != order(1)


def test_one_hot(spark):
    hot = lambda k: one(spark, T.one_hot(F.lit(k), 3))
    assert [hot(k) for k in (0, 1, 3, 4, -1)] == [[0, 0, 1], [1, 0, 0], [0, 0, 1], [0, 0, 0], [0, 0, 0]]


def test_flips_undo_themselves(spark):
    v = values(*range(12))
    for flags in ((1, 0), (0, 1), (1, 1)):
        assert one(spark, T.flip(T.flip(v, 2, 3, *flags, c=2), 2, 3, *flags, c=2)) == list(range(12))
    assert one(spark, T.flip(v, 2, 3, 1, 0, c=2)) == [4, 5, 2, 3, 0, 1, 10, 11, 8, 9, 6, 7]
    assert one(spark, T.transpose(T.transpose(v, 3, 4), 4, 3)) == list(range(12))


def test_normalize_and_slices(spark):
    x = np.array(one(spark, T.normalize(values(*range(10)))))
    assert abs(x.mean()) < 1e-12 and abs(x.std() - 1) < 1e-12
    assert one(spark, T.normalize(values(5, 5), shift=2.0)) == [2.0, 2.0]
    assert one(spark, T.slice_pad(values(1, 2, 3), -1, 5, 0.0)) == [0, 1, 2, 3, 0]
    assert one(spark, T.slice_pad(values(1, 2, 3), -1, 3, policy="trim")) == [1, 2]
    with pytest.raises(Exception, match="out of bounds"):
        one(spark, T.slice_pad(values(1, 2, 3), 2, 2, policy="error"))


def test_resize_dims():
    assert T.resize_dims(100, 50, 20, 0, "default") == (20, 10) and T.resize_dims(100, 50, 20, 0, "stretch") == (20, 50)
    assert T.resize_dims(100, 50, 30, 30, "not_smaller") == (60, 30) and T.resize_dims(100, 50, 30, 30, "not_larger") == (30, 15)
    assert T.resize_dims(100, 50, 30, 30, "not_smaller", (40, 40)) == (40, 20)


def test_audio(spark):
    assert one(spark, A.nonsilent_region(values(0, 0, 1, 1, 0, 0, 0), -60, 0, 1)) == (2, 2)
    assert one(spark, A.nonsilent_region(values(0, 0, 0), -60, 0, 1)) == (0, 0)
    assert one(spark, A.frames(values(*range(5)), 3, 2)) == [[0, 1, 2], [2, 3, 4]] and one(spark, A.frames(values(1), 3, 2)) == []
    w = np.array(A.mel_weights(512, 16000, 10, normalize=False))
    assert w.shape == (10, 257) and 0 <= w.min() and w.max() <= 1
    x = np.sin(np.arange(64) * 0.3).tolist()
    df = spark.createDataFrame([(1, x), (2, None)], "id long, v array<double>")
    fft = {r.id: r.v for r in spectral.spectrogram(df, "id", "v", 16, 16, 8, center=False).collect()}
    slow = df.where("id = 1").select(F.flatten(A.spectrogram(F.col("v"), 16, 16, 8)).alias("v")).first().v
    assert np.allclose(fft[1], slow) and fft[2] is None
    same = spectral.resample(df.where("id = 1"), "id", "v", 8000, 8000).first().v
    assert np.allclose(same, x)


def test_boxes(spark):
    row = spark.createDataFrame([(1, [(0.0, 0.0, 10.0, 10.0), (90.0, 90.0, 99.0, 99.0)], [4, 5])], "id long, boxes array<struct<l:double,t:double,r:double,b:double>>, labels array<int>")
    got = row.select(B.crop(F.col("boxes"), F.col("labels"), 5, 0, 50, 50).alias("o")).first().o
    assert [tuple(b) for b in got.boxes] == [(0, 0, 5, 10)] and got.labels == [4]
    none = row.select(B.crop(F.col("boxes"), F.col("labels"), 40, 40, 20, 30).alias("o")).first().o
    assert [tuple(b) for b in none.boxes] == [(0, 0, 20, 30)] and none.labels == [0]
    twice = row.select(B.flip(B.flip(F.col("boxes"), 100, 100, 1, 1), 100, 100, 1, 1).alias("b")).first().b
    assert [tuple(b) for b in twice] == [(0, 0, 10, 10), (90, 90, 99, 99)]


def test_matching_ties(spark):
    anchors = [(0, 0, 10, 10), (50, 50, 60, 60)]
    twins = spark.createDataFrame([(1, [(0.0, 0.0, 10.0, 10.0)] * 2, [7, 8])], "id long, boxes array<struct<l:double,t:double,r:double,b:double>>, labels array<int>")
    matched = lambda df, *args: matching.match(df, anchors, "id", 0.5, 0.4, *args).first().matches
    encoded = lambda df: matching.encode(df, anchors, "id", 0.5).first().encoded_labels
    assert matched(twins, False) == [0, -1] and encoded(twins) == [8, 0]
    # A box that meets no anchor is within 1e-6 of its best, 0, at every anchor.
    far = spark.createDataFrame([(1, [(80.0, 80.0, 90.0, 90.0)], [7])], twins.schema)
    assert matched(far) == [0, 0] and matched(far, False) == [-1, -1]
    none = spark.createDataFrame([(1, [], [])], twins.schema)
    assert matched(none) == [-1, -1] and encoded(none) == [0, 0]
    assert matching.match(twins.limit(0), anchors, "id", 0.5, 0.4).count() == 0
    assert matching.pairs(twins, matching.anchor_table(spark, anchors), "id").count() == 4


def test_random_values(spark):
    df = spark.range(4000).repartition(5)
    u = df.select(rng.uniform(1, "a", F.col("id")).alias("u"), rng.normal(rng.uniform(1, "b", F.col("id")), rng.uniform(1, "c", F.col("id"))).alias("n"), rng.discrete(rng.uniform(1, "d", F.col("id")), ["x", "y"], [1, 3]).alias("d"))
    s = u.agg(F.min("u"), F.max("u"), F.avg("u"), F.avg("n"), F.stddev("n"), F.avg((F.col("d") == "y").cast("int"))).first()
    assert 0 <= s[0] and s[1] < 1 and abs(s[2] - 0.5) < 0.03 and abs(s[3]) < 0.06 and abs(s[4] - 1) < 0.05 and abs(s[5] - 0.75) < 0.03
    crops = random_crops.random_windows(df, "id", 64, 48, seed=3).collect()
    assert all(0 <= r.x and r.x + r.w <= 64 and 0 <= r.y and r.y + r.h <= 48 and r.w > 0 and r.h > 0 for r in crops)


def test_effects_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, [float((i * 31 + j * 7) % 256) for j in range(48)]) for i in range(20)], "id long, v array<double>")
    chain = [("jitter", {}), ("salt_and_pepper", {"probability": 0.3}), ("hue", {"degrees": 20.0}), ("rotate", {"degrees": 0.0})]
    got = lambda n: sorted((r.id, r.v) for r in augment.apply(df.repartition(n), "id", "v", (4, 4, 3), chain, 5).collect())
    assert got(1) == got(7)
    same = augment.apply(df, "id", "v", (4, 4, 3), [("hue", {"degrees": 360.0}), ("saturation", {"factor": 1.0})], 1)
    assert np.allclose([r.v for r in same.orderBy("id").collect()], [r.v for r in df.orderBy("id").collect()])


def test_sequences(spark):
    df = spark.createDataFrame([("a", i) for i in range(6)] + [("b", 0)], "k string, i int")
    rows = sequences.sequences(df, "k", ["i"], 3, 2, 1).orderBy("sequence", "frame").collect()
    assert [(r.sequence, r.i) for r in rows] == [(0, 0), (0, 1), (0, 2), (1, 2), (1, 3), (1, 4)]


def test_lookup_fails_on_missing(spark):
    samples, known = spark.range(3).withColumnRenamed("id", "n"), spark.createDataFrame([(0, 1), (1, 1)], "n long, label int")
    assert labels.lookup(samples.where("n < 2"), known, "n").count() == 2
    with pytest.raises(Exception, match="no label"):
        labels.lookup(samples, known, "n").collect()


def test_pipeline(spark):
    @pipeline_def(batch_size=3)
    def plan(p, n):
        p.source(spark.range(n).withColumnRenamed("id", "sample_id")).apply(v=F.array(F.col("sample_id").cast("double"), F.lit(1.0)), u=p.uniform("u", 2.0, 3.0))
        return ["v", "u"]

    p = plan(7, shard_id=1, num_shards=2)
    got = list(p.arrays("v", (2,)))
    assert [a.shape for a, _ in got] == [(3, 2), (3, 2)] and [a[:, 0].tolist() for a, _ in got] == [[3, 4, 5], [6, 3, 4]]
    assert p.last_batch_padded_size() == 2 and p.remaining(1) == 3 and p.is_empty(2)
    u = {x for b in p.batches() for x in b["u"]}
    assert all(2 <= x < 3 for x in u) and u != {x for b in plan(7, shard_id=1, num_shards=2, epoch=1).batches() for x in b["u"]}
    every = [x for k in range(2) for b in plan(7, shard_id=k, num_shards=2, last_batch="partial", shuffle=True, rotate_shards=True, epoch=1).batches() for x in b["sample_id"]]
    assert sorted(every) == list(range(7))
    ragged = Pipeline(2).source(spark.createDataFrame([(0, [1.0]), (1, None)], "sample_id long, r array<double>")).set_outputs("r")
    assert [a.tolist() for a in ragged.padded("r", 2)] == [[[1, 0], [0, 0]]]


def test_stream_equals_table(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(i, f"n{i}", b"x", i % 3, 1, 1) for i in range(20)], external.SCHEMA)
    for k in range(4):
        external.feed(rows.where(F.col("sample") % 4 == k), path)
    s = external.batched(external.stream(spark, path, files_per_trigger=1), 8)
    external.deliver(s, lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "c")).awaitTermination()
    got = {(r.sample, r.batch_id, r.slot) for r in spark.read.parquet(out).collect()}
    assert got == {(r.sample, r.batch_id, r.slot) for r in external.batched(spark.read.parquet(path), 8).collect()} and len(got) == 20
    q = external.label_counts(external.stream(spark, path)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("counts").collect()} == {(0, 7), (1, 7), (2, 6)}


def test_shards_are_exact_at_any_size(spark):
    n, shards = 10**13 + 37, 65_537
    starts = [n * k // shards for k in (0, 1, 2, 777, 40_000, shards - 1)]
    places = spark.createDataFrame([(s + o,) for s in starts for o in (-1, 0, 1) if 0 <= s + o < n] + [(n - 1,)], "pos long")
    for r in sharding.assign_shards(places, n, shards).collect():
        k = next(k for k in (r.shard - 1, r.shard, r.shard + 1) if n * k // shards <= r.pos < n * (k + 1) // shards)
        assert r.shard == k and r.shard_pos == r.pos - n * k // shards


def test_shards_of_a_given_size(spark):
    got = sharding.shards_of_size(sharding.positions(spark.range(10), "id"), 4).orderBy("pos").collect()
    assert [(r.shard, r.shard_pos) for r in got] == [(i // 4, i % 4) for i in range(10)]


@pytest.mark.parametrize(("n", "shards", "batch"), [(10, 3, 4), (7, 2, 4), (3, 3, 5), (11, 4, 2), (5, 2, 12)])
def test_fill_goes_on_into_the_next_shard(spark, n, shards, batch):
    placed = sharding.positions(spark.range(n), "id")
    for epoch in (0, 1):
        got = {}
        for r in sharding.fill_from_next(placed, n, shards, batch, epoch).collect():
            got.setdefault(r.shard, []).append((r.shard_pos, r.id, r.is_pad))
        for k in range(shards):
            source = (k + epoch) % shards
            first, end = n * source // shards, n * (source + 1) // shards
            full = -(-(end - first) // batch) * batch
            want = [(i, (first + i) % n, first + i >= end) for i in range(full)]
            assert sorted(got.get(k, [])) == want


def test_lookup_never_multiplies(spark):
    samples = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "name string, x int")
    table = spark.createDataFrame([("a", 5, 2), ("a", 9, 1), ("b", 7, 1)], "name string, label int, line int")
    got = sorted(tuple(r) for r in labels.lookup(samples, table, "name", "line").select("name", "x", "label").collect())
    assert got == [("a", 1, 9), ("a", 3, 9), ("b", 2, 7)]
    assert labels.lookup(samples, table, "name").count() == 3
    with pytest.raises(Exception, match="no label for"):
        labels.lookup(samples, table.where("name = 'a'"), "name").collect()


def test_storage_asks_a_cluster_for_its_folder(spark):
    from types import SimpleNamespace

    from tilewright import storage

    conf = SimpleNamespace(get=lambda *a: None)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(far)


def test_moving_power(spark):
    """Sums that begin anew equal plain windows, wherever windows and resets fall; time doesn't grow with the window."""
    import time

    r = np.random.default_rng(4)
    for n, window, reset in ((1, 1, 8192), (63, 3, 10), (64, 7, 7), (200, 64, 50), (500, 9, 65), (130, 200, 16), (0, 3, 5)):
        x = r.normal(size=n)
        got = spark.createDataFrame([(x.tolist(),)], "v array<double>").select(A.moving_power(F.col("v"), window, reset)).first()[0]
        want = [float((x[max(0, i - window + 1) : i + 1] ** 2).sum()) / window for i in range(n)]
        assert np.allclose(got, want, atol=1e-12), (n, window, reset)
    signal = spark.range(8).select(F.transform(F.sequence(F.lit(0), F.lit(15_999)), lambda i: F.sin(i * 0.1)).alias("v")).cache()
    signal.count()

    def seconds(window):
        began = time.perf_counter()
        signal.select(A.nonsilent_region(F.col("v"), -60.0, 0.0, window)).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(3)
    assert seconds(2048) < 3 * seconds(3) + 1
