"""Sharding, shuffling, batching and padding with exact integer arithmetic.

A sample's place in the global order is the only thing that has to be known
across partitions. ``positions`` finds it without moving all rows to one task:
rows are range-partitioned and sorted, numbered within their partition, and
shifted by the sizes of the partitions before theirs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import rng
from tilewright.functions.tensor import let
from tilewright.storage import written


def positions(df: DataFrame, *order: str | Column, partitions: int | None = None) -> DataFrame:
    """``df`` with ``pos``, its place from 0 in the given order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.monotonically_increasing_id()  # partition number above bit 33, place in the partition below
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns(
        {"_part": F.shiftright(row, 33).cast("int"), "_at": row.bitwiseAND(F.lit((1 << 33) - 1))}
    )
    # Written, so that both uses see the same partitions.
    table = written(dealt, "positions")
    sizes = table.groupBy("_part").count()  # a row for each partition
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return table.join(F.broadcast(offsets), "_part").withColumn("pos", F.col("_at") + F.col("_offset")).drop("_part", "_at", "_offset")


def shuffled_positions(df: DataFrame, key: str, seed: int, epoch: int = 0) -> DataFrame:
    """``df`` with ``pos`` in an order that depends on seed, epoch and key alone."""
    return positions(df, rng.uniform(seed, "shuffle", F.col(key), epoch), key)


#: A place outside the range is sent on so many times; the chance that this isn't enough falls with the range, and it is told.
_WALKS = 32


def permuted(pos: Column, n: int, seed: int, name: str = "permute", epoch: int = 0) -> Column:
    """Where a place of 0..n-1 goes in a permutation that depends on seed, name and epoch alone; nothing is sorted.

    Places are written as pairs (l, r) of a rectangle of a x b >= n places. Four
    rounds add to one half a number drawn from the other, which can be undone,
    so the rectangle is permuted. A place that leaves the range is sent on until
    it is back in it, which closes every cycle within the range. Fewer than a
    places lie outside, so few walks are longer than one step.
    """
    if n <= 1:
        return pos.cast("long")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    drawn = lambda x, k, m: F.floor(rng.uniform(seed, name, x, epoch, k) * m)
    left = lambda p, k: F.struct(((p["l"] + drawn(p["r"], k, a)) % a).alias("l"), p["r"].alias("r"))
    right = lambda p, k: F.struct(p["l"].alias("l"), ((p["r"] + drawn(p["l"], k, b)) % b).alias("r"))

    def once(x: Column) -> Column:
        pair = F.struct(_whole(x, F.lit(b).cast("long")).alias("l"), (x % b).alias("r"))
        return let(pair, lambda p: let(left(p, 1), lambda p: let(right(p, 2), lambda p: let(left(p, 3), lambda p: let(right(p, 4), lambda p: p["l"] * b + p["r"])))))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(_WALKS)), once(pos.cast("long")), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return let(walked, lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a place didn't come back into the range: take another seed")).cast("long")))


def permuted_positions(placed: DataFrame, n: int, seed: int, epoch: int = 0) -> DataFrame:
    """``placed`` with ``pos`` in another order: one numbering serves all epochs, each of which is arithmetic."""
    return placed.withColumn("pos", permuted(F.col("pos"), n, seed, "permute", epoch))


def _whole(a: Column, b: Column) -> Column:
    """Floor of a / b for whole numbers that are not negative."""
    return F.call_function("div", a, b)


def _kind(n: int, shards: int) -> str:
    """What products of places and shards are computed in: longs, or decimals where these could overflow."""
    return "long" if (n + 2) * (shards + 2) < 1 << 62 else "decimal(19,0)"


def _wide(x, kind: str) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast(kind)


def shard_of(pos: Column, n: int, shards: int) -> Column:
    """The shard k with floor(n k / K) <= pos < floor(n (k + 1) / K)."""
    kind = _kind(n, shards)
    return _whole(_wide(pos + 1, kind) * _wide(shards, kind) - 1, _wide(n, kind)).cast("int")


def shard_start(shard: Column, n: int, shards: int) -> Column:
    kind = _kind(n, shards)
    return _whole(_wide(shard, kind) * _wide(n, kind), _wide(shards, kind)).cast("long")


def shard_size(shard: Column, n: int, shards: int) -> Column:
    return shard_start(shard + 1, n, shards) - shard_start(shard, n, shards)


def assign_shards(placed: DataFrame, n: int, shards: int, epoch: int = 0, rotate: bool = False) -> DataFrame:
    """Adds ``shard`` and ``shard_pos``; with ``rotate`` shard numbers move on by one each epoch."""
    base = shard_of(F.col("pos"), n, shards)
    out = placed.withColumn("_s", base).withColumn("shard_pos", F.col("pos") - shard_start(F.col("_s"), n, shards))
    number = F.pmod(F.col("_s") - epoch, F.lit(shards)) if rotate else F.col("_s")
    return out.withColumn("shard", number.cast("int")).drop("_s")


def batches(sharded: DataFrame, batch: int) -> DataFrame:
    """Adds ``batch_id`` within the shard and ``slot`` within the batch."""
    return sharded.withColumns({"batch_id": _whole(F.col("shard_pos"), F.lit(batch).cast("long")), "slot": (F.col("shard_pos") % batch).cast("int")})


def shards_of_size(placed: DataFrame, size: int) -> DataFrame:
    """As ``assign_shards`` with an explicit size: every shard holds ``size`` samples but the last, which holds the rest."""
    if size < 1:
        raise ValueError("a shard holds a sample at least")
    return placed.withColumns({"shard": _whole(F.col("pos"), F.lit(size).cast("long")).cast("int"), "shard_pos": F.col("pos") % size})


def pad_counts(n: int, shards: int, batch: int) -> list[int]:
    """Copies of its last sample that each shard needs so that all shards have equally many full batches."""
    sizes = [n * (k + 1) // shards - n * k // shards for k in range(shards)]
    largest = -(-n // shards)
    if largest % batch == 0:
        return [largest - s if s else 0 for s in sizes]
    full = largest + batch - largest % batch
    return [full - s if s else 0 for s in sizes]


def pad_batches(sharded: DataFrame, n: int, shards: int, batch: int) -> DataFrame:
    """Adds copies of each shard's last sample (``is_pad``) up to equally many full batches, as ``pad_counts`` has them."""
    largest = -(-n // shards)
    full = -(-largest // batch) * batch
    size = shard_size(F.col("shard"), n, shards)
    copies = F.when(F.col("shard_pos") == size - 1, F.lit(full) - size).otherwise(0)
    return (
        sharded.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies)))
        .withColumns({"is_pad": F.col("_copy") > 0, "shard_pos": F.col("shard_pos") + F.col("_copy")})
        .drop("_copy")
    )


def last_batch(sharded: DataFrame, n: int, shards: int, batch: int, policy: str = "fill") -> DataFrame:
    """What becomes of a last batch that is not full: "fill" wraps round to the shard's first samples, "drop" leaves it out, "partial" keeps it short."""
    if policy == "partial":
        return sharded.withColumn("is_pad", F.lit(False))
    size = shard_size(F.col("shard"), n, shards)
    if policy == "drop":
        return sharded.where(F.col("shard_pos") < F.floor(size / batch) * batch).withColumn("is_pad", F.lit(False))
    missing = F.pmod(-size, F.lit(batch))
    # A sample is repeated for every lap round the shard that the padding reaches.
    laps = F.floor((missing - F.col("shard_pos") + size - 1) / size)
    return (
        sharded.withColumn("_lap", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), laps))))
        .withColumns({"is_pad": F.col("_lap") > 0, "shard_pos": F.col("shard_pos") + F.col("_lap") * size})
        .drop("_lap")
    )


def fill_from_next(placed: DataFrame, n: int, shards: int, batch: int, epoch: int = 0) -> DataFrame:
    """Shards whose last batch is filled with the first samples of the next shard (``is_pad``), the last shard's with those of the first.

    Each epoch a shard number takes the samples of the next shard, so that a
    filled sample is met again as the reader's own one epoch later. A shard
    smaller than what is missing is taken whole and then the one after it.
    """
    base = shard_of(F.col("pos"), n, shards)
    own = placed.withColumns({"_s": base, "is_pad": F.lit(False)}).withColumn("shard_pos", F.col("pos") - shard_start(F.col("_s"), n, shards))
    # Places are counted on past the end, once round for each lap that a filling can reach. A place fills the shards that end less
    # than a batch before it: their numbers follow from it, so a row looks at batch * shards / n + 1 shards in each lap and not at all.
    kind = _kind(n + batch, shards)
    laps = F.transform(F.sequence(F.lit(0), F.lit(-(-batch // max(n, 1)))), lambda lap: F.col("pos") + lap * F.lit(n).cast("long"))
    ends_at = lambda f: shard_start(f + 1, n, shards)

    def fills(place: Column) -> Column:
        low, high = F.greatest(place - (batch - 1), F.lit(1).cast("long")), F.least(place, F.lit(n).cast("long"))
        first = _whole(_wide(low, kind) * _wide(shards, kind) + (n - 1), _wide(n, kind)).cast("long") - 1
        last = F.least(_whole(_wide(high + 1, kind) * _wide(shards, kind) - 1, _wide(n, kind)).cast("long"), F.lit(shards).cast("long")) - 1
        some = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.expr("cast(array() as array<bigint>)"))
        return F.filter(
            F.transform(some, lambda f: F.struct(f.cast("int").alias("shard"), (place - ends_at(f)).alias("step"), shard_size(f, n, shards).alias("size"))),
            lambda x: (x["step"] >= 0) & (x["step"] < F.pmod(-x["size"], F.lit(batch))) & (x["size"] > 0),
        )

    pads = placed.withColumn("_f", F.explode(F.flatten(F.transform(laps, fills))))
    pads = pads.withColumns({"_s": F.col("_f.shard"), "is_pad": F.lit(True), "shard_pos": F.col("_f.size") + F.col("_f.step")}).drop("_f")
    number = F.pmod(F.col("_s") - epoch, F.lit(shards)).cast("int")
    return own.unionByName(pads).withColumn("shard", number).drop("_s")


def last_batch_padded_size(size: int, batch: int) -> int:
    return (batch - size % batch) % batch


def remaining(size: int, batch: int, pulled: int, policy: str = "fill") -> int:
    """Samples left after ``pulled`` batches."""
    total = size // batch * batch if policy == "drop" else -(-size // batch) * batch if policy == "fill" else size
    return max(0, total - pulled * batch)


def aspect_groups(df: DataFrame, width: Column, height: Column, key: str, batch: int, seed: int | None = None) -> DataFrame:
    """Adds ``wide`` (height / width <= 1) and a batch number within the group, so that a batch holds one kind of shape.

    Within a group the order is by aspect ratio, or by a hash of ``seed`` and
    key. Places are found as in ``positions``; the groups' sizes are one count.
    """
    ratio = height / width
    wide = (ratio <= 1).cast("int")
    by = rng.uniform(seed, "shuffle", F.col(key)) if seed is not None else ratio
    placed = positions(df.withColumns({"wide": wide, "_by": by}), F.desc("wide"), "_by", key)
    n_wide = placed.agg(F.coalesce(F.sum("wide"), F.lit(0))).first()[0]
    place = F.when(F.col("wide") == 1, F.col("pos")).otherwise(F.col("pos") - n_wide)
    return placed.withColumns({"batch_id": F.floor(place / batch), "slot": (place % batch).cast("int")}).drop("_by", "pos")


def aspect_places(df: DataFrame, width: Column, height: Column, key: str) -> tuple[DataFrame, int, int]:
    """``df`` with ``wide`` (height / width <= 1) and ``place``, its number within its kind in the order of the key; and how many of each kind: (wide, others).

    Made once; ``aspect_epoch`` shuffles it as often as wanted.
    """
    placed = positions(df.withColumn("wide", (height / width <= 1).cast("int")), F.desc("wide"), key)
    sizes = placed.agg(F.count("*").alias("n"), F.coalesce(F.sum("wide"), F.lit(0)).alias("wide")).first()
    place = F.when(F.col("wide") == 1, F.col("pos")).otherwise(F.col("pos") - sizes["wide"])
    return placed.withColumn("place", place).drop("pos"), sizes["wide"], sizes["n"] - sizes["wide"]


def aspect_epoch(placed: DataFrame, n_wide: int, n_other: int, batch: int, seed: int, epoch: int = 0) -> DataFrame:
    """``aspect_places`` shuffled in two levels: samples within their kind, and then whole batches of both kinds.

    Adds ``batch_id`` and ``slot``. Each kind's last batch may be short, and
    stands where its number takes it. No row moves: both levels are arithmetic.
    """
    wide = F.col("wide") == 1
    place = F.when(wide, permuted(F.col("place"), n_wide, seed, "wide", epoch)).otherwise(permuted(F.col("place"), n_other, seed, "other", epoch))
    n_first, n_batches = -(-n_wide // batch), -(-n_wide // batch) + -(-n_other // batch)
    return (
        placed.withColumn("_place", place)
        .withColumns({"slot": (F.col("_place") % batch).cast("int"), "_batch": _whole(F.col("_place"), F.lit(batch).cast("long")) + F.when(wide, 0).otherwise(n_first)})
        .withColumn("batch_id", permuted(F.col("_batch"), n_batches, seed, "batches", epoch))
        .drop("place", "_place", "_batch")
    )
