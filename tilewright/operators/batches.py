"""Operators on the samples of a batch: stand-ins for failed decodes, padding to the largest shape, flat encodings.

A batch holds as many rows as its size says, so a group by batch is bounded by
a parameter, whatever the number of samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import tensor as T
from tilewright.storage import written


def replace_failed(samples: DataFrame, batch: str, slot: str, failed: str, columns: list[str]) -> DataFrame:
    """``samples`` with the ``columns`` of a failed row taken from the last good row of its batch, by ``slot``; adds ``replaced``.

    Rows that did not fail are not moved: only one stand-in for each batch and
    the failed rows are shuffled. A batch without a good row is an error when
    its rows are read; a null flag counts as failed.
    """
    table = written(samples.withColumn(failed, F.coalesce(failed, F.lit(True))), "decoded")
    bad, good = table.where(failed), table.where(~F.col(failed))
    struck = bad.select(F.col(batch).alias("_batch")).distinct()
    last = good.join(struck, F.col(batch) == F.col("_batch"), "left_semi").groupBy(F.col(batch).alias("_batch")).agg(F.max_by(F.struct(*columns), slot).alias("_last"))
    joined = bad.join(last, F.col(batch) == F.col("_batch"), "left")
    none = F.raise_error(F.concat(F.lit("all samples failed in batch "), F.col(batch).cast("string")))
    own = [F.when(F.col("_last").isNull(), none.cast(dict(table.dtypes)[c])).otherwise(F.col(f"_last.`{c}`")).alias(c) if c in columns else F.col(c) for c in table.columns]
    return good.withColumn("replaced", F.lit(False)).unionByName(joined.select(*own, F.lit(True).alias("replaced")))


def pad_to_largest(samples: DataFrame, batch: str, tensor: str, shape: str, rank: int, fill: float = 0.0) -> DataFrame:
    """``samples`` with ``tensor`` filled up to its batch's largest extent along each of ``rank`` axes; ``padded_shape`` is that extent.

    ``shape`` keeps a sample's own extents. A null tensor stays null.
    """
    axes = [F.get(shape, F.lit(k)) for k in range(rank)]
    largest = samples.groupBy(F.col(batch).alias("_batch")).agg(F.array(*(F.max(a) for a in axes)).alias("padded_shape"))
    both = samples.drop("padded_shape").join(largest, F.col(batch).eqNullSafe(F.col("_batch"))).drop("_batch")
    whole = T.window(F.col(tensor), axes, [F.lit(0)] * rank, [F.get("padded_shape", F.lit(k)) for k in range(rank)], fill)
    return both.withColumn(tensor, F.when(F.col(tensor).isNotNull(), whole))


def flat_encodings(encoded: DataFrame, batch: str, slot: str) -> DataFrame:
    """(batch, labels, boxes): what ``matching.encode`` gives for each sample, end to end in the order of slots."""
    each = F.array_sort(F.collect_list(F.struct(F.col(slot).alias("slot"), F.col("encoded_labels").alias("labels"), F.col("encoded_boxes").alias("boxes"))))
    grouped = encoded.groupBy(batch).agg(each.alias("_s"))
    # A field of an array of structs is the array of that field.
    return grouped.select(batch, *(F.flatten(f"_s.{c}").alias(c) for c in ("labels", "boxes")))


def output_maxima(samples: DataFrame, columns: list[str]) -> dict[str, int]:
    """The largest value of each whole-number column, or length of each array column, in one pass."""
    kinds = dict(samples.dtypes)
    most = [F.max(F.size(c) if kinds[c].startswith("array") else F.col(c)).alias(f"m{i}") for i, c in enumerate(columns)]
    row = samples.agg(*most).first()
    return {c: row[f"m{i}"] for i, c in enumerate(columns)}
