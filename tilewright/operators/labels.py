"""Label and annotation readers' relational parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the file name, without query or fragment; empty if there is none."""
    return F.lower(F.regexp_extract(basename(F.regexp_extract(path, r"^[^?#]*", 0)), r"\.([^.]+)$", 1))


def folder_labels(names: DataFrame, folder: str) -> DataFrame:
    """Adds ``label``: the ordinal of the folder among the sorted folders.

    Distinct folders are few next to files; they are ranked apart and joined
    back, so that no sort sees all rows.
    """
    rank = names.select(folder).distinct().withColumn("label", F.dense_rank().over(Window.orderBy(folder)) - 1)
    return names.join(rank, folder)


def first_label(labels: DataFrame, name: str, label: str, order: str) -> DataFrame:
    """One label for each name: that of the first row in ``order``."""
    return labels.groupBy(name).agg(F.min_by(label, order).alias(label))


def lookup(samples: DataFrame, labels: DataFrame, name: str, order: str | None = None) -> DataFrame:
    """Samples with their labels; a sample without one is an error.

    Of labels that repeat a name the first in ``order`` counts, or the least
    without one, so that samples are never multiplied.
    """
    rest = [c for c in labels.columns if c != name]
    facts = F.struct(*rest) if rest else F.struct(F.lit(True).alias("_any"))
    first = F.min_by(facts, order) if order else F.min(facts)
    one = labels.groupBy(name).agg(first.alias("_label")).select(name, *(F.col(f"_label.`{c}`").alias(c) for c in rest), F.lit(True).alias("_found"))
    found = samples.join(one, name, "left")
    check = F.assert_true(F.col("_found").isNotNull(), F.concat(F.lit("no label for "), F.col(name).cast("string")))
    return found.where(check.isNull()).drop("_found")


def labelled_only(samples: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    return samples.join(labels, name, "left_semi")


def unlabelled(samples: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    return samples.join(labels, name, "left_anti")


def parse_label_lines(lines: DataFrame, value: str = "value", order: str | None = None) -> DataFrame:
    """(name, label, line) from ``name label`` lines; lines that don't parse are left out, the first of equal names counts.

    ``order`` names a column that puts the lines in order; without it they
    count as they come, which is their order in one file that isn't split.
    """
    parts = F.split(F.trim(F.col(value)), r"\s+")
    line = F.col(order) if order else F.monotonically_increasing_id()
    rows = lines.select(basename(F.get(parts, F.lit(0))).alias("name"), F.get(parts, F.lit(1)).try_cast("int").alias("label"), line.alias("line"))
    return rows.where("name <> '' and label is not null").groupBy("name").agg(F.min_by("label", "line").alias("label"), F.min("line").alias("line"))


def contiguous_classes(categories: DataFrame, category: str = "category_id", order: str = "position") -> DataFrame:
    """Adds ``class``: 1..n in file order. Categories are a small dimension."""
    return categories.withColumn("class", F.row_number().over(Window.orderBy(order, category)))
