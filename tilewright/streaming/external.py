"""The external source: samples fed from outside, as a stream.

A feeder appends files of rows to a folder; the stream picks them up in order
and ends when told to work off what is there (``availableNow``). Batches are
cut by a sample's own number, so a sample's place does not depend on how files
fell into micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "sample long, name string, content binary, label int, roi_w int, roi_h int"


def feed(rows: DataFrame, path: str) -> None:
    """Appends samples for the stream to pick up."""
    rows.write.mode("append").parquet(path)


def stream(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def batched(samples: DataFrame, batch: int, sample: str = "sample") -> DataFrame:
    """Adds ``batch_id`` and ``slot``; works on streams and tables alike."""
    return samples.withColumns({"batch_id": F.floor(F.col(sample) / batch), "slot": (F.col(sample) % batch).cast("int")})


def deliver(samples: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, until_empty: bool = True) -> StreamingQuery:
    """Hands each micro-batch to ``sink(rows, number)``; a restarted stream repeats a number with the same rows."""
    writer = samples.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if until_empty else writer).start()


def label_counts(samples: DataFrame) -> DataFrame:
    """Running number of samples by label, for output mode "complete" or "update"."""
    return samples.groupBy("label").agg(F.count("*").alias("n"))
