"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a local session makes a temporary folder and
    records it, so that later calls agree on it; a cluster, whose executors
    don't see the driver's folders, is refused.
    """
    base = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{_KEY} has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tilewright-")
        spark.conf.set(_KEY, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/tilewright/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table: computed once, and safe when executors are lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Removes all tables that the library wrote to the shared folder; for the end of a job, when no result that reads them is left."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tilewright")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
