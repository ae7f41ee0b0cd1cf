"""The corpus pipeline: each stage works on all that the stage before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``documents``.

Defined results: a null or empty text scores no toxicity, is a near duplicate of
the other texts without words, of which one stays, is never contaminated, holds
no secret and gives no tokens; null labels, benchmark texts and languages count
for nothing; rows of equal id and equal text are one document and stay together,
and of a group of near duplicates that of the least id, then of the least hash of
its text, is the one that stays, null ids last; ids may be of any type that has
an order; very long texts go through whole; with empty documents all stages give
an empty table, with empty labels nothing is toxic and with an empty benchmark
nothing is contaminated; extra columns, whatever they are called, are kept up to
the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import bpe, decontaminate, secrets, simhash, toxicity
from tilewright.llm.queries import VOCABULARY
from tilewright.storage import written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts, and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, VOCABULARY)


STAGES = [
    ("toxicity", toxic),
    ("simhash", near_duplicates),
    ("decontamination", benchmark),
    ("secrets", secret),
    ("bpe", tokens),
]

#: A tokenizer's merges and a learned lexicon can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
