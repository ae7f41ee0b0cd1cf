"""Word arrays made with built-in functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Everything that ends a word: ASCII characters other than digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def id_kind(docs: DataFrame, doc_id: str) -> str:
    """The type of an id column, as a schema has it: ids are carried as they are, whatever they are."""
    return docs.select(F.col(doc_id)).schema[0].dataType.simpleString()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; ``lower`` has a fast path that is right for pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """Maximal runs of digits, letters and non-ASCII characters; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of parameters as SQL literals: nothing is pickled and no Python worker reads it."""

    def one(value) -> str:
        if isinstance(value, str):
            escaped = value.replace("\\", "\\\\").replace("'", "\\'")
            return f"'{escaped}'"
        return "NULL" if value is None else str(value).lower()

    listed = ", ".join(f"({', '.join(map(one, row))})" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({', '.join(names)})")
