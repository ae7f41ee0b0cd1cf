"""Linear work on long arrays and texts inside one row, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.tensor import let

_BLOCK = 256
_CHARS = 4096


def prefixes(values: Column, fold: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """What ``fold`` makes of 0 and all values before each one: running sums by default.

    Appending to an array copies it, which is quadratic over a long one. So
    blocks are folded by themselves and the blocks' totals once more.
    """
    none = F.expr("cast(array() as array<int>)")

    def add(acc: Column, x: Column) -> Column:
        return F.struct(fold(acc["at"], x).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before"))

    within = lambda block: F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("before")), add)
    starts = lambda v: F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(v)), F.lit(_BLOCK))
    folded = let(values, lambda v: F.transform(starts(v), lambda i: within(F.slice(v, i, F.lit(_BLOCK)))))

    def joined(parts: Column) -> Column:
        totals = within(F.transform(parts, lambda p: p["at"]))["before"]
        return F.flatten(F.zip_with(parts, totals, lambda p, t: F.transform(p["before"], lambda x: fold(t, x))))

    return let(folded, joined)


def blocks(text: Column) -> Column:
    """``text`` in pieces of ``_CHARS`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHARS}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text given as ``blocks``; none if the end is before the start.

    A substring of the text itself is found by counting from its beginning.
    """
    at = lambda i: F.floor(i / F.lit(_CHARS)).cast("int")
    block = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    first, last, skip = at(start), at(end), start % _CHARS
    whole = F.array_join(F.slice(pieces, first + 2, F.greatest(F.lit(0), last - first - 1)), "")
    several = F.concat(F.substring(block(first), skip + 1, F.lit(_CHARS)), whole, F.substring(block(last), F.lit(1), end % _CHARS))
    return F.when(end <= start, F.lit("")).when(first == last, F.substring(block(first), skip + 1, end - start)).otherwise(several)
