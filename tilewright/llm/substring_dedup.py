"""Substring dedup by hashing lines.

Texts are cut into units, units are normalised (case, punctuation and white
space do not count) and hashed, digests are grouped over the whole corpus, and
every occurrence but the earliest ranked is removed. Rank is (doc_id, start).
Removed units keep their offsets in the original text.

A unit is a line. A line of more than ``WINDOW + GRAM - 1`` words is cut further where the
text itself says so: at the least hash of each run of ``WINDOW`` word
``GRAM``-grams. Such cuts depend on nearby words alone, so a passage that was
pasted into the middle of a line gives the same units there as elsewhere;
whole-line hashes would miss it. A unit of under ``REACH`` words is hashed
together with the words that follow it in its line (or precede it, at the
end). A line of fewer words is hashed whole, however short it is; one without
words by its characters, white space at its ends aside. Blank lines have no
unit.

Defined results: a null text stays null and has no units; a very long text has
as many units as its lines and cuts; ids may be of any type that has an order;
null ids rank first;
of rows that repeat an id and a text all are one occurrence of their units,
and are treated alike; an empty table gives an empty table; extra columns are
kept by ``dedup`` and ignored elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tilewright.llm.words import id_kind
from tilewright.storage import written

REACH = 12
WINDOW = 24
GRAM = 3

_WORD = re.compile(r"[^\W_]+")
_SCHEMA = "text_hash long, start int, end int, n_words int, digest binary"
_ARROW = pa.schema([("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32()), ("digest", pa.binary())])


def text_units(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit of one text that can be removed."""
    spans = [m.span() for m in _WORD.finditer(text)]
    breaks = np.fromiter((m.start() for m in re.finditer("\n", text)), np.int64)
    line_start, line_end = np.r_[0, breaks + 1], np.r_[breaks, len(text)]
    begin = np.fromiter((a for a, _ in spans), np.int64, len(spans))
    line = np.searchsorted(breaks, begin)
    wordless = np.ones(len(line_start), bool)
    wordless[line] = False
    out = []
    for start, end in zip(line_start[wordless].tolist(), line_end[wordless].tolist()):
        if signs := text[start:end].strip():
            out.append((start, end, 0, xxhash.xxh3_128(signs.encode()).digest()))
    if not spans:
        return out
    low = [text[a:b].lower().encode() for a, b in spans]
    n = len(low)
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    last = np.r_[first[1:], n]
    cuts = [first]
    span = WINDOW + GRAM - 1
    if n >= span:
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in low), np.uint64, n)
        grams = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
        inside = line[: n - span + 1] == line[span - 1 :]
        if inside.any():
            least = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[inside].argmin(axis=1)
            cuts.append(np.unique(np.flatnonzero(inside) + least))
    cut = np.unique(np.concatenate(cuts))
    stop = np.r_[cut[1:], n]
    which = np.searchsorted(first, cut, "right") - 1
    lo, hi = first[which], last[which]
    to = np.minimum(np.maximum(stop, cut + REACH), hi)
    frm = np.minimum(cut, np.maximum(lo, to - REACH))
    # Units tile their line, so that nothing is left between two that go.
    a_off = np.where(cut == lo, line_start[line[cut]], begin[cut])
    b_off = np.where(stop == hi, line_end[line[cut]], begin[np.minimum(stop, n - 1)])
    joined = b" ".join(low)
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, n) + 1)
    at = np.r_[0, ends[:-1]]
    for a, b, f, t, start, end in zip(*(x.tolist() for x in (cut, stop, frm, to, a_off, b_off))):
        # The place of the unit inside what is hashed: the head and the tail of one range are not the same unit.
        digest = xxhash.xxh3_128(joined[at[f] : ends[t - 1] - 1], seed=(a - f) << 20 | (b - a)).digest()
        out.append((start, end, b - a, digest))
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(batch: pa.RecordBatch, rows: list[int], cols: list[list]) -> pa.RecordBatch:
        which = pa.array(rows, pa.int32())
        own = [pa.array(c, f.type) for c, f in zip(cols, _ARROW)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), *own], names=["doc_id", "text_hash", *_ARROW.names])

    for batch in batches:
        rows, cols = [], [[] for _ in _ARROW]
        for i, text in enumerate(batch.column(2).to_pylist()):
            for unit in text_units(text):
                rows.append(i)
                for col, value in zip(cols, unit):
                    col.append(value)
            if len(rows) >= 50_000:
                yield made(batch, rows, cols)
                rows, cols = [], [[] for _ in _ARROW]
        yield made(batch, rows, cols)


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, start, end, n_words, digest) of every unit that can be removed."""
    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text")
    )
    return rows.mapInArrow(_units, f"doc_id {id_kind(docs, doc_id)}, {_SCHEMA}")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The units to remove: doc_id, text_hash, start, end, n_words, digest, kept_doc_id, kept_start, copies.

    A digest's first occurrence is found by a grouped minimum, which combines
    before the shuffle. The minima of repeated digests are written, so that the
    join back has exchanges of its own on both sides: only then can the engine
    split the rows of a hot digest, whose other side is one row.
    """
    found = written(units(docs, doc_id, text), "units")
    first = written(
        found.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "start", "text_hash")).alias("first"), F.count("*").alias("copies"))
        .where("copies > 1"),
        "first",
    )
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("start") == F.col("first.start")) & (F.col("text_hash") == F.col("first.text_hash"))
    return (
        found.join(first, "digest")
        .where(~own)
        .select(
            "doc_id", "text_hash", "start", "end", "n_words", F.lower(F.hex("digest")).alias("digest"),
            F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"), "copies",
        )
    )


@F.pandas_udf(StringType())
def without(text: pd.Series, spans: pd.Series) -> pd.Series:
    """``text`` less the given sorted, disjoint spans, each (start, end); null spans take nothing away.

    In Python, since the JVM's strings find a code point by counting from the
    start, which is quadratic where a long text loses many units.
    """

    def one(body: str | None, cut) -> str | None:
        if body is None or cut is None:
            return body
        at, out = 0, []
        for start, end in cut:
            out.append(body[at:start])
            at = end
        return "".join([*out, body[at:]])

    return pd.Series([one(t, s) for t, s in zip(text, spans)], dtype=object)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated units cut out of the text, and the cut spans in ``removed_spans``, which replaces a column of that name."""
    gone = (
        repeats(docs, doc_id, text)
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
        .alias("g")
    )
    d = docs.alias("d")
    body, spans = F.col(f"d.`{text}`"), F.col("g.spans")
    same = F.col(f"d.`{doc_id}`").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64(body) == F.col("g.text_hash"))
    cut = without(body, F.transform(spans, lambda s: F.array(s["start"], s["end"]))).alias(text)
    kept = [cut if c == text else F.col(f"d.`{c}`") for c in docs.columns if c != "removed_spans"]
    return d.join(gone, same, "left").select(*kept, spans.alias("removed_spans"))
