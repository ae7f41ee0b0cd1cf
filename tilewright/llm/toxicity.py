"""Toxicity by a weighted lexicon.

Texts are folded: lower case, accents dropped, letters of other alphabets that
look like Latin ones and digits or signs that stand for letters replaced, so
that disguised spellings meet their entries. The lexicon is matched by one
Aho-Corasick automaton over folded text; an entry is a whole word or the
beginning of one. Exception phrases are matched in the same pass, and entries
inside one don't count. The weights found are summed, divided by a small power
of the number of words, at every length, and mapped to 0..1. One insult decides
a document, so the power is small; it is there because beginnings that
look toxic turn up by chance in long texts.

Lexicon and weights are learned with Spark from labelled rows, ``SAMPLE`` of
them at most: document counts by word and label, then by word beginning over
the vocabulary alone. Words of toxic documents that were copied often look toxic too, so in a
second pass an entry must be the strongest sign of a few documents, or stand in
many different contexts, which copies don't have. The lexicon has all such entries, or the strongest if ``limit`` says how many,
the only thing that reaches the driver; a warning tells when weaker ones were left out.

Defined results: a null or empty text scores 0; a label that is null or has no id is none; an
id with several labels counts once for each, and so does each row that repeats
a labelled id; rows that repeat an id keep their rows; ids may be of any type,
and meet those of labels as text; a very long text is scored whole; of equally strong
entries the lesser counts first; without labels or with an empty table the
lexicon is empty and all scores are 0; extra columns are ignored
(``drop_toxic`` keeps them).
"""

from __future__ import annotations

import math
import unicodedata
import warnings
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tilewright.llm.words import id_kind

#: Most entries of a learned lexicon, the strongest; None: all that are found, of which the sample's words are the bound.
LEXICON: int | None = None
#: Most labelled rows that are learned from: those of the least id hashes. So many ids can be broadcast.
SAMPLE = 30_000
#: Lengths of the word beginnings that are tried; whole words are tried at any length.
STEMS = range(4, 9)
#: An entry is the strongest sign in at least so many toxic documents ...
SUPPORT = 3
#: ... or stands after so many different words, as many as this share of its documents, at this ratio or more ...
CONTEXTS, CONTEXT_SHARE, CONTEXT_RATIO = 20, 0.2, 1000.0
#: ... and is so many times as frequent in toxic documents as in others.
RATIO = 14.0
THRESHOLD = 0.3
#: Weight of evidence at which the score reaches one half, for a text without words.
HALF = 6.0
#: Evidence is divided by this power of the words and one.
POWER = 0.1

#: Signs and digits that stand for letters, then look-alike letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
LOOKALIKES = dict(zip("абвгеікмнорстухѕјԁһԛԝαβγεικνορτυχω", "abbreikmhopctyxsjdhqwabyeikvoptyxw", strict=True))
#: Phrases inside which an entry does not count; given folded or not.
EXCEPTIONS = (
    "april fool", "booby trap", "clown fish", "crazy glue", "dumb bell", "dumb terminal", "dumb waiter", "fool proof",
    "garbage can", "garbage collection", "garbage collector", "garbage truck", "guinea pig", "idiot light", "idiot proof",
    "idiot savant", "killer app", "kill switch", "monkey wrench", "pathetic fallacy", "pig iron", "rat race", "snake oil",
    "trash bag", "trash bin", "trash can", "trash collection", "trash talk", "weed whacker", "white trash can", "witch hunt",
)


class _Fold(dict):
    """Translation table filled as characters come up: letters fold, all else parts words."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        c = LOOKALIKES.get(c[:1], c)
        base = unicodedata.normalize("NFKD", c)[:1]
        base = LOOKALIKES.get(base, base)
        out = base if base.isalpha() or base.isdigit() else "" if unicodedata.combining(chr(code)) or unicodedata.category(chr(code)) == "Cf" else " "
        out = SUBSTITUTES.get(out, out) if out != " " else SUBSTITUTES.get(c, " ") if c in "@$" else " "
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words between single blanks, with a blank at either end."""
    return f" {' '.join((text or '').translate(_FOLD).split())} "


def held_out(doc_id):
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _doc_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic) for each different word of each document, in batches of bounded size."""
    made = lambda words, toxic: pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], names=["word", "toxic"])
    for batch in batches:
        words, toxic = [], []
        for text, label in zip(*batch.columns):
            own = set(fold(text.as_py()).split())
            words += own
            toxic += [label.as_py()] * len(own)
            if len(words) >= 100_000:
                yield made(words, toxic)
                words, toxic = [], []
        yield made(words, toxic)


def learn(docs: DataFrame, labels: DataFrame, limit: int | None = LEXICON, sample: int = SAMPLE) -> list[tuple[str, bool, float]]:
    """The lexicon: (entry, whole word?, weight), learned from labelled rows that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    # Ids meet as text, so that they may be of different types.
    named = known.select(F.col("doc_id").cast("string").alias("doc_id"), "toxic")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").join(F.broadcast(named), "doc_id").select(F.col("text").cast("string").alias("text"), "toxic")
    totals = known.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    n_toxic, n_clean = (totals["t"] or 0), (totals["c"] or 0)
    if not n_toxic or not n_clean:
        return []
    counts = (
        rows.mapInArrow(_doc_words, "word string, toxic int")
        .groupBy("word")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    )
    lengths = F.array(*(F.lit(n) for n in STEMS))
    stems = counts.select(
        F.explode(
            F.concat(
                F.transform(F.filter(lengths, lambda n: n < F.length("word")), lambda n: F.struct(F.substring(F.col("word"), F.lit(1), n).alias("entry"), F.lit(False).alias("whole"))),
                F.array(F.struct(F.col("word").alias("entry"), F.lit(True).alias("whole"))),
            )
        ).alias("e"),
        "t",
        "c",
    )
    rate = ((F.col("t") + 0.5) / (n_toxic + 1.0)) / ((F.col("c") + 0.5) / (n_clean + 1.0))
    best = (
        stems.groupBy("e.entry", "e.whole")
        .agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        .withColumn("rate", rate)
        .where((F.col("t") >= SUPPORT) & (F.col("rate") >= RATIO))
        .orderBy(F.desc(F.col("t") * F.log("rate")), "entry", "whole")
    )
    best = best if limit is None else best.limit(limit + 1)
    # Bounded by the words of ``sample`` rows, and by ``limit`` if there is one.
    tried = [(r["entry"], r["whole"], math.log(r["rate"]), r["t"] * math.log(r["rate"])) for r in best.toLocalIterator()]
    if limit is not None and len(tried) > limit:
        warnings.warn(f"the lexicon is held to its {limit} strongest entries", stacklevel=2)
        del tried[limit:]
    if not tried:
        return []
    pure = {i for i, (_, _, weight, _) in enumerate(tried) if weight >= math.log(CONTEXT_RATIO)}
    support = (
        rows.where("toxic > 0")
        .mapInArrow(_signs(tried), "entry int, before int, strongest boolean")
        .groupBy("entry")
        .agg(F.count("*").alias("n"), F.countDistinct("before").alias("contexts"), F.count_if("strongest").alias("strongest"))
        .withColumn("spread", (F.col("contexts") >= CONTEXTS) & (F.col("contexts") >= CONTEXT_SHARE * F.col("n")))
        .select("entry", (F.col("strongest") >= SUPPORT).alias("needed"), "spread")
    )
    kept = {r["entry"] for r in support.toLocalIterator() if r["needed"] or (r["spread"] and r["entry"] in pure)}
    return [(entry, whole, weight) for i, (entry, whole, weight, _) in enumerate(tried) if i in kept]


def _signs(tried: list[tuple[str, bool, float, float]]):
    """For each document the entries it holds: their number, a hash of the word before, and whether it is the strongest.

    Of equally strong entries the whole word counts, then the longest.
    """
    order = sorted(range(len(tried)), key=lambda i: (tried[i][3], tried[i][1], len(tried[i][0])))
    place = {i: n for n, i in enumerate(order)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for i, (entry, whole, _, _) in enumerate(tried):
            key = f" {entry} " if whole else f" {entry}"
            automaton.add_word(key, (i, len(key)))
        automaton.make_automaton()
        for batch in batches:
            entries, before, strongest = [], [], []
            for text in batch.column(0).to_pylist():
                folded = fold(text)
                found: dict[int, int] = {}
                for end, (i, size) in automaton.iter(folded):
                    found.setdefault(i, end - size + 1)
                best = max(found, key=place.get, default=-1)
                for i, start in found.items():
                    entries.append(i)
                    before.append(zlib.crc32(folded[folded.rfind(" ", 0, start) + 1 : start].encode()) & 0x7FFFFFFF)
                    strongest.append(i == best)
            cols = [pa.array(entries, pa.int32()), pa.array(before, pa.int32()), pa.array(strongest, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["entry", "before", "strongest"])

    return run


class Matcher:
    """The automaton of one lexicon."""

    def __init__(self, lexicon: list[tuple[str, bool, float]], exceptions=EXCEPTIONS) -> None:
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, tuple[int, float]] = {}
        for entry, whole, weight in lexicon:
            key = f" {entry} " if whole else f" {entry}"
            entries[key] = (len(key), max(weight, entries.get(key, (0, 0.0))[1]))
        for phrase in exceptions:
            key = fold(phrase)
            entries[key] = (len(key), -1.0)
        for key, value in entries.items():
            self.automaton.add_word(key, value)
        self.any = bool(entries)
        if self.any:
            self.automaton.make_automaton()

    def evidence(self, folded: str) -> tuple[float, int]:
        """(sum over matched words of the greatest weight of an entry, number of matched words)."""
        if not self.any:
            return 0.0, 0
        best: dict[int, float] = {}
        safe: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight < 0:
                safe.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        for a, b in safe:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        return sum(best.values()), len(best)

    def score(self, text: str | None) -> tuple[float, int]:
        folded = fold(text)
        weight, hits = self.evidence(folded)
        if not hits:
            return 0.0, 0
        n_words = folded.count(" ") - 1
        x = weight / (1 + n_words) ** POWER
        return x / (x + HALF), hits


def score(docs: DataFrame, lexicon: list[tuple[str, bool, float]], exceptions=EXCEPTIONS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, score, n_hits, predicted) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(lexicon, exceptions)
        for batch in batches:
            found = [m.score(t.as_py()) for t in batch.column(2)]
            scores = np.fromiter((s for s, _ in found), np.float64, len(found))
            hits = pa.array([n for _, n in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), hits], names=["doc_id", "text_hash", "score", "n_hits"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_kind(docs, doc_id)}, text_hash long, score double, n_hits long").withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns are kept, and no row leaves its partition."""
    lexicon = learn(docs, labels)

    @F.pandas_udf(DoubleType())
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher(lexicon)
        for texts in batches:
            yield pd.Series([m.score(t)[0] for t in texts], dtype="float64")

    return docs.where(scores(F.col("text")) < THRESHOLD)
