"""Term statistics by language and source, with strings joined back late.

Counting shuffles digests of a fixed width instead of terms. A first scan counts
the documents of each digest, and only terms that enough documents of their
language hold are kept, so a digest below that number needs no string at all.
For the digests that are left a second scan counts occurrences by source, and a
third brings their least and their greatest string: where both are equal the
digest stands for one term; where they differ it is split, and its strings are
counted by themselves. Text is joined to statistics only for the rows that a
report keeps.

A digest's number of documents is at least that of each of its terms, so no
term is lost to a collision, and a split digest's terms are held to the bound
one by one.

Statistics: with N occurrences of V kept terms, a term that occurs n times has
p = 1 + floor(scale * (n + smooth) / (N + smooth * V)), in whole numbers.

Defined results: null texts, languages and sources count as empty strings; a
group without kept terms keeps its row everywhere; rows are documents of their
own, ids aren't looked at, and repeated rows count again; very long texts count
in proportion; an empty table gives empty tables; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.storage import written

MIN_DOCS = 30
SMOOTH, SCALE = 5, 1_000_000_000
TOP = 50
#: Width of a digest.
BITS = 64
#: Different terms of groups that a task holds before it hands their counts on.
HELD = 400_000
#: Digests that tasks hold, to keep a scan to them; beyond it they are joined.
BROADCAST_ROWS = 1_000_000

#: ASCII: letters count, A-Z as a-z, all others end a term. Bytes beyond it belong to non-ASCII characters and count.
_FOLD = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_FOLD).split()


def _digests(terms: list[bytes], bits: int) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms))
    return (h >> np.uint64(64 - bits)).view(np.int64)


def _scan(docs: DataFrame, bits: int, by_source: bool, value: str = "n", text: bool = False, only: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(lang, source, digest, value): for the terms of each task their occurrences, or with value "docs" their documents; with ``text`` also the term.

    A task that holds many terms hands them on in between. Without ``by_source``
    all sources of a language count as one. ``only`` names digests by language
    and passes over all others.
    """
    names = ["lang", "source", "digest", value] + ["term"] * text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in held.items():
                terms, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                digests = _digests(terms, bits)
                if only is not None:
                    which = np.flatnonzero(np.isin(digests, only.get(lang, [])))
                    digests, n, terms = digests[which], n[which], [terms[i] for i in which.tolist()] if text else which
                columns = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(digests), pa.array(n)]
                columns += [pa.array(terms, pa.binary()).cast(pa.string())] if text else []
                yield pa.RecordBatch.from_arrays(columns, names=names)
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, body in zip(*(batch.column(i) for i in range(3))):
                key = (lang.as_py(), source.as_py())
                counts = held.get(key)
                if counts is None:
                    counts = held[key] = Counter()
                size -= len(counts)
                words = terms_of(body.as_py())
                counts.update(set(words) if value == "docs" else words)
                size += len(counts)
                if size > HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    lang, source = _group(docs)
    kinds = f"lang string, source string, digest long, {value} long" + ", term string" * text
    return docs.select(lang, source if by_source else F.lit(None).cast("string").alias("source"), body).mapInArrow(run, kinds)


def _group(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def _by_source(counts: DataFrame, key: list[str]) -> DataFrame:
    """(*key, source, n, total): sums by source, and ``total`` over all sources.

    Dealt by key alone, so that one shuffle serves both sums.
    """
    sums = counts.repartition(*key).groupBy(*key, "source").agg(F.sum("n").alias("n"))
    return sums.withColumn("total", F.sum("n").over(Window.partitionBy(*key)))


def _within(digests: DataFrame) -> tuple[dict[str, np.ndarray] | None, Callable[[DataFrame], DataFrame]]:
    """How a scan keeps to (lang, digest): by a list that tasks hold if its size allows, else by a join."""
    if digests.count() > BROADCAST_ROWS:
        return None, lambda scanned: scanned.join(digests, ["lang", "digest"])
    found = digests.toPandas()
    return {lang: np.sort(some.to_numpy(np.int64)) for lang, some in found.groupby("lang")["digest"]}, lambda scanned: scanned


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (lang, digest, part, source, n, total) and the text of each key, (lang, digest, part, term).

    ``part`` numbers the terms of a digest that stands for several, and is 0 for all others.
    """
    key = ["lang", "digest"]
    often = _scan(docs, bits, False, "docs").groupBy(*key).agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    only, held_to = _within(written(often.select(*key), "digests"))
    counted = written(_by_source(held_to(_scan(docs, bits, True, only=only)), key), "counts")
    strings = held_to(_scan(docs, bits, False, "docs", True, only)).groupBy(*key).agg(F.min("term").alias("term"), F.max("term").alias("greatest"))
    strings = written(strings, "strings")
    clear = strings.where("term = greatest").select(*key, F.lit(0).alias("part"), "term")
    mixed = strings.where("term <> greatest").select(*key)
    if mixed.isEmpty():
        return counted.withColumn("part", F.lit(0)), clear
    only, held_to = _within(mixed)
    whole = [*key, "term"]
    often = held_to(_scan(docs, bits, False, "docs", True, only)).groupBy(*whole).agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    named = written(often.select(*whole, F.row_number().over(Window.partitionBy(*key).orderBy("term")).alias("part")), "named")
    apart = _by_source(held_to(_scan(docs, bits, True, "n", True, only)), whole).join(named, whole)
    split = apart.select(*key, "part", "source", "n", "total")
    # Mixed digests go, by a join that keeps only what stands for one term.
    single = counted.join(clear.select(*key, "part"), key)
    return written(single.select(*split.columns).unionByName(split), "counts"), clear.unionByName(named.select(clear.columns))


def groups(docs: DataFrame) -> DataFrame:
    """Every (lang, source) that occurs, with terms or without."""
    return docs.select(*_group(docs)).distinct()


def _share(n: Column, size: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (size + SMOOTH * kept)), exact beyond a long's range; null where nothing is kept."""
    whole = lambda x: x.cast("decimal(19,0)")
    top, below = whole(n + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), whole(size + SMOOTH * kept)
    return F.when(below > 0, F.call_function("div", top, below) + 1)


def _sizes(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """Each group with its number ``i`` within the language, its size, the language's, the kept terms and ``zero``, the share of a term that isn't there."""
    size = counted.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    kept = counted.select("lang", "digest", "part").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    lang = Window.partitionBy("lang")
    both = groups(docs).join(size, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["size", "kept"])
    whole = both.withColumns({"i": F.row_number().over(lang.orderBy("source")) - 1, "lang_size": F.sum("size").over(lang)})
    return written(whole.withColumn("zero", _share(F.lit(0), F.col("size"), F.col("kept"))), "groups")


#: Up to so many sources of a language a task sums their distances in a matrix; beyond, each row of it is handed on.
_MATRIX = 1000


def _distances(shares: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, a, b, value): for sources numbered a < b the sum of the differences of their shares over all kept terms."""
    zeros = sizes.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "zero"))).alias("z")).select("lang", F.col("z.zero").alias("zeros"))
    terms = shares.groupBy("lang", "digest", "part").agg(F.collect_list(F.struct("i", "p")).alias("e"))
    rows = terms.join(zeros, "lang").select("lang", "zeros", F.col("e.i").alias("i"), F.col("e.p").alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def row(lang: str, a: int, values: np.ndarray) -> pa.RecordBatch:
            n = len(values)
            columns = [pa.array([lang] * n), pa.array(np.full(n, a, np.int32)), pa.array(np.arange(a + 1, a + 1 + n, dtype=np.int32)), pa.array(values)]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

        def some(lang: str, zeros: np.ndarray, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            lists = part.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            dense = np.tile(zeros, (part.num_rows, 1))
            dense[np.repeat(np.arange(part.num_rows), sizes), lists.flatten().to_numpy()] = part.column(3).flatten().to_numpy()
            for a in range(len(zeros) - 1):
                apart = np.abs(dense[:, a + 1 :] - dense[:, a : a + 1]).sum(axis=0)
                if len(zeros) > _MATRIX:
                    yield row(lang, a, apart)
                else:
                    sums.setdefault(lang, np.zeros((len(zeros), len(zeros)), np.int64))[a, a + 1 :] += apart

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                mine = batch.filter(pa.array(langs == lang))
                zeros = mine.column(1)[0].values.to_numpy()
                step = max(1, (1 << 20) // len(zeros))
                for at in range(0, mine.num_rows, step):
                    yield from some(lang, zeros, mine.slice(at, step))
        for lang, matrix in sums.items():
            for a in range(len(matrix) - 1):
                yield row(lang, a, matrix[a, a + 1 :])

    return rows.mapInArrow(run, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def report(docs: DataFrame, top: int = TOP, min_docs: int = MIN_DOCS, bits: int = BITS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's terms are from those of its language.

    Part ``pair`` ranks the other sources by the summed difference of shares,
    part ``term`` the ``top`` terms whose share most exceeds the language's;
    ties go to the lesser item.
    """
    counted, texts = kept_terms(docs, min_docs, bits)
    sizes = _sizes(docs, counted)
    shares = counted.join(sizes, ["lang", "source"]).withColumns(
        {"p": _share(F.col("n"), F.col("size"), F.col("kept")), "q": _share(F.col("total"), F.col("lang_size"), F.col("kept"))}
    )
    by = Window.partitionBy("lang", "source")
    over = shares.where("p > q").select("lang", "source", "digest", "part", (F.col("p") - F.col("q")).alias("value"))
    most = over.withColumn("place", F.rank().over(by.orderBy(F.desc("value")))).where(F.col("place") <= top)
    terms = most.join(texts, ["lang", "digest", "part"]).withColumn("item", F.col("term"))
    a, b = (sizes.select("lang", F.col("source").alias(name), F.col("i").alias(i)) for name, i in (("source", "x"), ("item", "y")))
    pairs = a.join(b, "lang").where("x <> y").select("lang", "source", "item", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = pairs.join(_distances(shares, sizes), ["lang", "a", "b"], "left").fillna(0, ["value"])
    ranked = lambda df, part: df.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by.orderBy(F.desc("value"), "item")).alias("rank")
    )
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))
