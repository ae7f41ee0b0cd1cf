"""Benchmark decontamination over a distributed positional inverted index.

The training side is stored as postings (term, document, position) of the
terms that the query will look up. Each test window is looked up from its
rarest terms: their postings, shifted back by the term's offset in the window,
must agree on one start. What survives is compared word by word.

Proximity matches are found in the same way, from starts that agree within
``slop`` words: a window stands near a start if each of its words stands at its
own place or up to ``slop`` words after it.

Defined results: a null text has no words; a null or repeated ``doc_id`` keeps
one output row for each input row; benchmark rows whose text is null or has no
words give no window; equal items all count; of equally rare terms of a window
the first is looked up; very long texts and empty tables need nothing special:
a text's postings are rows, its hits one array; extra columns are ignored.
Everything is built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.storage import written
from tilewright.llm.words import words

WINDOW = 13
#: How far the words of a proximity match may stand behind their places.
SLOP = 2
#: Rarest terms of a window whose postings are intersected.
RAREST = 2
#: Rows and bytes up to which a table made from the benchmark is broadcast; beyond either the join shuffles.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def _small(df: DataFrame, rows: int, longest: int = 0) -> DataFrame:
    """``df``, to be broadcast if it holds few rows and few bytes; ``longest`` bounds the bytes of a row's strings."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * (64 + longest) <= BROADCAST_BYTES else df


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, text): a key that also tells apart rows which share an id."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(text)).alias("text_hash"),
        F.col(text).alias("text"),
    )


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows: (window_id, terms, n, items), ``items`` being the sorted ids as strings.

    An item with fewer than ``size`` words is one window. The list of items is
    bounded by the benchmark, not by the training data.
    """
    w = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    wins = w.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("terms"))
    return (
        wins.groupBy("terms")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select(F.unhex(F.md5(F.array_join("terms", " ").cast("binary"))).alias("window_id"), "terms", F.size("terms").alias("n"), "items")
    )


def term_counts(docs: DataFrame, vocabulary: DataFrame, vocabulary_rows: int, longest: int = 0, text: str = "text") -> DataFrame:
    """(term, count): how often each term of ``vocabulary`` occurs in the whole corpus."""
    terms = docs.select(F.explode(words(F.col(text))).alias("term"))
    return terms.join(_small(vocabulary, vocabulary_rows, longest), "term", "left_semi").groupBy("term").count()


def rarest_terms(windows: DataFrame, counts: DataFrame, counts_rows: int, longest: int = 0, rarest: int = RAREST) -> DataFrame:
    """(term, window_id, offset, rank): the ``rarest`` terms of each window; ties go to the first offset."""
    terms = windows.select("window_id", F.posexplode("terms").alias("offset", "term"))
    order = Window.partitionBy("window_id").orderBy(F.coalesce("count", F.lit(0)), "offset")
    return (
        terms.join(_small(counts, counts_rows, longest), "term", "left")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= rarest)
        .select("term", "window_id", "offset", "rank", F.coalesce("count", F.lit(0)).alias("count"))
    )


def build_index(
    docs: DataFrame, terms: DataFrame, terms_rows: int, longest: int = 0, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The stored index: (term, doc_id, text_hash, position), restricted to ``terms``.

    Postings stay in the files of the documents they come from, so one frequent
    term's spread over many files. Repeated rows repeat their postings.
    """
    tokens = _keyed(docs, doc_id, text).select("doc_id", "text_hash", F.posexplode(words(F.col("text"))).alias("position", "term"))
    return tokens.join(_small(terms, terms_rows, longest), "term", "left_semi").select("term", "doc_id", "text_hash", "position")


def _starts(index: DataFrame, anchors: DataFrame, anchors_rows: int, longest: int = 0) -> DataFrame:
    """(window_id, doc_id, text_hash, offset, rank, start): postings shifted back by the term's offset."""
    return (
        index.join(_small(anchors.select("term", "window_id", "offset", "rank"), anchors_rows, longest), "term")
        .select("window_id", "doc_id", "text_hash", "offset", "rank", (F.col("position") - F.col("offset")).alias("start"))
    )


def intersect(index: DataFrame, anchors: DataFrame, anchors_rows: int, longest: int = 0) -> DataFrame:
    """(window_id, doc_id, text_hash, start) on which all of a window's rarest terms agree."""
    need = anchors.groupBy("window_id").agg(F.count("*").alias("need"))
    return (
        _starts(index, anchors, anchors_rows, longest)
        .where("start >= 0")
        .groupBy("window_id", "doc_id", "text_hash", "start")
        .agg(F.bit_count(F.bit_or(F.expr("shiftleft(1, rank)"))).alias("got"))
        .join(_small(need, anchors_rows), "window_id")
        .where("got = need")
        .select("window_id", "doc_id", "text_hash", "start")
    )


def proximity_matches(index: DataFrame, anchors: DataFrame, anchors_rows: int, slop: int) -> DataFrame:
    """Places where a window's rarest terms stand within ``slop`` words of their exact distances.

    Returns (window_id, doc_id, text_hash, start), ``start`` being the smallest
    shifted position of each place.
    """
    place = Window.partitionBy("window_id", "doc_id", "text_hash").orderBy("start").rangeBetween(0, slop)
    need = anchors.groupBy("window_id").agg(F.count("*").alias("need"))
    return (
        _starts(index, anchors, anchors_rows)
        .withColumn("near", F.size(F.collect_set("offset").over(place)))
        .join(_small(need, anchors_rows), "window_id")
        .where("near = need")
        .select("window_id", "doc_id", "text_hash", "start")
        .distinct()
    )


def near_starts(index: DataFrame, anchors: DataFrame, anchors_rows: int, longest: int = 0, slop: int = SLOP) -> DataFrame:
    """(window_id, doc_id, text_hash, start) from which all of a window's rarest terms stand within ``slop`` words of their places.

    A posting speaks for the starts that it can be near to; no group is sorted.
    """
    need = anchors.groupBy("window_id").agg(F.count("*").alias("need"))
    return (
        _starts(index, anchors, anchors_rows, longest)
        .select("window_id", "doc_id", "text_hash", "rank", F.explode(F.sequence(F.col("start") - slop, F.col("start"))).alias("start"))
        .groupBy("window_id", "doc_id", "text_hash", "start")
        .agg(F.bit_count(F.bit_or(F.expr("shiftleft(1, rank)"))).alias("got"))
        .join(_small(need, anchors_rows), "window_id")
        .where("got = need")
        .select("window_id", "doc_id", "text_hash", "start")
    )


def _stands_near(w: Column, h: Column, slop: int) -> Column:
    """Whether each word of a candidate's phrase stands in ``w`` at its place or up to ``slop`` words after it."""
    terms = F.split(h["phrase"], " ")

    def one(t: Column, i: Column) -> Column:
        first, last = F.greatest(F.lit(0), h["start"] + i), h["start"] + i + slop
        return F.array_contains(F.slice(w, first + 1, F.greatest(F.lit(0), last - first + 1)), t)

    return F.forall(F.transform(terms, one), lambda x: x)


def _covered(hits: Column) -> Column:
    """Number of positions inside the union of the hits' half-open ranges."""
    ranges = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("a"), (h["start"] + h["n"]).alias("b"))))
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        ranges,
        zero,
        lambda acc, r: F.struct(
            F.greatest(acc["upto"], r["b"]).alias("upto"),
            (acc["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(acc["upto"], r["a"]))).alias("n"),
        ),
    )["n"]


def _places(hits: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(hits, lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n")))))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    share: int = 20,
    slop: int | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items, spans, contaminated, text_hash.

    ``spans`` are the exact phrase matches as (start, n) in words. A document is
    contaminated if it has hits and ``share * n_hit >= n_words``. With ``slop``
    also n_near, the number of different windows that stand near some start,
    exact matches included, and ``near``, those starts as (start, n).
    """
    windows = written(item_windows(items, item_id, item_text, size), "windows")
    # Words may have any length, so the longest phrase counts in what is broadcast; item lists never are.
    phrase = F.array_join("terms", " ")
    facts = windows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.octet_length(phrase)), F.lit(0)).alias("longest")).first()
    n_windows, longest = facts["n"], facts["longest"]
    n_terms, n_anchors = n_windows * size, n_windows * RAREST
    vocabulary = windows.select(F.explode("terms").alias("term")).distinct()
    counts = term_counts(docs, vocabulary, n_terms, longest, text)
    anchors = written(rarest_terms(windows, counts, n_terms, longest), "anchors")
    index = written(build_index(docs, anchors.select("term").distinct(), n_anchors, longest, doc_id, text), "postings")
    starts = intersect(index, anchors, n_anchors, longest).withColumn("near", F.lit(False))
    if slop is not None:
        starts = starts.unionByName(near_starts(index, anchors, n_anchors, longest, slop).withColumn("near", F.lit(True)))
    candidates = (
        starts
        .join(_small(windows.select("window_id", "n", phrase.alias("phrase")), n_windows, longest), "window_id")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("start", "n", "phrase", "window_id", "near")).alias("found"))
    )
    d, c = _keyed(docs, doc_id, text).alias("d"), candidates.alias("c")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_hash") == F.col("c.text_hash"))
    joined = d.join(c, same, "left").select("d.doc_id", "d.text_hash", words(F.col("d.text")).alias("w"), "found")
    none = F.expr("array()").cast("array<struct<start:int,n:int,phrase:string,window_id:binary,near:boolean>>")
    exact = lambda h: ~h["near"] & (F.array_join(F.slice("w", h["start"] + 1, h["n"]), " ") == h["phrase"])
    bare = lambda test: F.transform(
        F.filter(F.coalesce("found", none), test), lambda h: F.struct(h["start"].alias("start"), h["n"].alias("n"), h["window_id"].alias("window_id"))
    )
    near = [] if slop is None else [bare(lambda h: h["near"] & _stands_near(F.col("w"), h, slop)).alias("near")]
    hit = written(joined.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), bare(exact).alias("hits"), *near), "hits")
    # Items by document: hits meet their windows' lists after they are verified, once for each window of a document.
    met = hit.where(F.size("hits") > 0).select("doc_id", "text_hash", F.explode(F.array_distinct(F.transform("hits", lambda h: h["window_id"]))).alias("window_id")).distinct()
    own = (
        met.join(windows.select("window_id", F.explode("items").alias("item")), "window_id")
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .alias("i")
    )
    h = hit.alias("h")
    matched = F.col("h.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("h.text_hash") == F.col("i.text_hash"))
    return h.join(own, matched, "left").select(
        "h.doc_id",
        "h.text_hash",
        "n_words",
        _covered(F.col("hits")).alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        _places("hits").alias("spans"),
        *([] if slop is None else [F.size(F.array_distinct(F.transform("near", lambda x: x["window_id"]))).cast("long").alias("n_near"), _places("near").alias("near")]),
    ).select(
        "*",
        F.size("items").cast("long").alias("n_items"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows; all columns are kept."""
    bad = contamination(docs, items).where("contaminated").select("doc_id", "text_hash").distinct().alias("b")
    d = docs.alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64(F.col("d.text")) == F.col("b.text_hash"))
    return d.join(bad, same, "left_anti")
