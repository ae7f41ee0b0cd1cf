"""License scans by diagonal voting.

Every word k-gram of a document is joined, by its hash, to the places of the
same k-gram in license templates; k is 2 for phrases and notices and 5 for long
texts, whose pairs of frequent words would vote too often. A match of document place p and template
place q votes for the diagonal p - q. Votes are summed by diagonal, and
neighbouring diagonals, at most ``slack`` apart, are merged into a band around
each of them: words inserted or lost move the rest of a license to a diagonal
nearby. A band counts if its votes hold a chain, strictly ascending in p and in
q, that covers ``cover`` of the template's k-grams. So a template place counts
once however often the document repeats it, and words in another order don't
count. Base phrases must stand on one diagonal in full.

A share can't tell licenses of a family that differ in a word, so templates name
phrases that have to be among the band's votes: the notice of one license says
"gnu general" where others say "gnu lesser general" or "gnu affero general".

A polynomial hash rolls in O(1) a word, but the JVM's vectorised row functions
make hashing a few words as cheap as rolling, so the k-gram's hash is
``xxhash64`` over the k words; the votes also compare the words themselves.

Defined results: a null or empty text has no words and no spans; a repeated
``doc_id`` keeps one row for each input row; ties between labels give all of
them, ties between bands of one template that overlap the first; a very long
text gives a row for each vote, never a group larger than a template's places
times ``2 * slack + 1``; a template of fewer than k words is never found; an
empty table gives an empty table; extra columns are ignored. Everything is
built from DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.words import literal_rows, words
from tilewright.storage import written

K = 2
#: k for templates of more words than these.
LONG_K, LONG_WORDS = 5, 60
#: Share of a template's k-grams that a chain must hold.
COVER = 0.75
#: Diagonals this near to a band's own belong to it (words inserted or lost).
SLACK = 3
#: Votes of templates are broadcast up to so many template words; a pack beyond it is refused.
MOST_TEMPLATE_WORDS = 500_000

#: Phrases and labels of the base scan; these must match in full.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
#: Short forms in which licenses are named or granted, and wording of license texts.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
     "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
     "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
     "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
     "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
     "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
     "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
     "in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
     "derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
     "provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
     "as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
     "as published by the free software foundation"),
    ("agpl-3.0", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]
#: Phrases by which licenses of a family differ. Those that stand in a template of the label must be found.
NEEDED = {
    "agpl-3.0": ["gnu affero general public license"],
    "cc-by": ["attribution 4"],
    "cc-by-nc": ["attribution noncommercial 4", "by nc 4"],
    "cc-by-nc-nd": ["attribution noncommercial noderivatives 4"],
    "cc-by-nc-sa": ["attribution noncommercial sharealike 4", "by nc sa 4"],
    "cc-by-nd": ["attribution noderivatives 4"],
    "cc-by-sa": ["attribution sharealike 4", "by sa 4"],
    "gpl": ["gnu general public license"],
    "gpl-3.0": ["gnu general public license", "version 3"],
    "lgpl": ["gnu lesser general public license"],
}


def ranges(text: str, phrases: list[str]) -> list[tuple[int, int]]:
    """Where those of the phrases that stand in a template stand, by the places of their words."""
    own, out = text.split(), []
    for phrase in (p.split() for p in phrases):
        out += [(i, i + len(phrase)) for i in range(len(own)) if own[i : i + len(phrase)] == phrase][:1]
    return out


def template_table(spark: SparkSession, templates=None, needed: dict[str, list[str]] = NEEDED) -> DataFrame:
    """(template, label, exact, words, must): the base phrases and the longer templates; ``must`` are ranges of words that have to be found."""
    rows = []
    for i, (label, text) in enumerate([*BASE, *(TEMPLATES if templates is None else templates)]):
        rows.append((i, label, i < len(BASE), text, " ".join(f"{a}:{b}" for a, b in ranges(text, needed.get(label, [])))))
    if sum(len(r[3].split()) for r in rows) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"the templates hold more than {MOST_TEMPLATE_WORDS} words")
    table = literal_rows(spark, ["template", "label", "exact", "text", "must"], rows)
    end = lambda r, i: F.get(F.split(r, ":"), F.lit(i)).cast("int")
    must = F.transform(F.array_remove(F.split("must", " "), ""), lambda r: F.struct(end(r, 0).alias("a"), end(r, 1).alias("b")))
    return table.select("template", "label", "exact", words(F.col("text")).alias("words"), must.alias("must"))


def _grams(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """(keys, position, gram, terms) for each run of ``k`` words; ``terms`` holds the words as w0, w1, ..."""
    long = F.size("words") - (k - 1)
    shifted = [F.slice("words", F.lit(i + 1), long).alias(f"w{i}") for i in range(k)]
    each = df.where(F.size("words") >= k).select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("position", "terms"))
    return each.select(*keys, "position", "terms", F.xxhash64(*(F.col(f"terms.w{i}") for i in range(k))).alias("gram"))


def _chain(places: Column) -> Column:
    """Length of the longest strictly ascending subsequence of an array: the least last member of each length is kept."""

    def add(tails: Column, q: Column) -> Column:
        below = F.size(F.filter(tails, lambda x: x < q))
        return F.concat(F.slice(tails, F.lit(1), below), F.array(q), F.slice(tails, below + 2, F.size(tails)))

    return F.size(F.aggregate(places, F.expr("cast(array() as array<int>)"), add))


def votes(docs: DataFrame, templates: DataFrame, k: int = K, long_k: int = LONG_K, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, text_hash, template, at, diagonal) of every k-gram that a document shares with a template."""
    out = []
    for width, some in ((k, F.size("words") <= long_words), (long_k, F.size("words") > long_words)):
        places = _grams(templates.where(some), width, "template").select("template", F.col("position").alias("at"), F.col("terms").alias("own"), "gram")
        if not places.isEmpty():
            met = _grams(docs, width, "doc_id", "text_hash").join(F.broadcast(places), "gram").where("terms = own")
            out.append(met.select("doc_id", "text_hash", "template", "at", (F.col("position") - F.col("at")).alias("diagonal")))
    return reduce(DataFrame.unionByName, out)


def spans(docs: DataFrame, templates: DataFrame, cover: float = COVER, slack: int = SLACK, k: int = K, long_k: int = LONG_K, long_words: int = LONG_WORDS) -> DataFrame:
    """Verified spans (doc_id, text_hash, label, exact, first_word, last_word, share) of ``docs``.

    ``docs`` has doc_id, text_hash and words. The templates' k-grams are a
    parameter of the scan, not data, of a checked number, and are broadcast.
    Votes are written once and read by all that follows.
    """
    width = F.when(F.size("words") <= long_words, k).otherwise(long_k)
    grams = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - width))
    needed = F.filter(grams, lambda i: F.exists("must", lambda r: (i >= r["a"]) & (i + F.col("k") <= r["b"])))
    facts = templates.withColumn("k", width).withColumn("needed", needed).select("template", "label", "exact", "k", (F.size("words") - (F.col("k") - 1)).alias("n_grams"), "needed")
    key = ["doc_id", "text_hash", "template"]
    votes_ = written(votes(docs, templates, k, long_k, long_words), "votes")
    # One row for each diagonal of a document and template; repeated rows vote once.
    diagonals = votes_.groupBy(*key, "diagonal").agg(F.sort_array(F.collect_set("at")).alias("ats")).join(F.broadcast(facts), "template")
    exact = diagonals.where("exact and size(ats) = n_grams").select(
        "doc_id", "text_hash", "label", "exact", F.col("diagonal").alias("first_word"), (F.col("diagonal") + F.col("n_grams") + (F.col("k") - 2)).alias("last_word"), F.lit(1.0).alias("share")
    )
    band = Window.partitionBy(*key).orderBy("diagonal").rangeBetween(-slack, slack)
    # A band's votes are at most n_grams * (2 * slack + 1); they are gathered only beside diagonals whose band has enough of them.
    seeds = (
        diagonals.where("not exact")
        .withColumn("enough", F.sum(F.size("ats")).over(band) >= cover * F.col("n_grams"))
        .withColumn("beside", F.max("enough").over(band))
        .where("beside")
        .withColumn("runs", F.collect_list(F.struct("diagonal", "ats")).over(band))
        .where("enough")
        .where(F.forall("needed", lambda q: F.exists("runs", lambda r: F.array_contains(r["ats"], q))))
    )
    near = F.flatten(F.transform("runs", lambda r: F.transform(r["ats"], lambda q: F.struct((r["diagonal"] + q).alias("p"), (-q).alias("q")))))
    chained = (
        seeds.withColumn("near", F.array_sort(near))
        .withColumn("chain", _chain(F.transform("near", lambda v: -v["q"])))
        .where(F.col("chain") >= cover * F.col("n_grams"))
        .withColumn("best", F.struct(F.col("chain"), (-F.col("diagonal")).alias("first")))
    )
    fuzzy = chained.withColumn("top", F.max("best").over(band)).where("best = top").select(
        "doc_id", "text_hash", "label", "exact",
        F.get("near", F.lit(0))["p"].alias("first_word"),
        (F.element_at("near", -1)["p"] + (F.col("k") - 1)).alias("last_word"),
        (F.col("chain") / F.col("n_grams")).alias("share"),
    )
    return exact.unionByName(fuzzy)


def scan(docs: DataFrame, templates: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", cover: float = COVER, slack: int = SLACK, k: int = K) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``score`` is the largest share of a template found, 0 without any. Base
    phrases of two words are found with ``k`` of two at most.
    """
    templates = template_table(docs.sparkSession) if templates is None else templates
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), words(F.col(text)).alias("words"))
    found = (
        spans(d, templates, cover, slack, k)
        .distinct()
        .groupBy("doc_id", "text_hash")
        .agg(
            F.count(F.when(F.col("exact"), 1)).alias("n_base"),
            F.min(F.when(F.col("exact"), F.col("first_word"))).alias("first_word"),
            F.max(F.when(F.col("exact"), F.col("first_word"))).alias("last_word"),
            F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))).alias("base"),
            F.array_sort(F.collect_set("label")).alias("all"),
            F.max("share").alias("score"),
            F.array_sort(F.collect_list(F.struct("first_word", "last_word", "label", "share"))).alias("spans"),
        )
        .alias("f")
    )
    counted = d.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash"))
    return counted.join(found, same, "left").select(
        "d.doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce(F.array_join("base", ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join("all", ","), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )
