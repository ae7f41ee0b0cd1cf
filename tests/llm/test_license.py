"""License scans: base phrases against brute force, templates by example."""

from __future__ import annotations

import random
import re

from tilewright.llm import license as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    places = sorted((i, label) for label, phrase in L.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base(spark):
    r = random.Random(6)
    vocab = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "All-Rights", "CC", "x", "é", "(the)"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 60))), "z") for i in range(300)]
    rows += [(900, None, "z"), (901, "", "z"), (None, "CC-BY", "z"), (5, rows[5][1], "z"), (5, "cc by", "z")]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()
    key = lambda x: repr(x)
    assert sorted(((g.doc_id, g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got), key=key) == sorted(((i, *brute(t)) for i, t, _ in rows), key=key)
    assert all(0 <= g.score <= 1 for g in got)


def test_templates(spark):
    texts = {
        1: "x y Licensed under the Apache License, Version 2.0. z",
        2: "Released under the MIT License.",
        3: "a Licensed under the, well, Apache License Version 2.0",
        4: "licensed work; the license is under version",
        5: "Permission is hereby granted, free of charge, to any one obtaining a copy of this software",
    }
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1].labels == "apache-2.0" and got[1].score == 1.0 and got[1].spans[0].first_word == 2 and got[1].spans[0].last_word == 9
    assert got[2].labels == "mit" and got[3].labels == "apache-2.0" and got[4].labels == "" and got[5].labels == "mit"
    assert got[3].score < 1 and got[4].score == 0.0


def test_empty(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def chain(places):
    """Length of the longest strictly ascending subsequence, by the plain recurrence."""
    best = []
    for i, q in enumerate(places):
        best.append(1 + max((best[j] for j in range(i) if places[j] < q), default=0))
    return max(best, default=0)


def brute_labels(text, templates, k=L.K):
    """(labels, score) by trying every band of every template."""
    w = WORD.findall((text or "").lower())
    labels, score = set(), 0.0
    for label, body in templates:
        t = body.split()
        n = len(t) - k + 1
        votes = [(p, q) for p in range(len(w) - k + 1) for q in range(n) if w[p : p + k] == t[q : q + k]]
        for d in {p - q for p, q in votes}:
            near = sorted((p, -q) for p, q in votes if abs(p - q - d) <= L.SLACK)
            share = chain([-q for _, q in near]) / n
            if share >= L.COVER:
                labels.add(label)
                score = max(score, share)
    base = brute(text)[4]
    return ",".join(sorted(labels | set(filter(None, base.split(","))))), 1.0 if base else score


def test_labels_equal_brute_force(spark):
    r = random.Random(16)
    templates = [("a", "cc by nc x y"), ("b", "x y x y z x y"), ("c", "all x all y all x"), ("d", "by"), ("e", "x x x x x x")]
    vocab = ["cc", "by", "nc", "x", "y", "z", "all", "X", "cc-by", "x y x"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 40)))) for i in range(400)]
    rows += [(i, text) for i, text in enumerate(["x y x y z x y", "cc by nc w x y", "all y all x", "x y z x y x y", "x " * 9], 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (2, 3):
        got = {g.doc_id: g for g in L.scan(docs, L.template_table(spark, templates), k=k).collect()}
        for i, text in rows:
            want = brute_labels(text, templates, k)
            if k == 2:
                assert (got[i].labels, got[i].score) == want, text
            else:  # of the base phrases those of three words alone
                assert {x for x in got[i].labels.split(",") if x in "abcde" and x} == {x for x in want[0].split(",") if x in "abcde" and x}, text


def test_repeated_words_give_no_license(spark):
    texts = {1: "cc by " * 5, 2: "licensed under " * 6, 3: "license the under licensed " * 9, 4: "cc by " * 5 + "licensed under cc by nc 4.0", 5: "the mit license under released " * 40}
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in sorted(got)] == ["cc-by", "", "", "cc-by,cc-by-nc", ""]
    assert got[4].n_base == 6 and got[4].score == 1.0 and {tuple(s)[:3] for s in got[4].spans if s.label == "cc-by-nc"} == {(10, 16, "cc-by-nc")}


def test_license_bodies(spark):
    body = next(t for label, t in L.TEMPLATES if label == "mit" and "merchantability" in t).split()
    changed = [*body[:30], "SUPPLIED", "and", *body[31:70], *body[72:]]
    docs = [(1, "Copyright (c) someone. " + " ".join(body).upper()), (2, " ".join(changed)), (3, " ".join(body[: len(body) // 2])), (4, " ".join(reversed(body)))]
    got = {r.doc_id: (r.labels, r.score) for r in L.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == ("mit", 1.0) and got[2][0] == "mit" and 0.75 <= got[2][1] < 1 and got[3] == got[4] == ("", 0.0)


def test_many_matches_in_one_text(spark):
    text = "cc by licensed under the mit license x " * 20_000
    got = L.scan(spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string")).collect()
    assert sorted(g.n_base for g in got) == [0, 20_000, 20_000] and {g.labels for g in got} == {"", "cc-by,mit"}


NOTICES = {
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}


def test_members_of_a_family(spark):
    """Each notice gives its own label alone, base labels aside; alone, amid other text, and with words changed elsewhere."""
    short = {"cc-by-nc": "Licensed under CC BY-NC 4.0.", "cc-by-sa": "licensed under CC-BY-SA-4.0", "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0"}
    rows = [(label, text) for label, text in [*NOTICES.items(), *short.items()]]
    rows += [(label, f"Some words before. {text.replace('licensed', 'made available', 1)} More of the work follows here.") for label, text in NOTICES.items()]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, label string, text string")
    for g in L.scan(docs).collect():
        label, text = rows[g.doc_id]
        assert {*g.labels.split(",")} - {*g.base_labels.split(",")} == {label} - {*g.base_labels.split(",")} and label in g.labels.split(","), (text, g.labels)
    both = L.scan(spark.createDataFrame([(1, NOTICES["gpl"] + "\n" + NOTICES["lgpl"])], "doc_id int, text string")).first()
    assert both.labels == "gpl,lgpl"


def test_needed_phrases_stand_in_their_templates():
    for label, phrases in L.NEEDED.items():
        for phrase in phrases:
            assert any(L.ranges(text, [phrase]) for own, text in L.TEMPLATES if own == label), phrase
    assert all(L.ranges(text, L.NEEDED[label]) for label, text in L.TEMPLATES if label in L.NEEDED)
    assert L.ranges("a b c b c", ["b c", "c b", "x"]) == [(1, 3), (2, 4)]


def test_votes_of_frequent_words(spark):
    """A long template votes by longer grams, so that a text and a template of few frequent words don't vote by the product of their counts."""
    from pyspark.sql import functions as F

    r = random.Random(4)
    few = "the of and to a in".split()
    body, text = (" ".join(r.choice(few) for _ in range(3000)) for _ in range(2))
    templates = L.template_table(spark, [("long", body)])
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string").select("doc_id", F.lit(0).cast("long").alias("text_hash"), F.split("text", " ").alias("words"))
    assert 10 * L.votes(docs, templates).count() < L.votes(docs, templates, long_words=5000).count()
    own = L.scan(spark.createDataFrame([(1, text), (2, body), (3, body.replace(" to a ", " to x a ", 2))], "doc_id int, text string"), templates)
    assert {g.doc_id: g.labels for g in own.collect()} == {1: "", 2: "long", 3: "long"}
