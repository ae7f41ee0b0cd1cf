"""Decontamination against a brute-force version."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tilewright.llm import decontaminate as D

DOCS = "doc_id long, text string, item_id string, start int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    out = []
    for doc_id, text, *_ in docs:
        w, hit, ids = words(text), set(), set()
        for item, body in items:
            v = words(body)
            for s in range(max(1, len(v) - 12) if v else 0):
                win = v[s : s + 13]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        ids.add(str(item))
        out.append((doc_id, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(12)] + ["É", "été", "straße", "X-ray", "the", "THE"]
    passage = " ".join(r.choice(vocab) for _ in range(20))
    items = [(1, passage), (2, "the"), (3, None), (4, "..."), (5, "the w1"), (6, passage), (None, "w1 w2 w3"), (10, " ".join(passage.split()[3:18]))]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 60))), "x", 1) for i in range(40)]
    docs += [(50, "a, " + passage.upper().replace("É", "é") + "; b", "x", 1), (51, None, "x", 1), (52, "", "x", 1), (None, "The w1.", "x", 1)]
    docs += [(50, passage + " " + passage, "x", 1), (3, docs[3][1], "x", 1)]
    got = D.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    rows = [(x.doc_id, x.n_words, x.n_hit, x["items"], x.contaminated) for x in got.collect()]
    want = brute(docs, [(i, t) for i, t in items if i is not None or t])
    want = [(a, b, c, [x for x in d if x != "None"], e) for a, b, c, d, e in want]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.contamination(docs, items.limit(0)).select("n_hit").collect() == [(0,)]
    assert D.contamination(docs.limit(0), items).count() == 0
    assert D.drop_contaminated(docs, items).count() == 0


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha x beta x gamma"), (2, "gamma beta alpha"), (3, "alpha " + "x " * 9 + "beta gamma")], "doc_id long, text string")
    windows = D.item_windows(items)
    anchors = D.rarest_terms(windows, D.term_counts(docs, windows.select(F.explode("terms").alias("term")).distinct(), 3), 3, rarest=3)
    index = D.build_index(docs, anchors.select("term").distinct(), 3)
    near = {r.doc_id for r in D.proximity_matches(index, anchors, 3, slop=2).collect()}
    assert near == {1}


def near(text, items, slop):
    """Different windows that stand near some start, by trying every start."""
    w, found = words(text), set()
    for _, body in items:
        v = words(body)
        for s in range(max(1, len(v) - 12) if v else 0):
            win = v[s : s + 13]
            for start in range(-slop, len(w)):
                if all(t in w[max(0, start + i) : max(0, start + i + slop + 1)] for i, t in enumerate(win)):
                    found.add(tuple(win))
                    break
    return len(found)


def test_near_equals_brute_force(spark):
    """All words of a window are verified, whatever stands between them; exact matches are near ones."""
    r = random.Random(13)
    vocab = [f"w{i}" for i in range(30)] + ["the", "the", "É"]
    passages = [[r.choice(vocab) for _ in range(n)] for n in (13, 20, 3, 1, 2, 16)]
    items = [(i, " ".join(p)) for i, p in enumerate(passages)] + [(9, None), (10, "")]
    docs = []
    for i in range(60):
        p = list(r.choice(passages))
        for _ in range(r.randint(0, 3)):
            p.insert(r.randrange(len(p) + 1), r.choice(vocab))
        if r.random() < 0.3 and len(p) > 1:
            p[r.randrange(len(p))] = "other"
        if r.random() < 0.3:
            k = r.randrange(len(p))
            p[k : k + 2] = reversed(p[k : k + 2])
        docs.append((i, " ".join([r.choice(vocab) for _ in range(r.randint(0, 5))] + p + [r.choice(vocab) for _ in range(r.randint(0, 5))]), "x", 1))
    docs += [(100, None, "x", 1), (101, "", "x", 1)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    for slop in (0, 1, 2):
        got = {x.doc_id: x for x in D.contamination(d, b, slop=slop).collect()}
        assert {i: got[i].n_near for i, *_ in docs} == {i: near(t, items, slop) for i, t, *_ in docs}, slop
        assert all({(s.start, s.n) for s in x.spans} <= {(s.start, s.n) for s in x.near} for x in got.values())
        plain = {x.doc_id: x.n_hit for x in D.contamination(d, b).collect()}
        assert plain == {i: x.n_hit for i, x in got.items()}
