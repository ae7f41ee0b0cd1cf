"""Fingerprints, links and components against brute force."""

from __future__ import annotations

import random

import xxhash

from tilewright.llm import simhash as S


def slow_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint():
    for text in (None, "", " \t\n", "One", "one two", "ÀB c\x0bd é  F g", "a b c d " * 200, "x y z q r"):
        assert S.fingerprint(text) == slow_fingerprint(text)


def test_links_and_components(spark):
    r = random.Random(7)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        base = r.getrandbits(64)
        fps.add(base)
        for _ in range(r.randint(0, 8)):
            x = base
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    leaves = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = S.links(leaves, len(fps)).collect()
    pairs = {(min(a, b), max(a, b), d) for a, b, d in got}
    assert len(pairs) == len(got)
    want = set()
    for i, a in enumerate(fps):
        for j in range(i):
            d = (a ^ fps[j]).bit_count()
            if d <= 2:
                want.add((min(signed[i], signed[j]), max(signed[i], signed[j]), d))
    assert pairs == want and want
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in want:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    roots = {n: root for n, root in S.components(spark.createDataFrame([(a, b) for a, b, _ in want], "a long, b long")).collect()}
    assert roots == {x: find(x) for a, b, _ in want for x in (a, b)}


def test_long_chain(spark):
    chain = [(i, i + 1) for i in range(40)]
    assert {r.root for r in S.components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}


def test_documents(spark):
    body = " ".join(f"w{i}" for i in range(300))
    rows = [(5, body, 1), (3, body, 1), (3, body, 1), (9, body.replace("w250", "v"), 1), (7, None, 1), (8, "", 1), (None, body, 1), (20, "quite other words stand here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = S.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    for i, text, _ in rows:
        fp = slow_fingerprint(text)
        assert (i, fp - (1 << 64) if fp >> 63 else fp) in by
    comp = {i: c for (i, _), c in by.items()}
    assert comp[5] == comp[3] == comp[None] == 3 and comp[7] == comp[8] == 7 and comp[20] == 20
    near = (slow_fingerprint(body) ^ slow_fingerprint(rows[3][1])).bit_count() <= 2
    assert (comp[9] == 3) == near
    assert {r.doc_id for r in S.keep_one(docs).collect()} == {3, 7, 20} | (set() if near else {9})
    assert S.keep_one(docs).columns == docs.columns
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_one_document_stays_without_ids_or_with_one_id(spark):
    long = " ".join(f"word{i}" for i in range(400))
    near = long + " word399"
    assert (S.fingerprint(long) ^ S.fingerprint(near)).bit_count() <= 2 and long != near
    rows = [(None, long, "a"), (None, near, "b"), (None, long, "c"), (7, "q w e r t y", "d"), (7, "q w e r t y ", "e"), (8, "q w e r t y", "f"), (None, "q w e r t y", "g")]
    got = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(3)).collect()
    groups = [{(r.doc_id, r.text) for r in got if r.text.startswith(start)} for start in ("word", "q w")]
    assert [len(g) for g in groups] == [1, 1] and groups[1] < {(7, "q w e r t y"), (7, "q w e r t y ")}
