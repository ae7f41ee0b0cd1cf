"""Statistics, ranks and split digests against a plain count."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tilewright.llm import divergence as D

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, top=50, least=30):
    """The report by reading its definition: (lang, source, part, item, value, rank)."""
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, w in mine for t in set(w))
        kept = [t for t in df if df[t] >= least]
        count = {s: Counter() for _, s, _ in mine}
        for _, s, w in mine:
            count[s].update(t for t in w if df[t] >= least)
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        whole = share(sum(count.values(), Counter()))
        p = {s: share(c) for s, c in count.items()}
        for s in p:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in p if o != s)
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)]
            over = sorted((whole[t] - p[s][t], t.encode(), t) for t in kept if count[s][t] and p[s][t] > whole[t])
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(over[:top], 1)]
    return sorted(out)


def table(n=260, seed=3):
    r = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "delta", "Éclair", "éclair", "日本", "x", "y2z", "don't", "İ", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    rows = []
    for i in range(n):
        source = r.choice(["a", "a", "a", "b", "c", None, "z"])
        some = words[: 20 + 10 * (source == "b")] if i % 2 else words
        rows.append((" ".join(r.choices(some, k=r.randint(0, 60))), r.choice(["en", "de"]), source))
    rows += [(None, "en", "silent"), ("", None, None), ("a b\tc", None, "other"), ("x" * 200_000 + " alpha" * 50_000, "en", "long"), ("alpha", "fr", "only")]
    return rows + rows[:5]


def got(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "text string, lang string, source string, n int, term string, digest string")
    return sorted(tuple(x) for x in D.report(df.repartition(4), **kw).select("lang", "source", "part", "item", "value", "rank").collect())


def test_report(spark):
    assert got(spark, table()) == plain(table())


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_collisions_are_split(spark, bits, monkeypatch):
    monkeypatch.setattr(D, "HELD", 40)
    assert got(spark, table(), bits=bits, min_docs=20) == plain(table(), least=20)


def test_without_broadcasts_and_matrices(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(D, "_MATRIX", 0)
    assert got(spark, table(seed=9), bits=4, top=7) == plain(table(seed=9), 7)


def test_many_ties(spark):
    rows = [(" ".join(f"t{chr(97 + i)}{chr(97 + j)}" for j in range(26)), "en", "ab"[i % 2]) for i in range(20)] * 40
    assert got(spark, rows) == plain(rows)


def test_nothing_kept(spark):
    rows = [("one two", "en", "a"), ("three", "en", "b"), (None, None, None)]
    assert got(spark, rows) == plain(rows) and len(plain(rows)) == 2
    assert got(spark, []) == []


def test_large_counts(spark):
    """Counts beyond what a long could hold when scaled."""
    from pyspark.sql import functions as F

    row = spark.sql("SELECT 9000000000000 AS n, 70000000000001 AS size, 123456789 AS kept").select(D._share(F.col("n"), F.col("size"), F.col("kept")).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (9000000000000 + 5) // (70000000000001 + 5 * 123456789)


def test_terms():
    text = "Don't STOP_now, École x2y İ\x00日本\x7fend"
    assert [t.decode() for t in D.terms_of(text.encode())] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
