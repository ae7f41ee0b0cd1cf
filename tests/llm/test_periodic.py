"""Runs against a plain reading of their definition, and time in proportion to the text."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tilewright.llm import periodic as P
from tilewright.llm import queries


def slow_runs(w, least=12):
    """Every maximal stretch of each period; of one stretch only the least period counts."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def shapes():
    r = random.Random(5)
    for _ in range(300):
        yield "".join(r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 90)))
    for _ in range(100):
        unit = "".join(r.choice("abcd") for _ in range(r.randint(1, 30)))
        text = (unit * 9)[: r.randint(1, 200)]
        cut = r.randrange(len(text) + 1)
        yield text[:cut] + r.choice(["", "x", "ab"]) + text[cut:]
    for n in (2, 30, 150, 300):
        yield fibonacci(n)
        yield "a" * n + "b" + "a" * n + "c" + "a" * (n // 2)
        yield ("ab" * n) + ("ba" * n)
        yield "".join(map(str, (bin(i).count("1") & 1 for i in range(n))))


@pytest.mark.parametrize("least", [12, 2, 5])
def test_runs(least):
    for w in shapes():
        assert P.runs_of(list(w), least) == slow_runs(w, least), w


def test_online():
    """Words may come in any pieces, and the runs so far are those of the words so far."""
    r = random.Random(8)
    text = [r.choice((0, 0, 1)) for _ in range(200)]
    catcher, at = P.SquareCatcher(), 0
    while at < len(text):
        step = r.randint(1, 20)
        catcher.append_all(text[at : at + step])
        at += step
        assert catcher.runs(4) == slow_runs(text[:at], 4)


def test_false_hashes(monkeypatch):
    """With hashes that are always equal the words alone decide."""
    monkeypatch.setattr(P.SquareCatcher, "_hash", lambda self, a, b: 0)
    monkeypatch.setattr(P, "_DIRECT", 2)
    for w in [*shapes()][::7]:
        assert P.runs_of(list(w)) == slow_runs(w), w


def test_time_in_proportion():
    def seconds(m):
        text = [*[0] * m, 1, *[0] * m, 2, *[0] * m, 1, *[0] * (m // 2), *range(m), *range(m), *range(m)]
        began = time.process_time()
        assert P.runs_of(text)
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 9 * max(0.05, seconds(10_000))


def planted(words, doc_id):
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = planted((text or "").encode().split(), doc_id)
    runs = slow_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    facts = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *facts, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), digest(kept))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query(spark, tmp_path):
    r = random.Random(11)
    texts = [None, "", " \t\x0b\r\n", "one", "é a é a " * 8, "A a A a A a A a A a A a A a", "x " * 500, "a b c d " * 5 + "e f " * 9]
    texts += [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 120))) + r.choice(["", "\n", "\x1c"]) for _ in range(200)]
    rows = [(i, t, "runs", 1) for i, t in enumerate(texts)] + [(None, "a b " * 20, "x", 2), (3, "one", "again", 3), (None, None, None, None)]
    columns = "doc_id long, text string, collapsed string, n_words int"
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(x.doc_id), *(x[c] for c in COLUMNS)) for x in queries.op11_periodic(spark, str(tmp_path)).collect())
    assert got == sorted((str(i), *expected(i, t)) for i, t, *_ in rows)
    assert {x[1] for x in got} >= {0, 1, 2}
    assert queries.op11_periodic(spark, str(tmp_path)).schema["length"].dataType.simpleString() == "bigint"


def test_operator(spark):
    docs = spark.createDataFrame([("k1", "to be or not " * 5 + "end", 1), (None, None, 2)], "name string, body string, runs int")
    got = {x.doc_id: x for x in P.find(docs, "name", "body").collect()}
    assert got["k1"].collapsed == "to be or not end" and [tuple(x) for x in got["k1"].runs] == [(0, 20, 4)]
    assert got[None].runs == [] and got[None].collapsed == "" and got[None].n_words == 0
    assert P.find(docs.limit(0), "name", "body").count() == 0
    assert P.looped(docs, "name", "body").where(F.col("name").isNull()).first().body is None


def test_very_long_text(spark):
    unit = " ".join(f"w{i}" for i in range(100_000))
    row = P.find(spark.createDataFrame([(1, f"{unit} {unit} {unit}")], "doc_id int, text string")).first()
    assert row.collapsed == unit and [tuple(x) for x in row.runs] == [(0, 300_000, 100_000)]
