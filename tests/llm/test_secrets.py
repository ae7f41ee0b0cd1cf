"""Secret scans against a brute-force version."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from tilewright.llm import secrets as S

PATTERNS = [
    ("assign", re.compile(S.ASSIGN.replace(r"\x20", " "), re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]
WEAK = [("endpoint", re.compile(S.ENDPOINT)), ("bare", re.compile(S.BARE)), ("user", re.compile(S.USER, re.A))]


def brute(text, scope=S.SCOPE):
    text = text or ""
    base = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(PATTERNS) for m in p.finditer(text) if ok(m)]
    weak = [(m.start(), 3 + i, m.end(), k) for i, (k, p) in enumerate(WEAK) for m in p.finditer(text)]
    everything = base + weak
    linked = [w for w in weak if any(p[3] in S.COMPLEMENTS[w[3]] and abs(p[0] - w[0]) <= scope for p in everything)]
    return sorted(base), sorted(base + linked)


def text_of(r):
    parts = ["password=", "token: ", "Secret = \"", "api_key:", "APIKEY='", "abcdefg", "abcdefgh", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef" * 2, "f" * 31, " ", "\n", "é", "😀", "https://host.example/a?b=c", "user: bob", "Q" * 40, "x" * 150, " " * 300, "token=token=", "\"", "."]
    return "".join(r.choice(parts) for _ in range(r.randint(0, 25)))


def test_equals_brute_force(spark):
    r = random.Random(11)
    rows = [(i, text_of(r), "x") for i in range(400)] + [(900, None, "x"), (901, "", "x"), (None, "password=12345678", "x"), (7, "secret: hunter2hunter2", "x"), (7, "secret: hunter2hunter2", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    got = S.scan(docs).select("doc_id", S.listed(F.col("base")), S.listed(F.col("spans")), "n_assign", "n_access", "n_hex").collect()
    want = []
    for i, t, _ in rows:
        base, spans = brute(t)
        show = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        want.append((i, show(base), show(spans), *(sum(k == s[3] for s in base) for k in ("assign", "access", "hex"))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(w[1] != w[2] for w in want)


def test_weak_parts_need_company(spark):
    docs = spark.createDataFrame([(1, "see https://host.example/x"), (2, "https://host.example/x password=abcdefgh"), (3, "https://host.example/x" + " " * 900 + "password=abcdefgh")], "doc_id long, text string")
    got = {r.doc_id: r.s for r in S.scan(docs).select("doc_id", S.listed(F.col("spans")).alias("s")).collect()}
    assert got[1] == "" and got[2].startswith("endpoint:0:22,assign:") and got[3].startswith("assign:")


def test_redact(spark):
    docs = spark.createDataFrame([(1, "a password=abcdefgh1 b", 22), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in S.redact(docs).collect()}
    assert got == {1: ("a <secret> b", 12), 2: (None, None), 3: ("clean", 5)}
    assert S.redact(docs).columns == docs.columns
    assert S.redact(docs.limit(0)).count() == 0


def test_pairs_name_the_part_that_completes(spark):
    r = random.Random(13)
    rows = [(i, text_of(r) + text_of(r)) for i in range(300)]
    docs = spark.createDataFrame([*rows, (301, None)], "doc_id long, text string")
    some = 0
    for g in S.scan(docs).collect():
        spans = {tuple(s) for s in g.spans}
        base = {tuple(s) for s in g.base}
        assert {(p.start, p.rank, p.end, p.kind) for p in g.pairs} == spans - base
        for p in g.pairs:
            part = p["with"]
            assert part.kind in S.COMPLEMENTS[p.kind] and abs(part.start - p.start) <= S.SCOPE
            text = dict(rows)[g.doc_id]
            pattern = dict((k, x) for k, x, *_ in [*PATTERNS, *WEAK])[part.kind]
            assert any(m.span() == (part.start, part.end) for m in pattern.finditer(text))
            some += 1
    assert some > 100
    shown = S.scan(spark.createDataFrame([(1, "https://host.example/x password=abcdefgh")], "doc_id long, text string")).select(S.paired(F.col("pairs"))).first()[0]
    assert shown == "endpoint:0:22=assign:23:40"


def plain_mask(text, spans):
    at, out = 0, ""
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "<secret>"
        at = max(at, b)
    return out + text[at:]


def test_mask_equals_slices(spark):
    r = random.Random(14)
    rows = []
    for i in range(120):
        text = "".join(r.choice("ab é😀\n") for _ in range(r.choice([5, 300, 4096, 8192, 9000])))
        n = len(text)
        cuts = sorted((a := r.randint(0, n), r.randint(a, n) if r.random() < 0.2 else min(n, a + r.randint(0, 40))) for _ in range(r.choice([1, 3, 300, 700])))
        rows.append((i, text, [(a, b) for a, b in cuts]))
    frame = spark.createDataFrame(rows, "i long, text string, spans array<struct<start:int,end:int>>")
    got = {x.i: x.t for x in frame.select("i", S.masked(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {i: plain_mask(text, spans) for i, text, spans in rows}


def many(n):
    return " ".join(f"é password=abcdefgh{i} " + ("https://host.example/x" if i % 5 == 0 else "") for i in range(n))


def test_many_matches_in_one_text(spark):
    """Time grows with the matches, not with their square."""
    took = {}
    for n in (100, 10_000, 40_000):
        docs = spark.createDataFrame([(1, many(n), 0)], "doc_id long, text string, n_chars long")
        began = time.perf_counter()
        found = S.scan(docs).select("n_assign", F.size("pairs").alias("pairs")).first()
        clean = S.redact(docs).select("n_chars", (F.length("text") - F.length(F.replace("text", F.lit("<secret>"), F.lit("")))).alias("masked")).first()
        took[n] = time.perf_counter() - began
        assert found.n_assign == n and found.pairs == n // 5 and clean.masked == 8 * (n + n // 5)
    assert took[40_000] < 5 * took[10_000]
