"""Substring dedup against a brute-force grouping, and its promise for pasted passages."""

from __future__ import annotations

import random

from tilewright.llm import substring_dedup as D


def prose(r, n):
    return " ".join("".join(r.choice("bcdfgaeiou") for _ in range(r.randint(3, 9))) for _ in range(n))


def documents(r):
    passage = prose(r, 55)
    line = prose(r, 12)
    docs = []
    for i in range(30):
        body = [prose(r, r.randint(1, 90)) for _ in range(r.randint(1, 6))]
        if i % 5 == 0:
            words = body[0].split()
            at = r.randint(0, len(words))
            body[0] = " ".join([*words[:at], passage.upper() if i else passage, *words[at:]])
        if i % 7 == 0:
            body.insert(r.randint(0, len(body)), line)
        docs.append((i, "\n".join(body)))
    return docs


def test_equals_brute_force(spark):
    docs = documents(random.Random(8)) + [(40, None), (41, ""), (None, "x " * 30)]
    got = D.repeats(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, start int")).collect()
    first, want = {}, set()
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        for a, b, _, digest in sorted(D.text_units(text or "")):
            if digest in first:
                want.add((i, a, b, first[digest]))
            else:
                first[digest] = (i, a)
    assert {(r.doc_id, r.start, r.end, (r.kept_doc_id, r.kept_start)) for r in got} == want and len(got) == len(want)
    hit = {r.doc_id for r in got}
    assert {5, 10, 15, 20, 25, 7, 14, 21, 28} <= hit and hit <= {0, 5, 10, 15, 20, 25, 7, 14, 21, 28, None}


def test_pasted_passages_share_units():
    r = random.Random(9)
    for _ in range(200):
        passage = prose(r, 51)
        a = prose(r, r.randint(0, 40)) + " " + passage + " " + prose(r, r.randint(0, 40))
        b = prose(r, r.randint(0, 40)) + " " + passage + " " + prose(r, r.randint(0, 40))
        assert {u[3] for u in D.text_units(a)} & {u[3] for u in D.text_units(b)}


def test_dedup_text(spark):
    line = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(2, f"Head.\n{line.upper()}!\ntail", "k"), (1, f"{line}\nrest", "k"), (3, None, "k")], "doc_id long, text string, removed_spans string")
    got = {r.doc_id: r for r in D.dedup(docs).collect()}
    assert got[1].text == f"{line}\nrest" and got[3].text is None and got[1].removed_spans is None
    assert got[2].text == "Head.\n\ntail" and [tuple(s) for s in got[2].removed_spans] == [(6, 7 + len(line))]
    assert D.dedup(docs.limit(0)).count() == 0


def test_short_lines_equal_brute_force(spark):
    """Whole lines of at most 26 words, grouped by a plain reading of the rule, without text_units."""
    r = random.Random(10)
    verse = [prose(r, r.randint(1, 7)) for _ in range(14)]
    docs = [(i, "\n".join([prose(r, r.randint(1, 12)), *(v.title() + "!" for v in verse), prose(r, 2)])) for i in range(4)]
    docs += [(10 + i, f"{prose(r, 9)}\r\n  {verse[3].upper()} ...\r\n\n{prose(r, 6)}") for i in range(6)]
    docs += [(20, "\n".join(["two words"] * 50)), (21, "--- \n***\nlone\n---"), (22, " \n\n\t\n***"), (23, "永和九年"), (24, "永和九年\n\n"), (25, "--"), (26, "Lone")]
    seen, want = {}, set()
    for i, text in docs:
        at = 0
        for line in text.split("\n"):
            key = tuple("".join(c.lower() if c.isalnum() else " " for c in line).split()) or line.strip()
            if key in seen:
                want.add((i, at, at + len(line), seen[key]))
            elif key:
                seen[key] = (i, at)
            at += len(line) + 1
    got = D.repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {(x.doc_id, x.start, x.end, (x.kept_doc_id, x.kept_start)) for x in got} == want and len(got) == len(want) > 100


def test_passage_in_short_lines_goes(spark):
    r = random.Random(11)
    passage = "\n".join(prose(r, 5) for _ in range(11))
    docs = spark.createDataFrame([(i, f"{prose(r, 20)}\n{passage}\n{prose(r, 3)}") for i in range(3)], "doc_id long, text string")
    left = {x.doc_id: len(x.text.split()) for x in D.dedup(docs).collect()}
    assert left == {0: 78, 1: 23, 2: 23}
