"""Folding, matching and held-out accuracy."""

from __future__ import annotations

import collections
import math
import random
import zlib

import pytest

from tilewright.llm import toxicity as T


def test_fold():
    assert T.fold("1D10T!") == T.fold("idiot!") == T.fold("іdіоt ") == T.fold("ＩＤＩＯＴ")
    assert T.fold("Losér") == T.fold("l0ser")
    assert T.fold("a​b, c") == " ab c "
    assert T.fold(None) == T.fold("") == "  "


def test_entries_and_exceptions():
    m = T.Matcher([("idiot", True, 5.0), ("iowei", False, 6.0)], ["idiot proof"])
    weight = lambda t: m.evidence(T.fold(t))
    assert weight("an idiot") == (5.0, 1) and weight("idiotic") == (0.0, 0)
    assert weight("Loweichen") == (6.0, 1) and weight("alowei") == (0.0, 0)
    assert weight("idiot proof") == (0.0, 0) and weight("idiot proof idiot") == (5.0, 1)
    assert m.score(None) == (0.0, 0) and 0 < m.score("idiot " * 3)[0] < 1
    assert m.score("idiot")[0] > m.score("idiot " + "word " * 50_000)[0]
    assert T.Matcher([], []).score("idiot") == (0.0, 0)


def corpus(n, r):
    for i in range(n):
        words = [r.choice("abcdefgh") + r.choice("aeiou") + r.choice("rstmnp") + r.choice("aeiou") + r.choice(["n", "ro", "ky"]) for _ in range(r.randint(5, 80))]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(r.randint(1, 3)):
                words[r.randrange(len(words))] = r.choice(["scoundrel", "dunderhead", "blockh" + r.choice(["ead", "eads", "eaded", "eady"])])
        yield i, " ".join(words), int(toxic)


def test_held_out_accuracy(spark):
    rows = list(corpus(1500, random.Random(2)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    lexicon = T.learn(docs, labels)
    got = {r.doc_id: r.predicted for r in T.score(docs, lexicon).collect()}
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 200 and sum(got[i] == x for i, x in held) / len(held) > 0.98
    # Labels of held-out rows are not read.
    flipped = spark.createDataFrame([(i, 1 - x if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, _, x in rows], "doc_id long, toxic int")
    assert T.learn(docs, flipped) == lexicon


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "x", 1), (1, None, 1), (2, "", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert T.learn(docs, labels) == []
    assert [r.score for r in T.score(docs, []).collect()] == [0.0] * 4
    assert T.learn(docs, labels.limit(0)) == [] and T.score(docs.limit(0), []).count() == 0
    assert T.drop_toxic(docs, labels).count() == 4 and T.drop_toxic(docs, labels).columns == docs.columns


def test_short_insult_is_learned_whole(spark):
    r = random.Random(12)
    filler = lambda: " ".join("".join(r.choice("bcdfghmnpraeou") for _ in range(r.randint(2, 9))) for _ in range(20))
    docs = [(i, f"{filler()} {'You ZUT, ' if i % 2 else ''}{filler()}") for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    lexicon = T.learn(frame, frame.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    assert (T.fold("zut").strip(), True) in {(e, whole) for e, whole, _ in lexicon}
    assert {x.doc_id for x in T.score(frame, lexicon).where("n_hits > 0").collect()} >= set(range(1, 200, 2))
    assert T.Matcher(lexicon).evidence(T.fold("a zutano"))[1] == 0


def plain_learn(rows, labels):
    """The lexicon by the docstring's rules, in plain Python: ``rows`` are (id, text), ``labels`` (id, toxic)."""
    known = [(i, x) for i, x in labels if i is not None and x is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    n_toxic, n_clean = sum(x for _, x in known), sum(1 - x for _, x in known)
    texts = [(T.fold(t), x) for i, t in rows for j, x in known if i == j]
    sums = collections.defaultdict(lambda: [0, 0])
    for folded, x in texts:
        for word in set(folded.split()):
            for key in {(word, True), *((word[:n], False) for n in T.STEMS if n < len(word))}:
                sums[key][1 - x] += 1
    tried = {}
    for key, (t, c) in sums.items():
        rate = (t + 0.5) / (n_toxic + 1) / ((c + 0.5) / (n_clean + 1))
        if t >= T.SUPPORT and rate >= T.RATIO:
            tried[key] = (math.log(rate), t * math.log(rate))
    # Equally strong: the whole word, the longest, the lesser in the lexicon's order.
    strength = lambda k: (tried[k][1], k[1], len(k[0]))
    seen = collections.defaultdict(list)
    for folded, x in texts:
        if x:
            words = folded.split()
            own = {k: i for k in tried for i in reversed(range(len(words))) if (words[i] == k[0] if k[1] else words[i].startswith(k[0]))}
            for key, i in own.items():
                seen[key].append((words[i - 1] if i else "", strength(key) == max(map(strength, own))))
    out = set()
    for key, found in seen.items():
        contexts = len({before for before, _ in found})
        wide = contexts >= T.CONTEXTS and contexts >= T.CONTEXT_SHARE * len(found) and tried[key][0] >= math.log(T.CONTEXT_RATIO)
        if sum(best for _, best in found) >= T.SUPPORT or wide:
            out.add((*key, round(tried[key][0], 9)))
    return out


def test_learner_equals_plain_rules(spark):
    r = random.Random(21)
    rows = [(i, t) for i, t, _ in corpus(500, r)]
    labels = [(i, int("scoundrel" in t or "dunderhead" in t or "blockh" in t)) for i, t in rows]
    rows += [rows[3], rows[4], (None, "scoundrel"), (900, None), (901, "")]  # repeated rows, no id, no text
    labels += [labels[5], (None, 1), (900, 1), (901, 0), (7, None), (8, 1), (8, 0), (5000, 1)]  # repeated, several, unknown
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = T.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {(e, whole, round(w, 9)) for e, whole, w in got} == plain_learn(rows, labels) and len(got) >= 3


def test_every_length_counts():
    m = T.Matcher([("idiot", True, 5.0)], ["idiot proof"])
    scores = [m.score("idiot" + " word" * n)[0] for n in (0, 1, 10, 100, 900, 5000, 100_000)]
    assert scores == sorted(scores, reverse=True) and len(set(scores)) == len(scores)
    want = lambda weight, n: weight / (1 + n) ** T.POWER / (weight / (1 + n) ** T.POWER + T.HALF)
    for text, weight, n in (("idiot", 5, 1), ("an IDIOT, an 1d10t", 10, 4), ("idiot proof idiot", 5, 3)):
        assert abs(m.score(text)[0] - want(weight, n)) < 1e-12


def test_limit_warns(spark):
    r = random.Random(3)
    rows = list(corpus(400, r))
    frame = lambda c, k: spark.createDataFrame([(x[0], x[k]) for x in rows], f"doc_id long, {c}")
    with pytest.warns(UserWarning, match="2 strongest"):
        assert len(T.learn(frame("text string", 1), frame("toxic int", 2), limit=2)) <= 2
