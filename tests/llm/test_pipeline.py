"""The corpus pipeline against a brute-force version, and the queries with SQL against it."""

from __future__ import annotations

import hashlib
import os
import random

import corpus_pipeline
import duckdb
import pytest
from test_bpe import PATH
from test_decontaminate import brute as contaminated
from test_secrets import brute as secrets
from test_simhash import slow_fingerprint
from tokenizers import Tokenizer as Library

from tilewright.llm import queries, toxicity

SMALL = "/root/testdata/sf0.001"


def corpus():
    r = random.Random(12)
    word = lambda: "".join(r.choice("bcdfgaeiou") for _ in range(r.randint(3, 8)))
    passage = " ".join(word() for _ in range(30))
    docs, labels = [], []
    for i in range(160):
        words = [word() for _ in range(r.randint(1, 120))]
        kind = i % 8
        if kind == 0:
            words[r.randrange(len(words))] = r.choice(["scoundrel", "dunderhead"])
        if kind == 1:
            words.append("password=" + "".join(r.choice("0123456789abcdef") for _ in range(20)))
        if kind == 2:
            words[3:3] = passage.split()
        text = " ".join(words)
        if kind == 3 and i > 8:
            text = docs[i - 8][1]
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(kind == 0)))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "a row without an id", "en", "s", 19), (5, docs[5][1], "en", "s", docs[5][4])]
    return docs, labels, [(1, passage), (2, None)]


def brute(docs, lexicon, items):
    m = toxicity.Matcher(lexicon)
    docs = [d for d in docs if m.score(d[1])[0] < toxicity.THRESHOLD]
    fps = [slow_fingerprint(d[1]) for d in docs]
    comp = list(range(len(docs)))
    for _ in docs:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2:
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == [comp[c] for c in comp]:
            break
    ids = {}
    for d, c in zip(docs, comp):
        if d[0] is not None:
            ids[c] = min(ids.get(c, d[0]), d[0])
    docs = [d for d, c in zip(docs, comp) if d[0] == ids.get(c)]
    docs = [d for d in docs if not contaminated([d[:2]], items)[0][4]]
    library, out = Library.from_file(PATH), []
    for d in docs:
        text, at, done = d[1] or "", 0, ""
        for a, _, b, _ in secrets(d[1])[1]:
            if a >= at:
                done += text[at:a] + "<secret>"
            at = max(at, b)
        encoded = library.encode(done + text[at:], add_special_tokens=False).ids
        out.append((d[0], len(encoded), hashlib.sha256(",".join(map(str, encoded)).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_pipeline(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lexicon = toxicity.learn(table, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert {e for e, _, _ in lexicon} >= {toxicity.fold("scoundrel").strip()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in got), key=repr) == brute(docs, lexicon, items)
    assert 60 < len(got) < 140
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).columns == table.columns
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    rows = queries.QUERIES[name](spark, SMALL).toArrow().to_pylist()
    assert rows
    if name in queries.ORACLES:
        con = duckdb.connect()
        for f in os.listdir(SMALL):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
        found = con.execute(queries.ORACLES[name])
        columns = [c[0] for c in found.description]
        shown = lambda rs: sorted(repr(sorted(r.items())) for r in rs)
        assert shown(rows) == shown(dict(zip(columns, r)) for r in found.fetchall())
