"""The encoder against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from tilewright.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "th", "the ", " ", "\n", "\t", " ", "\x1c", "\x85", "é", "ß", "漢", "字", "😀", "1", "½", "Ⅳ", "'s", "'", "<|endoftext|>", "<|", "​", "́", "aaaa", "    ", "\r\n", "\x00", "²"]


@pytest.fixture(scope="module")
def both():
    return bpe.tokenizer(PATH), Library.from_file(PATH)


def test_random_texts(both):
    own, library = both
    r = random.Random(5)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(chr(r.choice([r.randint(0, 0x2FF), r.randint(0x300, 0xD7FF), r.randint(0xE000, 0x1FFFF), r.randint(97, 122)])) for _ in range(r.randint(1, 60))) for _ in range(400)]
    texts += ["ab" * 20_000 + "z" * 20_000, "\n" * 5_000]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want
        assert own.decode(np.array(want, np.int64)) == library.decode(want, skip_special_tokens=False)


def test_cut_characters(both):
    own, library = both
    ids = own.encode("漢字😀é")
    for i in range(len(ids)):
        assert own.decode(np.array(ids[i:], np.int64)) == library.decode(ids[i:], skip_special_tokens=False)


def test_query_rows(spark, both):
    _, library = both
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "été <|endoftext|>", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(bpe.encode(docs, PATH), PATH).collect()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.decode(bpe.encode(docs, PATH), PATH).where("text is null").count() == 0
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_one_stage_equals_two(spark):
    rows = [(1, "Hello wörld <|endoftext|> 永和", 0), (2, None, 0), (None, "", 0), (1, "Hello wörld <|endoftext|> 永和", 0), (4, " \n" * 500, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    shown = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert shown(bpe.round_trip(docs, PATH)) == shown(bpe.digests(bpe.encode(docs, PATH), PATH)) and bpe.round_trip(docs.limit(0), PATH).count() == 0
