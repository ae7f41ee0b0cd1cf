"""Ids of any type: each operator carries them as they are, and finds what it finds with whole numbers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from test_bpe import PATH
from tilewright.llm import bpe, decontaminate, divergence, license, ogg, periodic, secrets, simhash, substring_dedup, toxicity

TEXTS = ["one line of words that stands twice\nand more", "password=0123456789abcdef", "one line of words that stands twice", None, "", "you fool"]
NAMES = ["a", "b-2", "c", None, "é", "4"]


@pytest.fixture(scope="module")
def both(spark):
    schema = "doc_id {}, text string, lang string, source string"
    rows = lambda ids: [(i, t, "en", "s") for i, t in zip(ids, TEXTS)]
    return spark.createDataFrame(rows(NAMES), schema.format("string")), spark.createDataFrame(rows([1, 2, 3, None, 5, 6]), schema.format("long"))


OPERATORS = {
    "bpe": lambda d: bpe.round_trip(d, PATH),
    "bpe steps": lambda d: bpe.digests(bpe.encode(d, PATH), PATH),
    "bpe text": lambda d: bpe.decode(bpe.encode(d, PATH), PATH).select("doc_id", "text"),
    "simhash": lambda d: simhash.near_duplicates(d).select("doc_id", "fingerprint", "n_links"),
    "ogg": lambda d: ogg.features(ogg.encode(d)),
    "toxicity": lambda d: toxicity.score(d, [("fool", True, 9.0)]),
    "substring": lambda d: substring_dedup.repeats(d).select("doc_id", "start", "end", "n_words", "copies"),
    "secrets": lambda d: secrets.scan(d).select("doc_id", "n_assign", "n_hex"),
    "license": lambda d: license.scan(d).drop("spans"),
    "periodic": lambda d: periodic.find(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_text_and_whole_numbers_give_the_same(both, name):
    number = dict(zip(NAMES, [1, 2, 3, None, 5, 6]))
    named, plain = (OPERATORS[name](d) for d in both)
    assert named.schema["doc_id"].dataType.simpleString() == "string" and plain.schema["doc_id"].dataType.simpleString() == "bigint"
    key = lambda r: repr(r)
    assert sorted(((number[r[0]], *r[1:]) for r in named.collect()), key=key) == sorted((tuple(r) for r in plain.collect()), key=key)


def test_stages(spark, both):
    named, _ = both
    assert {r.doc_id for r in simhash.keep_one(named.where("text is not null and text <> ''")).collect()} == {"a", "b-2", "c", "4"}
    labels = spark.createDataFrame([(i, 1, t) for i, t in ((4, 1), (7, 0))], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(named, labels).count() == 6
    items = spark.createDataFrame([(1, "of words that stands")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.drop_contaminated(named, items).collect()} == {"b-2", None, "é", "4"}
    assert {r.doc_id for r in secrets.redact(named).where(F.col("text").contains("<secret>")).collect()} == {"b-2"}
    assert substring_dedup.dedup(named).where("doc_id = 'c'").first().text == ""
    assert divergence.report(named).count() == 0


def test_dates_and_decimals(spark):
    for kind in ("date", "decimal(20,2)", "timestamp", "int"):
        d = spark.createDataFrame([("x y z",), ("x y z",)], "text string").withColumn("doc_id", F.lit("2020" if kind != "date" and kind != "timestamp" else "2020-01-02").cast(kind))
        assert bpe.round_trip(d, PATH).schema["doc_id"].dataType.simpleString() == kind
        assert bpe.round_trip(d, PATH).first().doc_id == d.first().doc_id == simhash.near_duplicates(d).first().component_id
        assert ogg.features(ogg.encode(d)).first().doc_id == d.first().doc_id
