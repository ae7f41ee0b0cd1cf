"""Every operator on one very long text beside a short one, with columns whose names clash."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tilewright.llm import bpe, chat, decontaminate, license, ogg, secrets, simhash, substring_dedup, toxicity, warc
from tilewright.storage import new_path

N = 200_000
LONG = " ".join(f"w{i % 977}x{i}" for i in range(N)) + "\nAll rights reserved. password=0123456789abcdef0123456789abcdef " + "z" * 300_000


@pytest.fixture(scope="module")
def docs(spark):
    columns = "doc_id long, text string, words array<string>, spans string, score double, fp long, hits int, n_words string, ids string, found string, media string, gram int, warc_type string"
    return spark.createDataFrame([(1, LONG, *[None] * 11), (2, "short", *[None] * 11)], columns).repartition(2)


def row(df):
    return df.where("doc_id = 1").first()


def test_operators(spark, docs):
    items = spark.createDataFrame([(1, " ".join(LONG.split()[1000:1040]), "x")], "item_id long, text string, items string")
    found = row(decontaminate.contamination(docs, items))
    assert (found.n_words, found.n_hit, found.contaminated) == (N + 6, 40, False)
    from test_bpe import PATH

    assert row(bpe.decode(bpe.encode(docs, PATH), PATH)).text == LONG
    assert row(simhash.near_duplicates(docs)).fp & ((1 << 64) - 1) == simhash.fingerprint(LONG)
    assert row(ogg.features(ogg.encode(docs))).n_bytes == len(LONG)
    s = row(secrets.scan(docs))
    at = LONG.index("password")
    assert (s.n_assign, s.n_hex) == (1, 1) and s.base[0].start == at and s.base[0].end == at + 41
    assert secrets.redact(docs).where("doc_id = 1").first().text.count("<secret>") == 1
    found = row(license.scan(docs))
    assert (found.n_words, found.n_base, found.first_word, found.labels) == (N + 6, 1, N, "reserved")
    assert row(toxicity.score(docs, [("password", True, 9.0)])).n_hits == 1
    assert row(substring_dedup.dedup(docs.unionByName(docs.withColumn("doc_id", F.lit(1))))).text == LONG
    again = docs.withColumn("doc_id", F.col("doc_id") + 5)
    cut = substring_dedup.dedup(docs.unionByName(again)).where("doc_id = 6").first()
    # Every later line of an equal digest goes, the short second line too.
    assert cut.text == "\n" and cut.n_words is None


def test_archive_and_chat(spark, docs):
    warc.register(spark)
    path = new_path(spark, "archive")
    warc.as_records(docs, "doc_id", "spans", "text").write.format("warc").mode("append").save(path)
    assert spark.read.format("warc").load(path).where("warc_record_id = '<urn:page:1>'").first().payload == bytearray(LONG.encode())
    turns = docs.withColumns({"turn": F.lit(1), "role": F.lit("assistant")})
    assert chat.read_back(chat.conversations(turns, "doc_id")).where("conv_id = 1").first().loss_text == LONG
