"""Archives written and read back."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tilewright.llm import warc as W
from tilewright.storage import new_path

LONG = "<html>" + "ä" * 100 + "</html>"
PAGES = [(3, "http://a/3", LONG, "x"), (1, "http://a/1", LONG, "x"), (2, "http://a/2", "short", "x"), (4, None, "short", "x"), (5, "u\nv", None, "x"), (None, "http://a/n", LONG, "x"), (1, "http://a/1", LONG, "x"), (6, "http://a/6", "\r\n\r\n" + "z" * 5000, "x")]


@pytest.fixture(scope="module")
def archive(spark):
    W.register(spark)
    path = new_path(spark, "archive")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, payload string")
    W.as_records(pages).repartition(3).write.format("warc").mode("append").save(path)
    return path


def test_round_trip(spark, archive):
    got = spark.read.format("warc").load(archive).withColumn("page", W.page_of(F.col("warc_record_id"))).collect()
    assert len(got) == len(PAGES)
    for r in got:
        html = next(h for i, _, h, _ in PAGES if i == r.page) or ""
        raw = html.encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha256(raw).hexdigest()
        revisit = html == LONG and r.page != 1
        assert r.warc_type == ("revisit" if revisit else "response")
        assert bytes(r.payload) == (b"" if revisit else raw)
        assert r.refers_to == ("<urn:page:1>" if revisit else None)


def test_pushed_predicates(spark, archive):
    table = spark.read.format("warc").load(archive)
    assert {r.warc_type for r in table.where("warc_type = 'revisit'").collect()} == {"revisit"}
    assert table.where("warc_type = 'response'").count() == 6
    assert table.where("warc_record_id in ('<urn:page:2>', '<urn:page:6>') and payload_bytes > 10").count() == 1
    assert table.where("target_uri = 'http://a/2'").select(F.col("payload").cast("string")).first()[0] == "short"
    bare = spark.read.format("warc").option("payload", "false").load(archive)
    assert bare.where("payload is not null").count() == 0 and bare.count() == len(PAGES)


def test_predicates_skip_payloads():
    payloads = [random.Random(i).randbytes(8000) for i in range(3)]
    parts = [W.record_bytes({"WARC-Type": t, "WARC-Record-ID": str(i)}, p) for i, (t, p) in enumerate(zip(("response", "warcinfo", "response"), payloads))]
    data = b"".join(parts)
    assert gzip.decompress(data).count(b"WARC/1.1") == 3
    broken = bytearray(data)
    middle = len(parts[0]) + len(parts[1])
    broken[middle - 12 : middle - 4] = b"\xff" * 8  # the end of the payload that is not wanted
    found = list(W.records(memoryview(bytes(broken)), True, [("warc_type", frozenset(["response"]))], True))
    assert [p for _, p in found] == [payloads[0], payloads[2]]


def test_foreign_members_and_plain_files():
    raw = lambda t, p: b"WARC/1.0\r\nWARC-Type: " + t + b"\r\nContent-Length: %d\r\n\r\n" % len(p) + p + b"\r\n\r\n"
    records = [raw(b"response", b"one" * 3000), raw(b"metadata", b""), raw(b"response", b"three")]
    packed = b"".join(gzip.compress(r) for r in records)
    test = [("warc_type", frozenset(["response"]))]
    for data, is_packed in ((packed, True), (b"".join(records), False)):
        assert [p for _, p in W.records(memoryview(data), is_packed, test, True)] == [b"one" * 3000, b"three"]


def test_empty(spark):
    W.register(spark)
    path = new_path(spark, "archive")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    W.as_records(pages).write.format("warc").mode("append").save(path)
    assert spark.read.format("warc").load(path).count() == 0


def test_appends_add_and_overwrite_replaces(spark, tmp_path):
    W.register(spark)
    path = f"file://{tmp_path}/archive"
    write = lambda ids, mode: W.as_records(spark.createDataFrame([(i, f"http://a/{i}", LONG + str(i)) for i in ids], "page_id long, url string, html string")).write.format("warc").mode(mode).save(path)
    kept = lambda: sorted(r.page for r in spark.read.format("warc").load(path).select(W.page_of(F.col("warc_record_id")).alias("page")).collect())
    write([1], "append")
    write([2, 3], "append")
    assert kept() == [1, 2, 3]
    write([4], "overwrite")
    assert kept() == [4] and len([x for x in (tmp_path / "archive").iterdir() if x.suffix == ".gz"]) == 1
    write([], "append")
    assert kept() == [4]


def test_failed_write_leaves_nothing(spark, tmp_path):
    W.register(spark)
    path = f"file://{tmp_path}/archive"
    good = spark.createDataFrame([(i, f"http://a/{i}", LONG) for i in range(8)], "page_id long, url string, html string").repartition(2)
    bad = good.withColumn("html", F.when(F.col("page_id") == 5, F.raise_error(F.lit("no page"))).otherwise(F.col("html")))
    with pytest.raises(Exception, match="no page"):
        bad.select(F.lit("response").alias("warc_type"), F.col("html").alias("payload")).write.format("warc").mode("append").save(path)
    assert [x for x in (tmp_path / "archive").glob("*") if x.suffix in (".gz", ".json")] == []


def test_long_headers():
    url = "http://a/" + "x" * 100_000
    data = W.record_bytes({"WARC-Type": "response", "WARC-Target-URI": url}, b"one") + W.record_bytes({"WARC-Type": "response"}, b"two")
    plain = gzip.decompress(data)
    named = gzip.compress(b"WARC/1.0\r\nContent-Length: 3\r\n\r\nodd\r\n\r\n")
    named = named[:3] + b"\x08" + named[4:10] + b"n" * 70_000 + b"\0" + named[10:]  # a member with a long file name
    for raw, packed in ((data, True), (plain, False)):
        got = list(W.records(memoryview(raw), packed, [], True))
        assert [p for _, p in got] == [b"one", b"two"] and got[0][0]["WARC-Target-URI"] == url
    assert [p for _, p in W.records(memoryview(named + data), True, [], True)] == [b"odd", b"one", b"two"]
    for raw, packed in ((data[:-9], True), (plain[:-8], False), (data[:60], True), (plain[:700], False)):
        with pytest.raises((ValueError, zlib.error)):
            list(W.records(memoryview(raw), packed, [], True))


def test_unwanted_payloads_are_not_read():
    r = random.Random(3)
    data = b"".join(W.record_bytes({"WARC-Type": t}, r.randbytes(300_000)) for t in ("resource", "response", "resource", "resource"))
    for raw, packed in ((data, True), (gzip.decompress(data), False)):
        asked = []
        window = W.Window(lambda n, at: asked.append(n) or raw[at : at + n], len(raw), ahead=4096)
        found = list(W.records(window, packed, [("warc_type", frozenset(["response"]))], True))
        assert len(found) == 1 and len(found[0][1]) == 300_000
        assert sum(asked) < 400_000 and len(raw) > 1_200_000


def test_large_archives_are_split(spark, tmp_path):
    W.register(spark)
    path = f"file://{tmp_path}/archive"
    r = random.Random(5)
    rows = [(i, f"http://a/{i}", r.randbytes(3000).hex()) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    W.as_records(pages).coalesce(1).write.format("warc").option("splitBytes", "20000").mode("append").save(path)
    table = spark.read.format("warc").load(path)
    assert len(list((tmp_path / "archive").glob("*.gz"))) == 1 and table.rdd.getNumPartitions() > 5
    assert {(x.p, x.h) for x in table.select(W.page_of(F.col("warc_record_id")).alias("p"), F.col("payload").cast("string").alias("h")).collect()} == {(i, h) for i, _, h in rows}
    assert table.count() == 60


def test_query_decodes_responses_alone(spark, tmp_path, monkeypatch):
    from tilewright.llm import queries

    spark.createDataFrame([(1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, "http://a/3", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.op3_warc(spark, str(tmp_path))
    plan = out._jdf.queryExecution().toString()
    assert plan.count("BatchScan warc") >= 2 and "isnotnull" in plan.lower()
    assert sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in out.collect()) == [(1, "response", None, 213), (2, "revisit", 1, 213), (3, "response", None, 0)]
