"""The queue source and batches that go on over micro-batches."""

from __future__ import annotations

import os

import pandas as pd
import pytest

from tilewright.streaming import batching, queue


def rows(feed, *numbers):
    return [{"feed": feed, "sample": n, "name": f"{feed}{n}", "content": b"%d" % n, "label": n % 3} for n in numbers]


def run(spark, source, sink, checkpoint, batch=4, last="partial"):
    q = batching.carried(source, batch, last).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    q.awaitTermination()
    return spark.read.schema(q_schema).parquet(sink) if os.path.isdir(sink) else None


q_schema = queue.SCHEMA.replace(", last boolean", "") + ", batch_id long, slot int, is_pad boolean"


def got(df):
    return sorted((r.feed, r.batch_id, r.slot, r.sample, r.is_pad) for r in df.collect())


def want(feed, n, batch):
    return [(feed, i // batch, i % batch, i, False) for i in range(n)]


def test_batches_go_on_over_micro_batches_and_restarts(spark, tmp_path):
    path, sink, checkpoint = (str(tmp_path / x) for x in ("q", "out", "c"))
    feeder = queue.Queue(path)
    feeder.put(rows("a", 2, 0, 1))
    assert got(run(spark, queue.stream(spark, path), sink, checkpoint)) == []
    feeder.put(rows("b", 0))
    feeder.put(rows("a", 4, 3, 5))
    back = run(spark, queue.stream(spark, path), sink, checkpoint)
    assert got(back) == want("a", 4, 4)
    # Each run is a restart from the checkpoint, with a new reader: what waited is carried over.
    feeder = queue.Queue(path)
    feeder.put(rows("b", 1, 2, 3, 4) + rows("a", 6))
    back = run(spark, queue.stream(spark, path), sink, checkpoint)
    assert got(back) == want("a", 4, 4) + want("b", 4, 4)
    feeder.put(rows("a", *range(7, 13)))
    feeder.end("a")
    feeder.end("b")
    back = run(spark, queue.stream(spark, path), sink, checkpoint)
    assert got(back) == want("a", 13, 4) + want("b", 5, 4)
    assert got(run(spark, queue.stream(spark, path), sink, checkpoint)) == got(back)


def test_a_batch_that_was_not_committed_is_read_again(spark, tmp_path):
    feeder = queue.Queue(str(tmp_path / "q"))
    for i in range(3):
        feeder.put(rows("a", i, i + 10))
    reader = queue.QueueReader({"path": str(tmp_path / "q")})
    start, end = reader.initialOffset(), reader.latestOffset()
    assert (start, end) == ({"segment": 0}, {"segment": 3})
    read = lambda r: [x for p in r.partitions(start, end) for b in r.read(p) for x in b.column("sample").to_pylist()]
    first = read(reader)
    again = queue.QueueReader({"path": str(tmp_path / "q")})
    assert first == read(again) == [0, 10, 1, 11, 2, 12]
    feeder.put(rows("a", 99))
    assert read(again) == first and again.latestOffset() == {"segment": 4}
    again.commit(end)
    assert queue._segments(str(tmp_path / "q")) == [2, 3] and queue.Queue(str(tmp_path / "q")).next == 4
    keeping = queue.QueueReader({"path": str(tmp_path / "q"), "keep": "true"})
    keeping.commit({"segment": 4})
    assert queue._segments(str(tmp_path / "q")) == [2, 3]
    again.commit({"segment": 4})
    assert queue._segments(str(tmp_path / "q")) == [3] and again.latestOffset() == {"segment": 4}
    assert again.partitions({"segment": 4}, {"segment": 4}) == []


def test_lost_segments_are_told(tmp_path):
    feeder = queue.Queue(str(tmp_path))
    for i in range(3):
        feeder.put(rows("a", i))
    os.remove(tmp_path / f"{1:012d}.segment")
    reader = queue.QueueReader({"path": str(tmp_path)})
    with pytest.raises(ValueError, match="gone"):
        reader.partitions({"segment": 0}, {"segment": 3})


@pytest.mark.parametrize("last", ["partial", "fill", "drop"])
def test_cut(last):
    """Pieces of any sizes give the batches of the whole."""
    for n in (0, 1, 4, 5, 11):
        for pieces in ([n], [1] * n, [n // 2, n - n // 2], [0, n]):
            held, number, out, at = pd.DataFrame({"x": pd.Series([], dtype="int64")}), 0, [], 0
            for i, size in enumerate(pieces):
                held = pd.concat([held, pd.DataFrame({"x": range(at, at + size)})], ignore_index=True)
                at += size
                done, held, number = batching.cut(held, number, 4, i == len(pieces) - 1, last)
                out += [tuple(r) for r in done[["batch_id", "slot", "x", "is_pad"]].itertuples(index=False)]
            plain = [(i // 4, i % 4, i, False) for i in range(n if last != "drop" else n // 4 * 4)]
            if last == "fill" and n % 4:
                plain += [(n // 4, s, n - 1, True) for s in range(n % 4, 4)]
            assert out == plain and (not pieces or len(held) == 0)


def test_samples_after_the_end(spark, tmp_path):
    feeder = queue.Queue(str(tmp_path / "q"))
    feeder.put(rows("a", 0))
    feeder.end("a")
    run(spark, queue.stream(spark, str(tmp_path / "q")), str(tmp_path / "o"), str(tmp_path / "c"))
    feeder.put(rows("a", 1))
    with pytest.raises(Exception, match="after its end"):
        run(spark, queue.stream(spark, str(tmp_path / "q")), str(tmp_path / "o"), str(tmp_path / "c"))
    with pytest.raises(ValueError, match="no such policy"):
        batching.carried(queue.stream(spark, str(tmp_path / "q")), 2, "some")
