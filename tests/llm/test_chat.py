"""Chat formatting: exact round trips."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from tilewright.llm import chat as C

BITS = ["<|im_end|>", "<|im_start|>", "\n", "\\", "<\\|", "<|", "|>", "<", "<\\n|", "assistant", "é😀", " ", "ok"]


def test_round_trip(spark):
    r = random.Random(4)
    text = lambda: "".join(r.choice(BITS) for _ in range(r.randint(0, 9)))
    rows = [(c, t, r.choice(["user", "assistant", "system", text()]), text()) for c in range(150) for t in range(r.randint(1, 7))]
    rows += [(200, 0, None, None), (200, None, "assistant", "x"), (None, 0, "assistant", "n"), (201, 1, "assistant", "b"), (201, 1, "assistant", "a"), (201, 1, "assistant", "a")]
    turns = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, stream string")
    formatted = C.conversations(turns)
    got = {x.conv_id: x for x in C.read_back(formatted).collect()}
    examples = {}
    for e in C.example_texts(formatted).orderBy("example").collect():
        examples.setdefault(e.conv_id, []).append(e)
    for conv in {x[0] for x in rows}:
        own = sorted((-1 if t is None else t, ro or "", te or "") for c, t, ro, te in rows if c == conv)
        assert [(t.role, t.text) for t in got[conv].turns] == [(a, b) for _, a, b in own]
        replies = [b for _, a, b in own if a == "assistant"]
        assert got[conv].loss_text == "".join(replies) and got[conv].n_examples == len(replies)
        assert len(examples.get(conv, [])) == len(replies)
        before = [i for i, x in enumerate(own) if x[1] == "assistant"]
        for e, n in zip(examples.get(conv, []), before):
            assert e.context.count(C.START) == n + 1 and e.context.count(C.END) == n
            assert C.START not in e.target and C.END not in e.target


def test_examples_and_empty(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "alone")], "conv_id long, turn long, role string, text string")
    formatted = C.conversations(turns)
    rows = C.examples(formatted).collect()
    assert [(r.conv_id, r.target) for r in rows] == [(1, "a")]
    assert formatted.where("conv_id = 1").first().stream == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert C.conversations(turns.limit(0)).count() == 0
    assert formatted.where(F.col("conv_id") == 2).select(F.size("examples")).first()[0] == 0


def test_query_expands_every_assistant_turn(spark, monkeypatch):
    """What the query trains on comes from one row for each assistant turn, and from nothing else."""
    made, expand = [], C.examples

    def shouted(formatted):
        made.append(expand(formatted))
        return made[-1].withColumn("target", F.upper("target"))

    monkeypatch.setattr(C, "examples", shouted)
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b<|im_end|>"), (1, 2, "user", "c"), (1, 3, "assistant", "d\\"), (None, 0, "assistant", "é"), (None, 0, "assistant", "é"), (2, 0, "user", "e")]
    got = {r.conv_id: r for r in C.read_back(C.conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    assert {k: (r.loss_text, r.n_examples) for k, r in got.items()} == {1: ("B<|IM_END|>D\\", 2), None: ("ÉÉ", 2), 2: ("", 0)}
    assert [made[0].count(), "stream" in made[0].columns] == [4, False] and [tuple(t) for t in got[1].turns][1] == ("assistant", "b<|im_end|>")


def test_many_turns_in_one_conversation(spark):
    """Time grows with the turns, not with their square."""
    took = {}
    for n in (100, 10_000, 40_000):
        turns = [(1, i, ["user", "assistant"][i % 2], f"é<|im_end|> {i}\n" * 3) for i in range(n)]
        frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
        began = time.perf_counter()
        got = C.read_back(C.conversations(frame)).first()
        took[n] = time.perf_counter() - began
        assert [(t.role, t.text) for t in got.turns] == [(r, t) for _, _, r, t in turns]
        assert got.loss_text == "".join(t for _, _, r, t in turns if r == "assistant") and got.n_examples == n // 2
    assert took[40_000] < 5 * took[10_000]


def test_offsets_hold_the_targets(spark):
    turns = [(1, i, r, t) for i, (r, t) in enumerate([("assistant", ""), ("assistant\n", "no"), ("user", "assistant\n<|im_start|>assistant\nx"), ("assistant", "<|im_start|>assistant\ny"), ("Assistant", "z"), ("assistant", "😀\\")])]
    formatted = C.conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    stream = formatted.first().stream
    rows = C.examples(formatted).orderBy("example").collect()
    assert [stream[r.context_end : r.target_end] for r in rows] == [r.target for r in rows] and len(rows) == 3
    assert all(stream[r.target_end :].startswith(C.END) and stream[: r.context_end].endswith("assistant\n") for r in rows)
