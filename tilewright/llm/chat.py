"""Chat formatting with prefix-target expansion.

A conversation is formatted once, as one stream of marked turns. Every
assistant turn then becomes an example of its own: its context is the stream
up to that reply, and only the reply is trainable. Contexts are prefixes of
the one stream, so an example holds offsets, not a copy: storage stays linear
in the conversation, where copies would grow with its square.
``example_texts`` makes the copies for those who want them.

Template, for each turn: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Inside roles
and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so that control
strings in texts can't end a turn; ``unescape`` undoes both.

Defined results: a null text, role or turn is an empty text, an empty role, a
first turn; rows that repeat a turn are all kept, ordered by turn, role and
text; conversations of null id are one conversation; a conversation without an
assistant has no examples; an empty table gives an empty table; extra columns
are ignored. A conversation must fit in one string (2 GB); the work on one with
very many turns or a very long text is in proportion to it. Built from
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """A role also loses its line breaks, which end the header."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, stream, examples): the formatted stream and a struct of offsets for each assistant turn.

    ``examples`` has context_end (code points of context before the reply) and
    target_end; ``stream[0:target_end]`` is the example and
    ``stream[context_end:target_end]`` its only trainable part.
    """
    known = lambda c: F.coalesce(F.col(c), F.lit(""))
    t = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), known(role).alias("role"), known(text).alias("text"))
    marked = t.select(
        "*",
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        F.concat(escape(F.col("text")), F.lit(END + "\n")).alias("body"),
    )
    # The window and the grouping share one exchange; offsets are running sums over the rows of a conversation.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("head") + F.char_length("body")
    placed = marked.withColumn("end", F.sum(size).over(order).cast("int"))
    one = F.struct("end", (F.col("role") == ASSISTANT).alias("trainable"), "head", "body")
    c = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("m"))
    spans = F.transform(
        F.filter("m", lambda x: x["trainable"]),
        lambda x: F.struct((x["end"] - F.char_length(x["body"])).alias("context_end"), (x["end"] - len(END) - 1).alias("target_end")),
    )
    stream = F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"])), "")
    return c.select("conv_id", stream.alias("stream"), spans.alias("examples"))


def examples(formatted: DataFrame) -> DataFrame:
    """One row for each assistant turn: (conv_id, example, context_end, target_end, target)."""
    # Targets are cut before the rows are made, so that none carries the stream, and from the
    # stream's pieces, since a substring is found by counting from the beginning.
    head = f"{START}{ASSISTANT}\n"
    replies = F.filter(_pieces(F.col("stream")), lambda p: p.startswith(head))
    cut = F.zip_with("examples", replies, lambda e, p: F.struct(e["context_end"], e["target_end"], F.substring(p, F.lit(len(head) + 1), F.char_length(p)).alias("target")))
    return formatted.select("conv_id", F.posexplode(cut).alias("example", "e")).select("conv_id", "example", "e.context_end", "e.target_end", "e.target")


def example_texts(formatted: DataFrame) -> DataFrame:
    """As ``examples``, with the context copied out: quadratic in a conversation's length."""
    return formatted.select("conv_id", "stream", F.posexplode("examples").alias("example", "e")).select(
        "conv_id",
        "example",
        F.substring(F.col("stream"), F.lit(1), F.col("e.context_end")).alias("context"),
        F.substring(F.col("stream"), F.col("e.context_end") + 1, F.col("e.target_end") - F.col("e.context_end")).alias("target"),
    )


def _pieces(stream: Column) -> Column:
    """The turns of a stream without what ends them; what follows the last one is empty."""
    return F.filter(F.split(stream, r"<\|im_end\|>\n"), lambda p: p != "")


def parsed(stream: Column) -> Column:
    """The turns of a stream, read back: an array of (role, text)."""

    def one(p: Column) -> Column:
        body = F.substring(p, F.lit(len(START) + 1), F.char_length(p))
        cut = F.instr(body, "\n")
        return F.struct(
            unescape_role(F.substring(body, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(body, cut + 1, F.char_length(body))).alias("text"),
        )

    return F.transform(_pieces(stream), one)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted output alone: n_turns, turns, loss_text, formatted_chars.

    ``loss_text`` joins what the examples train on, in order: each stands under
    the loss mask of its own example and of no other. It comes from the rows of
    ``examples``, grouped back; they hold targets only, so that this stays
    linear. A row of the stream itself goes with them, in the same list: a
    maximum of its own would copy the stream for every row.
    """
    none = F.lit(None).cast("string")
    whole = formatted.select("conv_id", F.struct(F.lit(-1).alias("example"), none.alias("target"), F.col("stream")).alias("e"))
    each = examples(formatted).select("conv_id", F.struct("example", unescape(F.col("target")).alias("target"), none.alias("stream")).alias("e"))
    back = whole.unionByName(each).groupBy("conv_id").agg(F.sort_array(F.collect_list("e")).alias("e"))
    back = back.select("conv_id", F.get("e", F.lit(0))["stream"].alias("stream"), F.slice("e", F.lit(2), F.size("e")).alias("e"))
    return back.select(
        "conv_id",
        parsed(F.col("stream")).alias("turns"),
        F.array_join("e.target", "").alias("loss_text"),
        F.size("e").cast("long").alias("n_examples"),
        F.char_length("stream").cast("long").alias("formatted_chars"),
    )
