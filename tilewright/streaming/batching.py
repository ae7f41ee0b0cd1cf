"""Batches that go on over micro-batches.

A stream brings samples of several feeds in pieces of any size. Each feed keeps
a state: the number of its next batch and the samples, fewer than a batch, that
wait for it. Full batches are handed on as soon as they are full; what is left
is handed on, filled up or dropped when the feed's end mark comes. The state is
kept by the stream's checkpoint, so a restarted stream goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

_STATE = "next long, ended boolean, held binary"


def _stored(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _restored(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def cut(held: pd.DataFrame, number: int, batch: int, ended: bool, last: str) -> tuple[pd.DataFrame, pd.DataFrame, int]:
    """(rows of the batches that are due, with batch_id, slot and is_pad; rows that wait; next batch's number)."""
    n = len(held)
    due = n // batch * batch
    pad = 0
    if ended and n > due and last != "drop":
        pad = batch - (n - due) if last == "fill" else 0
        due = n
    out = held.iloc[:due]
    if pad:
        # The last sample stands for what is lacking.
        out = pd.concat([out, *[held.iloc[[n - 1]]] * pad])
    at = pd.RangeIndex(len(out))
    out = out.assign(batch_id=number + at // batch, slot=(at % batch).astype("int32"), is_pad=at >= due)
    return out, held.iloc[0 if ended else due :].iloc[: 0 if ended else None], number + -(-len(out) // batch)


def carried(samples: DataFrame, batch: int, last: str = "partial", feed: str = "feed", order: str = "sample", end: str = "last") -> DataFrame:
    """The samples of a stream with batch_id, slot and is_pad, counted by feed.

    Within a micro-batch samples come in the order of ``order``, and those of
    earlier micro-batches before. ``end`` marks a row that is no sample but a
    feed's end; samples that come after it are an error. ``last`` says what
    becomes of a short last batch: "partial", "fill" or "drop".
    """
    if last not in ("partial", "fill", "drop"):
        raise ValueError(f"no such policy: {last}")
    kept = samples.drop(end)
    out = StructType([*kept.schema.fields, *(StructField(c, k) for c, k in (("batch_id", LongType()), ("slot", IntegerType()), ("is_pad", BooleanType())))])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, ended, held = state.get if state.exists else (0, False, None)
        new = pd.concat(list(frames), ignore_index=True)
        marks = new[end].fillna(False).astype(bool)
        rows = new[~marks].drop(columns=end).sort_values(order, kind="stable")
        if ended and len(rows):
            raise ValueError(f"samples of feed {key[0]} came after its end")
        ended = bool(ended or marks.any())
        whole = rows if held is None else pd.concat([_restored(held), rows], ignore_index=True)
        done, rest, number = cut(whole, number, batch, ended, last)
        state.update((number, ended, _stored(rest.reset_index(drop=True)) if len(rest) else None))
        if len(done):
            yield done[[f.name for f in out.fields]]

    return samples.groupBy(F.col(feed)).applyInPandasWithState(step, out, _STATE, "append", GroupStateTimeout.NoTimeout)
