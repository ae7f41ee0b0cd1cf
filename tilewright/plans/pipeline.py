"""A pipeline facade: a lazy plan of samples, delivered in batches.

A pipeline function declares sources, operators and outputs; nothing runs
before a batch is asked for. The plan is an ordinary DataFrame, so it can be
written, joined or streamed as well as iterated.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import rng
from tilewright.operators import batches as grouped
from tilewright.operators import sharding


@dataclass
class Pipeline:
    """Settings, the lazy plan and the chosen outputs.

    The plan is the rows of the source, and the columns that operators make of
    them: those wait, so that a shard's batches are found by key alone and
    tensors are made for the samples of this shard only.
    """

    batch_size: int
    shard_id: int = 0
    num_shards: int = 1
    seed: int = 0
    shuffle: bool = False
    last_batch: str = "fill"
    rotate_shards: bool = False
    epoch: int = 0
    rows: DataFrame | None = None
    columns: list[dict[str, Column]] = field(default_factory=list)
    key: str = "sample_id"
    outputs: list[str] = field(default_factory=list)
    size: int | None = None
    placed: DataFrame | None = None
    color_format: str = "rgb"
    error: str = ""
    seconds: dict[str, float] = field(default_factory=dict)

    def source(self, samples: DataFrame, key: str = "sample_id") -> Pipeline:
        """``key`` tells samples apart: no two rows share one."""
        self.rows, self.columns, self.key, self.placed, self.size = samples, [], key, None, None
        return self

    @property
    def plan(self) -> DataFrame | None:
        """All samples, not only this shard's, with all columns."""
        return None if self.rows is None else self._made(self.rows)

    def _made(self, rows: DataFrame) -> DataFrame:
        return functools.reduce(DataFrame.withColumns, self.columns, rows)

    def apply(self, **columns: Column) -> Pipeline:
        """Adds or replaces columns: tensor, audio and box operators are Column functions."""
        self.columns.append(columns)
        return self

    def transform(self, f: Callable[..., DataFrame], *args, **kwargs) -> Pipeline:
        """An operator from DataFrame to DataFrame, which may change which rows there are."""
        self.rows, self.columns, self.placed, self.size = f(self.plan, *args, **kwargs), [], None, None
        return self

    def uniform(self, name: str, low: float, high: float) -> Column:
        """A random parameter of each sample, anew each epoch."""
        return rng.uniform_range(rng.uniform(self.seed, name, F.col(self.key), self.epoch), low, high)

    def drawn(self, effect: str, **given) -> dict[str, Column]:
        """The parameters of an effect for each sample: those given, and draws from its default ranges."""
        return rng.drawn(effect, self.seed, F.col(self.key), self.epoch, **given)

    def set_outputs(self, *names: str) -> Pipeline:
        self.outputs = list(names)
        return self

    def verify(self) -> bool:
        """Whether the plan has a source and all its outputs; if not, ``error`` says why. Nothing runs."""
        plan = self.plan
        missing = [c for c in [self.key, *self.outputs] if plan is None or c not in plan.columns]
        self.error = "the pipeline has no source" if plan is None else f"no column named {', '.join(missing)}" if missing else ""
        return not self.error

    def augmentation_branches(self) -> int:
        return len(self.outputs)

    def output_maxima(self, *columns: str) -> dict[str, int]:
        """The largest widths, heights or lengths of this data set, as buffers of one size need them."""
        return grouped.output_maxima(self.plan, list(columns or self.outputs))

    def total(self) -> int:
        if self.size is None:
            self.size = self.rows.count()
        return self.size

    def _places(self) -> DataFrame:
        """(rank, batch_id, slot, is_pad, _key) of the samples of all ranks: keys alone are ordered and numbered."""
        n = self.total()
        if self.placed is None:
            self.placed = sharding.positions((self.plan if self._keyed() else self.rows).select(self.key), self.key)
        # One numbering serves all epochs: a shuffle is arithmetic on it.
        placed = sharding.permuted_positions(self.placed, n, self.seed, self.epoch) if self.shuffle else self.placed
        # Shards are cut from the places; with rotation a rank takes another shard each epoch.
        own = sharding.assign_shards(placed, n, self.num_shards)
        filled = sharding.last_batch(own, n, self.num_shards, self.batch_size, self.last_batch)
        turn = self.epoch if self.rotate_shards else 0
        rank = F.pmod(F.col("shard") - turn, F.lit(self.num_shards)).cast("int")
        return sharding.batches(filled, self.batch_size).select(rank.alias("rank"), "batch_id", "slot", "is_pad", F.col(self.key).alias("_key"))

    def _keyed(self) -> bool:
        """Whether an operator makes the key."""
        return any(self.key in c for c in self.columns)

    def _found(self, places: DataFrame, *more: str) -> DataFrame:
        """The rows that the places' keys bring from the source; tensors are made for those alone."""
        same = F.col(self.key).eqNullSafe(F.col("_key"))
        found = self.plan.join(places, same) if self._keyed() else self._made(self.rows.join(places, same))
        return found.select(*more, "batch_id", "slot", "is_pad", self.key, *[c for c in self.outputs if c != self.key])

    def build(self) -> DataFrame:
        """All samples of this shard with batch_id, slot, is_pad and the outputs."""
        return self._found(self._places().where(F.col("rank") == self.shard_id))

    def deliver(self, consume: Callable[[int, Iterator[dict[str, list]]], None]) -> DataFrame:
        """Hands every rank its batches, in order, in a task of its own; (rank, batches, samples) of each.

        ``consume(rank, batches)`` runs where the task runs, so no row passes the
        driver; a batch is a dictionary of lists, as ``batches`` yields. All
        ranks start together. If one fails, all start again from their first
        batch: it is for ``consume`` to begin anew when it is called again. As
        many tasks as ranks must be able to run at a time.
        """
        names = [self.key, *[c for c in self.outputs if c != self.key]]
        dealt = self._found(self._places(), "rank").repartitionById(self.num_shards, F.col("rank")).sortWithinPartitions("batch_id", "slot")

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            context = BarrierTaskContext.get()
            rank, told = context.partitionId(), [0, 0]
            context.barrier()

            def batches() -> Iterator[dict[str, list]]:
                number, held = None, []
                for part in parts:
                    for row in part.to_pylist():
                        if row["batch_id"] != number and held:
                            yield {c: [r[c] for r in held] for c in names}
                            held = []
                        number = row["batch_id"]
                        held.append(row)
                        told[1] += 1
                        told[0] += row["slot"] == 0
                if held:
                    yield {c: [r[c] for r in held] for c in names}

            consume(rank, batches())
            yield pa.RecordBatch.from_pydict({"rank": pa.array([rank], pa.int32()), "batches": pa.array([told[0]], pa.int64()), "samples": pa.array([told[1]], pa.int64())})

        told = dealt.mapInArrow(run, "rank int, batches long, samples long", barrier=True)
        # What is told is shuffled: a barrier stage is run again only if it isn't a job's last.
        return told.groupBy("rank").agg(F.sum("batches").alias("batches"), F.sum("samples").alias("samples"))

    def reset(self) -> Pipeline:
        """The next epoch."""
        self.epoch += 1
        return self

    def shard_size(self) -> int:
        n, k = self.total(), self.num_shards
        source = (self.shard_id + self.epoch) % k if self.rotate_shards else self.shard_id
        return n * (source + 1) // k - n * source // k

    def last_batch_padded_size(self) -> int:
        return sharding.last_batch_padded_size(self.shard_size(), self.batch_size) if self.last_batch == "fill" else 0

    def remaining(self, pulled: int) -> int:
        """Samples left in this epoch after ``pulled`` batches."""
        return sharding.remaining(self.shard_size(), self.batch_size, pulled, self.last_batch)

    def is_empty(self, pulled: int) -> bool:
        return self.remaining(pulled) == 0

    def batches(self) -> Iterator[dict[str, list]]:
        """Batches in order, a partition at a time: the driver holds one partition, not the data set."""
        began = time.perf_counter()
        ordered = self.build().repartitionByRange("batch_id").sortWithinPartitions("batch_id", "slot")
        self.seconds = {"build": time.perf_counter() - began, "wait": 0.0}
        names = [self.key, *[c for c in self.outputs if c != self.key]]
        current, rows = None, []
        for row in self._timed(ordered.toLocalIterator(prefetchPartitions=True)):
            if row["batch_id"] != current and rows:
                yield {c: [r[c] for r in rows] for c in names}
                rows = []
            current = row["batch_id"]
            rows.append(row)
        if rows:
            yield {c: [r[c] for r in rows] for c in names}

    def _timed(self, rows: Iterator) -> Iterator:
        """``rows``; the time spent on waiting for them adds up in ``seconds``."""
        while True:
            began = time.perf_counter()
            row = next(rows, None)
            self.seconds["wait"] += time.perf_counter() - began
            if row is None:
                return
            yield row

    def arrays(self, tensor: str, shape: tuple[int, ...], label: str | None = None, dtype: str = "float32") -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Batches of one tensor as arrays of (batch, *shape), and of labels."""
        for batch in self.batches():
            yield np.asarray(batch[tensor], dtype).reshape(-1, *shape), None if label is None else np.asarray(batch[label])

    def padded(self, ragged: str, width: int | None = None, fill: float = 0.0) -> Iterator[np.ndarray]:
        """Batches of a ragged column, each row filled up or cut to ``width``; by default the longest row's, so that none is cut."""
        if width is None:
            width = self.output_maxima(ragged)[ragged] or 0
        for batch in self.batches():
            out = np.full((len(batch[ragged]), width), fill, "float32")
            for i, values in enumerate(batch[ragged]):
                some = list(values or [])[:width]
                out[i, : len(some)] = some
            yield out


def pipeline_def(function: Callable | None = None, **settings):
    """Turns a function that declares a plan into a pipeline factory.

    Keyword arguments that name a setting go to the pipeline, others to the
    function; the function gets the pipeline first and returns output names.
    """
    known = {f for f in Pipeline.__dataclass_fields__ if f not in ("rows", "columns", "key", "outputs", "size", "placed", "error", "seconds")}

    def wrap(f: Callable):
        @functools.wraps(f)
        def make(*args, **kwargs) -> Pipeline:
            own = settings | {k: v for k, v in kwargs.items() if k in known}
            p = Pipeline(**own)
            names = f(p, *args, **{k: v for k, v in kwargs.items() if k not in known})
            return p.set_outputs(*([names] if isinstance(names, str) else names or []))

        return make

    return wrap(function) if function else wrap
