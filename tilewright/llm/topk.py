"""Exact top-k by inner product: branch and bound over columns.

Vectors are stored in blocks and each block column by column: a row of the
stored table holds some thousand vectors, cut into groups of dimensions, each
group a matrix of its own. A tile of queries meets a block one group of
dimensions at a time. After a group every pair has a partial score and, by
Cauchy-Schwarz, a bound on what the masses of the remaining dimensions can
still add. A pair whose bound lies below its query's k-th best score so far is
out; candidates that no query of the tile needs any more leave the columns, and
when few pairs are left these go on alone as a list that is compacted after
each group. Groups come in the order of their mass over all vectors, so bounds
close early.

Queries are dealt into rounds of a bounded number; the tiles of a round are
broadcast and every task scans its blocks against them. A first scan over some
blocks of each task settles each query's k-th score there, and the second scan,
over all others, starts from it. Each task hands on at most k rows a query, and
ties; a grouped rank picks the last k.

Scores are exact: components become integers, and a tile and a block whose sums
could leave what a double holds exactly are multiplied as Python integers.

Defined results: vectors that are null or hold a null, NaN or infinite
component take no part, nor do rows of null id; vectors meet those of their own
length alone, empty ones score zero; rows that repeat an id are rows of their
own, each a candidate for the others; of candidates equal in score and id it is
open which is ranked first; scores outside a long are held to its ends; an
empty table, or one without queries, gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.storage import written

#: Vectors in a stored block, queries in a tile, bytes of queries that are broadcast at a time.
BLOCK = 2048
TILE = 512
ROUND_BYTES = 16 << 20
#: Dimensions in a group.
GROUP = 16
#: One stored block of so many of a task is scanned first.
FIRST = 32
#: With fewer than one pair in so many left, pairs go on alone.
SPARSE = 24
_EXACT, _HUGE = 1 << 53, 1e150
_LONG = np.iinfo(np.int64)


def scaled(vector: Column, scale: int = 1024) -> Column:
    """Each component x as floor(scale * x), a double without a fraction; null if the vector takes no part."""
    x = vector.cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) != F.lit(float("inf"))))
    # Spark's floor of a double goes through a long, which large components would leave.
    floored = lambda v: v * scale - F.pmod(v * scale, F.lit(1.0))
    small = lambda v: F.when(F.abs(v) < 2.0**40, F.floor(v * scale).cast("double")).otherwise(floored(v))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(x, small))


def _packed(matrix: np.ndarray) -> bytes:
    return np.ascontiguousarray(matrix, np.float64).tobytes() if abs(matrix).max(initial=0) >= 1 << 31 else np.ascontiguousarray(matrix, np.int32).tobytes()


def _unpacked(data: bytes, count: int, dims: int) -> np.ndarray:
    kind = np.int32 if len(data) == 4 * count * dims else np.float64
    return np.frombuffer(data, kind).reshape(dims, count).astype(np.float64)


_STORED = "dims int, n int, first boolean, ids binary, rows binary, columns array<binary>"


def store(vectors: DataFrame, order: list[int] | None = None, block_rows: int = BLOCK, group: int = GROUP, first: int = FIRST) -> DataFrame:
    """Blocks of the (id, v) of ``vectors``: their ids, their row numbers and a matrix for each group of dimensions.

    ``order`` lists the dimensions by falling mass; those it doesn't name come last.
    """
    named = order or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made = 0

        def block(dims: int) -> pa.RecordBatch:
            nonlocal made
            parts = held.pop(dims)
            ids, rows = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            values = np.concatenate([p[2] for p in parts])
            turn = [d for d in named if d < dims]
            turn += sorted({*range(dims)} - {*turn})
            columns = [_packed(values[:, turn[g : g + group]].T) for g in range(0, dims, group)]
            one = [[dims], [len(ids)], [made % first == 0], [ids.tobytes()], [rows.tobytes()], [columns]]
            made += 1
            kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, kinds)], names=["dims", "n", "first", "ids", "rows", "columns"])

        for batch in batches:
            ids, rows, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
            for dims in np.unique(sizes).tolist():
                which = np.flatnonzero(sizes == dims)
                for at in range(0, len(which), block_rows):
                    some = which[at : at + block_rows]
                    values = flat[starts[some][:, None] + np.arange(dims)]
                    held.setdefault(dims, []).append((ids[some], rows[some], values))
                    if sum(len(p[0]) for p in held[dims]) >= block_rows:
                        yield block(dims)
        for dims in list(held):
            yield block(dims)

    rows = vectors.where("id IS NOT NULL AND v IS NOT NULL").select("id", F.monotonically_increasing_id().alias("row"), "v")
    return rows.mapInArrow(run, _STORED)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row after the other, since each is large."""
    return (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows))


def _matrices(row: dict, group: int) -> list[np.ndarray]:
    sizes = [min(group, row["dims"] - g) for g in range(0, row["dims"], group)]
    return [_unpacked(c, row["n"], d) for c, d in zip(row["columns"], sizes)]


def _rest(groups: list[np.ndarray], n: int) -> list[np.ndarray]:
    """For each group the length of what comes after it, never too small."""
    mass = [(g * g).sum(axis=0) for g in groups]
    after = np.zeros(n)
    rest = []
    for m in reversed(mass):
        rest.append(np.sqrt(after) * (1 + 1e-9))
        after = after + m
    return rest[::-1]


class Tile:
    """Some queries of one length, with the best scores so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, groups: list[np.ndarray], k: int, floor: np.ndarray) -> None:
        self.ids, self.rows, self.k = ids, rows, k
        self.groups = [np.ascontiguousarray(g.T) for g in groups]
        self.rest = _rest(groups, len(ids))
        self.most = max((abs(g).max(initial=0) for g in groups), default=0)
        self.floor = floor  # no score below it can be among the k best
        self.query = self.vec = np.empty(0, np.int64)
        self.score = np.empty(0)

    def meet(self, ids: np.ndarray, rows: np.ndarray, groups: list[np.ndarray], rest: list[np.ndarray], most: float) -> None:
        dims = sum(len(g) for g in groups)
        if self.most * most * dims >= _EXACT or max(self.most, most) >= _HUGE:
            score = sum((q.astype(object) @ c.astype(object) for q, c in zip(*self._as_integers(groups))), np.zeros((len(self.ids), len(ids)), object))
            score = np.clip(score, _LONG.min, _LONG.max)
            self._take(*np.indices(score.shape).reshape(2, -1), score.reshape(-1), ids, rows)
            return
        alive, score = np.arange(len(ids)), np.zeros((len(self.ids), len(ids)))
        for g, (q, c) in enumerate(zip(self.groups, groups)):
            score += q @ c[:, alive]
            if g + 1 == len(groups):
                break
            keep = score + self.rest[g][:, None] * rest[g][alive] + 1 >= self.floor[:, None]
            if keep.sum() * SPARSE < keep.size:
                self._pairs(g + 1, *np.nonzero(keep), score, alive, ids, rows, groups, rest)
                return
            needed = keep.any(axis=0)
            if needed.mean() < 0.75:
                alive, score = alive[needed], score[:, needed]
        if score.shape[1] > 4 * self.k:
            at = score.shape[1] - self.k - 1  # one more, for the query itself
            least = np.maximum(self.floor, np.partition(score, at, axis=1)[:, at])
        else:
            least = self.floor
        qi, ci = np.nonzero(score >= least[:, None])
        self._take(qi, alive[ci], score[qi, ci], ids, rows)

    def _as_integers(self, groups: list[np.ndarray]) -> tuple[list, list]:
        whole = np.vectorize(int, otypes=[object])
        return [whole(q) if q.size else q for q in self.groups], [whole(c) if c.size else c for c in groups]

    def _pairs(self, g: int, qi: np.ndarray, at: np.ndarray, score: np.ndarray, alive: np.ndarray, ids: np.ndarray, rows: np.ndarray, groups: list[np.ndarray], rest: list[np.ndarray]) -> None:
        """The pairs that are left, as a list, from group g on."""
        ci, score = alive[at], score[qi, at]
        for g in range(g, len(groups)):
            score = score + np.einsum("ij,ji->i", self.groups[g][qi], groups[g][:, ci])
            keep = score + self.rest[g][qi] * rest[g][ci] + (g + 1 < len(groups)) >= self.floor[qi]
            qi, ci, score = qi[keep], ci[keep], score[keep]
        self._take(qi, ci, score, ids, rows)

    def _take(self, qi: np.ndarray, ci: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        other = self.rows[qi] != rows[ci]
        qi, ci, score = qi[other], ci[other], score[other]
        if not len(qi):
            return
        if score.dtype == object or self.score.dtype == object:
            self.score, score = self.score.astype(object), score.astype(object)
        query, vec, score = np.r_[self.query, qi], np.r_[self.vec, ids[ci]], np.r_[self.score, score]
        order = np.lexsort((vec, -score, query)) if score.dtype != object else np.array(sorted(range(len(query)), key=lambda i: (query[i], -score[i], vec[i])))
        query, vec, score = query[order], vec[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < self.k
        last = place == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last].astype(np.float64))
        self.query, self.vec, self.score = query[best], vec[best], score[best]


def _search(blocks: DataFrame, tiles: list[dict], k: int, group: int) -> DataFrame:
    """(query, query_row, vec, score): of each stored block's task, the k best rows for each query of ``tiles``."""
    shared = blocks.sparkSession.sparkContext.broadcast(tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, list[Tile]] = {}
        for t in shared.value:
            ids, rows = (np.frombuffer(t[c], np.int64) for c in ("ids", "rows"))
            floor = np.frombuffer(t["floor"]).copy() if "floor" in t else np.full(t["n"], -np.inf)
            mine.setdefault(t["dims"], []).append(Tile(ids, rows, _matrices(t, group), k, floor))
        for batch in batches:
            for row in _rows(batch):
                if row["dims"] in mine:
                    groups = _matrices(row, group)
                    rest = _rest(groups, row["n"])
                    ids, rows = (np.frombuffer(row[c], np.int64) for c in ("ids", "rows"))
                    most = max((abs(g).max(initial=0) for g in groups), default=0)
                    for tile in mine[row["dims"]]:
                        tile.meet(ids, rows, groups, rest, most)
        for tile in (t for same in mine.values() for t in same):
            score = pa.array([int(s) for s in tile.score], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(tile.ids[tile.query]), pa.array(tile.rows[tile.query]), pa.array(tile.vec), score], names=["query", "query_row", "vec", "score"]
            )

    return blocks.mapInArrow(run, "query long, query_row long, vec long, score long")


def _tiles(blocks: DataFrame, divisor: int, group: int) -> DataFrame:
    """The stored rows whose id ``divisor`` divides, in the same form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                ids = np.frombuffer(row["ids"], np.int64)
                for at in np.array_split(chosen := np.flatnonzero(ids % divisor == 0), -(-len(chosen) // TILE) or 1):
                    if len(at):
                        columns = [_packed(m[:, at]) for m in _matrices(row, group)]
                        one = [row["dims"], len(at), True, ids[at].tobytes(), np.frombuffer(row["rows"], np.int64)[at].tobytes(), columns]
                        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, kinds)], names=["dims", "n", "first", "ids", "rows", "columns"])

    return blocks.mapInArrow(run, _STORED)


def _joined(parts: list[dict], group: int) -> list[dict]:
    """Tiles of one length made one, up to TILE queries each: blocks of a small share of queries give small tiles."""
    out: list[dict] = []
    for p in sorted(parts, key=lambda p: (p["dims"], p["ids"])):
        t = out[-1] if out else None
        if t and t["dims"] == p["dims"] and t["n"] + p["n"] <= TILE:
            both = [np.concatenate(m, axis=1) for m in zip(_matrices(t, group), _matrices(p, group))]
            out[-1] = {"dims": t["dims"], "n": t["n"] + p["n"], "ids": t["ids"] + p["ids"], "rows": t["rows"] + p["rows"], "columns": [_packed(m) for m in both]}
        else:
            out.append(dict(p))
    return out


def masses(vectors: DataFrame) -> list[int]:
    """Dimensions by falling mass over all of ``vectors``; only the heaviest 4,096 are named, since a vector's length isn't bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(0)
        for batch in batches:
            lists = batch.column(0)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            flat = flat[offsets[0] : offsets[-1]]
            d = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], np.diff(offsets))
            more = np.bincount(d, np.minimum(flat * flat, 1e300), len(mass)) if len(d) else np.zeros(0)
            more[: len(mass)] += mass
            mass = more if len(more) else mass
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mass), dtype=np.int32)), pa.array(mass)], names=["d", "m"])

    each = vectors.where("v IS NOT NULL").select("v").mapInArrow(run, "d int, m double")
    return [r.d for r in each.groupBy("d").agg(F.sum("m").alias("m")).orderBy(F.desc("m"), "d").limit(4096).collect()]


def search(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    divisor: int = 100,
    k: int = 10,
    scale: int = 1024,
    block_rows: int = BLOCK,
    group: int = GROUP,
    first: int = FIRST,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for every row whose id ``divisor`` divides.

    A component x counts as floor(scale * x); ties go to the smaller id.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), scaled(F.col(vector), scale).alias("v"))
    blocks = written(store(rows, masses(rows), block_rows, group, first), "blocks")
    tiles = _tiles(blocks, divisor, group)
    size = F.aggregate("columns", F.lit(0), lambda a, c: a + F.octet_length(c)) + F.octet_length("ids")
    rounds = -(-(tiles.agg(F.sum(size)).first()[0] or 0) // round_bytes)
    found = None
    if rounds > 1:
        # A block's queries go together; a block holds a small part of a round, so rounds are even but for chance.
        tiles = written(tiles.withColumn("round", F.pmod(F.xxhash64("ids"), F.lit(rounds))), "tiles")
    for r in range(rounds):
        mine = _joined([t.asDict() for t in (tiles.where(F.col("round") == r) if rounds > 1 else tiles).collect()], group)
        early = written(_search(blocks.where("first"), mine, k, group), "best")
        floors = {x.query_row: x.score for x in _ranked(early, k).where(F.col("rank") == k).select("query_row", "score").collect()}
        for t in mine:
            t["floor"] = np.array([floors.get(row, -np.inf) for row in np.frombuffer(t["rows"], np.int64).tolist()], np.float64).tobytes()
        rest = written(_search(blocks.where("NOT first"), mine, k, group), "best")
        best = _ranked(early.unionByName(rest), k)
        best = written(best, "best") if rounds > 1 else best
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "query long, query_row long, vec long, score long, rank int")
    return found.select(F.col("query").alias("query_id"), "rank", F.col("vec").alias("vec_id"), "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
