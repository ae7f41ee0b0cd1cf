"""Sharding, labels, sequences, random parameters and summaries on the relational tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import effects, rng
from tilewright.functions import tensor as T
from tilewright.operators import augment, labels, random_crops, sequences, sharding, spectral
from tilewright.plans.vectors import _BOXED, _DOUBLES, _PIXELS, boxed, long_form, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- sharding and batching ---

_SHARDED = """
    n AS (SELECT count(*) AS n FROM embeddings),
    p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings),
    s AS (SELECT vec_id, pos, n, CAST(floor(((pos + 1) * 4 - 1) / n) AS INT) AS shard FROM p, n),
    z AS (SELECT *, n * shard // 4 AS first, n * (shard + 1) // 4 - n * shard // 4 AS size FROM s),
    t AS (SELECT vec_id, shard, size, n, pos - first AS shard_pos FROM z)"""


def _sharded(spark: SparkSession, d: str, epoch: int = 0, rotate: bool = False) -> tuple[DataFrame, int]:
    e = table(spark, d, "embeddings").select("vec_id")
    placed = sharding.positions(e, "vec_id")
    n = e.count()
    return sharding.assign_shards(placed, n, 4, epoch, rotate), n


@query("""
    WITH n AS (SELECT count(*) AS n FROM lineitem),
    p AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS pos FROM lineitem)
    SELECT CAST(floor(((pos + 1) * 7 - 1) / n) AS INT) AS shard, count(*) AS n_rows, CAST(sum(l_partkey) AS BIGINT) AS sum_partkey,
        min(l_orderkey) AS first_order, max(l_orderkey) AS last_order
    FROM p, n GROUP BY 1""")
def shard_assign(spark, d):
    """Seven contiguous shards of lineitem."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    n = rows.count()
    placed = sharding.positions(rows, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return sharding.assign_shards(placed, n, 7).groupBy("shard").agg(
        F.count("*").alias("n_rows"), F.sum("l_partkey").alias("sum_partkey"), F.min("l_orderkey").alias("first_order"), F.max("l_orderkey").alias("last_order")
    )


@query(f"""
    WITH {_SHARDED},
    c AS (SELECT *, CASE WHEN shard_pos = size - 1 THEN CASE WHEN ((n + 3) // 4) % 32 = 0 THEN (n + 3) // 4 ELSE (n + 3) // 4 + 32 - ((n + 3) // 4) % 32 END - size ELSE 0 END AS pads FROM t),
    x AS (SELECT vec_id, shard, shard_pos, unnest(range(0, pads + 1)) AS k FROM c)
    SELECT vec_id, shard, (shard_pos + k) // 32 AS batch_id, CAST((shard_pos + k) % 32 AS INT) AS slot, k > 0 AS is_pad FROM x""")
def pad_last_batch(spark, d):
    """Equally many full batches in each of four shards."""
    s, n = _sharded(spark, d)
    return sharding.batches(sharding.pad_batches(s, n, 4, 32), 32).select("vec_id", "shard", "batch_id", "slot", "is_pad")


def _policy(name: str, policy: str, sql: str) -> None:
    def run(spark, d):
        s, n = _sharded(spark, d)
        return sharding.batches(sharding.last_batch(s, n, 4, 48, policy), 48).select("vec_id", "shard", "batch_id", "slot", "is_pad")

    QUERIES[name] = run
    ORACLES[name] = f"WITH {_SHARDED}, x AS ({sql}) SELECT vec_id, shard, p // 48 AS batch_id, CAST(p % 48 AS INT) AS slot, is_pad FROM x"


_policy("last_batch_fill", "fill", "SELECT vec_id, shard, shard_pos + k * size AS p, k > 0 AS is_pad FROM t, range(0, 49) r(k) WHERE shard_pos + k * size < (size + 47) // 48 * 48")
_policy("last_batch_drop", "drop", "SELECT vec_id, shard, shard_pos AS p, false AS is_pad FROM t WHERE shard_pos < size // 48 * 48")
_policy("last_batch_partial", "partial", "SELECT vec_id, shard, shard_pos AS p, false AS is_pad FROM t")


@query(f"WITH {_SHARDED} SELECT vec_id, CAST((shard - 1 + 4) % 4 AS INT) AS shard, shard_pos FROM t")
def epoch_rotate(spark, d):
    """Shard numbers after one epoch."""
    return _sharded(spark, d, 1, True)[0].select("vec_id", "shard", "shard_pos")


def _u(name: str, key: str, draw: str = "0") -> str:
    """``rng.uniform`` of seed 42 in SQL."""
    return f"(('0x' || substr(md5('42:{name}:0:' || {key} || ':' || {draw}), 1, 13))::BIGINT / 4503599627370496.0)"


@query(f"""
    WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY {_u('shuffle', 'vec_id')}, vec_id) - 1 AS pos FROM embeddings)
    SELECT vec_id, pos // 32 AS batch_id, CAST(pos % 32 AS INT) AS slot FROM p""")
def shuffled_batches(spark, d):
    """A seeded order of all vectors, in batches."""
    placed = sharding.shuffled_positions(table(spark, d, "embeddings").select("vec_id"), "vec_id", 42)
    return placed.select("vec_id", F.floor(F.col("pos") / 32).alias("batch_id"), (F.col("pos") % 32).cast("int").alias("slot"))


@query(f"""
    WITH {_SHARDED}
    SELECT vec_id, CAST(pos // 150 AS INT) AS shard, pos % 150 AS shard_pos FROM t JOIN p USING (vec_id)""")
def explicit_shard_size(spark, d):
    """Shards of 150 samples."""
    placed = sharding.positions(table(spark, d, "embeddings").select("vec_id"), "vec_id")
    return sharding.shards_of_size(placed, 150).select("vec_id", "shard", "shard_pos")


@query(f"""
    WITH {_SHARDED},
    k AS (SELECT shard, size, first + size AS end_, n FROM (SELECT DISTINCT shard, size, first, n FROM z)),
    f AS (SELECT shard, size + i AS shard_pos, (end_ + i) % n AS pos FROM k, range(0, 48) r(i) WHERE i < (48 - size % 48) % 48)
    SELECT vec_id, shard, shard_pos, false AS is_pad FROM t
    UNION ALL SELECT vec_id, shard, shard_pos, true FROM f JOIN p USING (pos)""")
def last_batch_fill_next(spark, d):
    """Four shards whose last batch of 48 goes on into the next shard."""
    e = table(spark, d, "embeddings").select("vec_id")
    return sharding.fill_from_next(sharding.positions(e, "vec_id"), e.count(), 4, 48).select("vec_id", "shard", "shard_pos", "is_pad")


@query("""
    WITH g AS (SELECT page_id, length(html) AS h, length(url) * 40 AS w FROM pages),
    r AS (SELECT page_id, CAST(h * 1.0 / w <= 1 AS INT) AS wide, h::DOUBLE / w AS ratio FROM g),
    q AS (SELECT page_id, wide, row_number() OVER (PARTITION BY wide ORDER BY ratio, page_id) - 1 AS p FROM r)
    SELECT page_id, wide, p // 16 AS batch_id, CAST(p % 16 AS INT) AS slot FROM q""")
def aspect_ratio_group(spark, d):
    """Batches that hold one kind of shape; a page's text lengths stand for its sides."""
    p = table(spark, d, "pages").select("page_id", F.length("html").alias("h"), (F.length("url") * 40).alias("w"))
    return sharding.aspect_groups(p, F.col("w"), F.col("h"), "page_id", 16).select("page_id", "wide", "batch_id", "slot")


def _walked(name: str, sizes: str, prefix: str) -> str:
    """Tables of a permutation of 0..n-1 in SQL; ``sizes`` is a query for n, and ``prefix``w has (x, y): x goes to y."""
    draw = lambda key, k, m: f"CAST(floor({_u(name, key, str(k))} * {m}) AS BIGINT)"
    return f"""
        {prefix}k AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM ({sizes}))),
        {prefix}1 AS (SELECT x, n, a, b, (x // b + {draw('(x % b)', 1, 'a')}) % a AS l, x % b AS r FROM (SELECT *, unnest(range(0, a * b)) AS x FROM {prefix}k)),
        {prefix}2 AS (SELECT x, n, a, b, l, (r + {draw('l', 2, 'b')}) % b AS r FROM {prefix}1),
        {prefix}3 AS (SELECT x, n, a, b, (l + {draw('r', 3, 'a')}) % a AS l, r FROM {prefix}2),
        {prefix}f AS (SELECT x, n, l * b + (r + {draw('l', 4, 'b')}) % b AS y FROM {prefix}3),
        {prefix}s AS (SELECT x, n, y, 0 AS step FROM {prefix}f WHERE x < n UNION ALL SELECT s.x, s.n, f.y, step + 1 FROM {prefix}s s JOIN {prefix}f f ON s.y = f.x WHERE s.y >= s.n),
        {prefix}w AS (SELECT x, CASE WHEN n = 1 THEN 0 ELSE y END AS y FROM {prefix}s WHERE y < n)"""


@query(f"""
    WITH RECURSIVE {_walked('permute', 'SELECT count(*) AS n FROM embeddings', 'p')},
    e AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS x FROM embeddings)
    SELECT vec_id, y // 16 AS batch_id, CAST(y % 16 AS INT) AS slot FROM e JOIN pw USING (x)""")
def permuted_batches(spark, d):
    """A shuffle that is arithmetic on places, not a sort."""
    e = table(spark, d, "embeddings").select("vec_id")
    placed = sharding.permuted_positions(sharding.positions(e, "vec_id"), e.count(), 42)
    return placed.select("vec_id", F.floor(F.col("pos") / 16).alias("batch_id"), (F.col("pos") % 16).cast("int").alias("slot"))


@query(f"""
    WITH RECURSIVE g AS (SELECT page_id, CAST(length(html) * 1.0 / (length(url) * 40) <= 1 AS INT) AS wide FROM pages),
    c AS (SELECT count(*) FILTER (wide = 1) AS a, count(*) FILTER (wide = 0) AS b FROM g),
    {_walked('wide', 'SELECT a AS n FROM c', 'wi')}, {_walked('other', 'SELECT b AS n FROM c', 'ot')}, {_walked('batches', 'SELECT (a + 15) // 16 + (b + 15) // 16 AS n FROM c', 'ba')},
    e AS (SELECT page_id, wide, row_number() OVER (PARTITION BY wide ORDER BY page_id) - 1 AS x FROM g),
    p AS (SELECT page_id, wide, wiw.y FROM e JOIN wiw USING (x) WHERE wide = 1 UNION ALL SELECT page_id, wide, otw.y FROM e JOIN otw USING (x) WHERE wide = 0)
    SELECT page_id, wide, baw.y AS batch_id, CAST(p.y % 16 AS INT) AS slot FROM p CROSS JOIN c JOIN baw ON baw.x = p.y // 16 + CASE WHEN wide = 1 THEN 0 ELSE (c.a + 15) // 16 END""")
def aspect_shuffled_batches(spark, d):
    """Samples shuffled within their kind of shape, and then whole batches."""
    p = table(spark, d, "pages").select("page_id", F.length("html").alias("h"), (F.length("url") * 40).alias("w"))
    placed, wide, other = sharding.aspect_places(p, F.col("w"), F.col("h"), "page_id")
    return sharding.aspect_epoch(placed, wide, other, 16, 42).select("page_id", "wide", "batch_id", "slot")


@query("""
    WITH n AS (SELECT count(*) AS n FROM embeddings),
    p AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings),
    s AS (SELECT *, CAST(floor(((pos + 1) * 4 - 1) / n) AS INT) AS shard FROM p, n),
    t AS (SELECT *, (pos - n * shard // 4) // 32 AS batch_id FROM s),
    z AS (SELECT *, list_transform(v, lambda x: (x - list_avg(v)) / sqrt(list_avg(list_transform(v, lambda y: (y - list_avg(v)) * (y - list_avg(v)))))) AS z FROM t)
    SELECT shard, batch_id, count(*) AS n_rows, CAST(count(toxic) AS BIGINT) AS n_labelled, round(avg(list_max(z)), 4) AS mean_peak, round(avg(z[1]), 4) AS mean_first
    FROM z LEFT JOIN labels ON vec_id = doc_id GROUP BY shard, batch_id""")
def batch_summary(spark, d):
    """End to end: scan, shard, batch, normalise, look labels up, summarise by batch."""
    e = vectors(spark, d, False)
    n = e.count()
    t = sharding.batches(sharding.assign_shards(sharding.positions(e.select("vec_id", "v"), "vec_id"), n, 4), 32)
    z = t.select("vec_id", "shard", "batch_id", T.normalize(F.col("v")).alias("z"))
    l = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), "toxic")
    return z.join(l, "vec_id", "left").groupBy("shard", "batch_id").agg(
        F.count("*").alias("n_rows"), F.count("toxic").alias("n_labelled"), F.round(F.avg(F.array_max("z")), 4).alias("mean_peak"), F.round(F.avg(F.get("z", F.lit(0))), 4).alias("mean_first")
    )


# --- labels ---


@query("SELECT doc_id, source, toxic, quality FROM documents JOIN labels USING (doc_id)")
def label_lookup(spark, d):
    """Labels of the labelled documents; a missing one would be an error."""
    l = table(spark, d, "labels")
    docs = labels.labelled_only(table(spark, d, "documents").select("doc_id", "source"), l, "doc_id")
    return labels.lookup(docs, l, "doc_id").select("doc_id", "source", "toxic", "quality")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def label_semi(spark, d):
    return labels.labelled_only(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def label_anti(spark, d):
    return labels.unlabelled(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels"), "doc_id")


@query("SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INT) AS label FROM part")
def folder_label_rank(spark, d):
    """A brand stands for a class folder."""
    return labels.folder_labels(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "p_brand", F.col("label").cast("int").alias("label"))


@query("SELECT c_mktsegment, arg_min(c_nationkey, c_custkey) AS c_nationkey FROM customer GROUP BY c_mktsegment")
def first_label_wins(spark, d):
    return labels.first_label(table(spark, d, "customer"), "c_mktsegment", "c_nationkey", "c_custkey")


@query(r"""
    SELECT page_id, string_split(url, '/')[-1] AS name,
        lower(regexp_extract(string_split(regexp_extract(url, '^[^?#]*'), '/')[-1], '\.([^.]+)$', 1)) AS extension FROM pages""")
def file_names(spark, d):
    """Names and extensions of URLs."""
    return table(spark, d, "pages").select("page_id", labels.basename(F.col("url")).alias("name"), labels.extension(F.col("url")).alias("extension"))


@query("SELECT page_id, length(string_split(url, '/')[-1]) AS name_len, CAST(page_id % 8 AS BIGINT) AS batch FROM pages")
def name_lengths(spark, d):
    """Lengths of sample names, as a batch reports them."""
    p = table(spark, d, "pages")
    return p.select("page_id", F.length(labels.basename(F.col("url"))).cast("long").alias("name_len"), (F.col("page_id") % 8).alias("batch"))


@query("SELECT n_nationkey, CAST(i AS INT) AS idx, CAST(i = (n_regionkey + 4) % 5 AS INT) AS value FROM nation, range(0, 5) r(i)")
def one_hot_region(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.posexplode(T.one_hot(F.col("n_regionkey"), 5)).alias("idx", "value"))


@query("SELECT label, count(*) AS n, max(list_max(embedding))::DOUBLE AS peak FROM embeddings GROUP BY label")
def max_shape(spark, d):
    """Extremes over the data set, as a pre-scan for the largest shape finds them."""
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.max(F.array_max("embedding")).cast("double").alias("peak"))


@query("SELECT p_size AS size, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, size LIMIT 1")
def most_frequent_size(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_size").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1)


# --- sequences ---


@query("""
    WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations),
    w AS (SELECT conv_id, turn, m, n - f * 2 AS start, f FROM c, range(0, 2) r(f))
    SELECT conv_id, turn, CAST(start AS INT) AS start, CAST(f AS INT) AS frame FROM w WHERE start >= 0 AND start + 2 < m""")
def sequence_windows(spark, d):
    """Windows of two turns with one between them."""
    c = table(spark, d, "conversations").select("conv_id", "turn")
    return sequences.sequences(c, "conv_id", ["turn"], 2, 1, 2).select("conv_id", "turn", "start", "frame")


@query("""
    WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
    SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY s) - 1 AS INT) AS sequence, s AS start FROM c, range(0, 100000, 3) r(s) WHERE s + 4 * 2 < n""")
def sequence_starts(spark, d):
    """Starts of windows of five events, two apart, one every three."""
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return sequences.sequence_starts(counts, "user_id", "n", 5, 3, 2)


@query("SELECT event_id, CAST(i AS INT) AS idx, round((event_id + i * 2) / 25.0, 6) AS value FROM events, range(0, 3) r(i)")
def frame_times(spark, d):
    return table(spark, d, "events").select("event_id", F.posexplode(sequences.frame_times(F.col("event_id"), 3, 2, 25)).alias("idx", "v")).select("event_id", "idx", F.round("v", 6).alias("value"))


@query("""
    WITH e AS (SELECT event_id, CAST(ceil(value * 30) AS INT) AS a, CAST(floor((value + event_id % 3 - 1) * 30) AS INT) AS b FROM events WHERE value IS NOT NULL)
    SELECT event_id, a AS first, b AS last FROM e WHERE a >= 0 AND a < b""")
def frame_ranges(spark, d):
    """Labelled stretches given in seconds, as frames; empty ones go."""
    e = table(spark, d, "events").where("value is not null")
    r = sequences.frame_range(F.col("value"), F.col("value") + F.col("event_id") % 3 - 1, F.lit(30), False)
    return e.select("event_id", r.alias("r")).where("r is not null").select("event_id", "r.first", "r.last")


@query("""
    WITH s AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT event_id, round(value - 0.97 * coalesce(before, value), 6) AS value FROM s""")
def preemphasis_events(spark, d):
    """The filter in long form: one row a sample, by window."""
    from pyspark.sql import Window

    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("event_id", F.round(F.col("value") - 0.97 * F.coalesce(before, F.col("value")), 6).alias("value"))


# --- random parameters and rejection sampling ---

_P = lambda k: _u("parameters", "vec_id", str(k))


@query(f"""
    SELECT vec_id, {_P(0)} * 1.8499999999999999::DOUBLE + 0.1::DOUBLE AS alpha, CAST(floor({_P(1)} * 199) - 99 AS INT) AS adjustment,
        round(sqrt(-2 * ln(1 - {_P(2)})) * cos(2 * pi() * {_P(3)}) * 2.0 + 1.0, 9) AS normal, CAST({_P(4)} < 0.3 AS INT) AS mirror,
        CASE WHEN {_P(5)} < 0.5 THEN 1 WHEN {_P(5)} < 0.8 THEN 2 ELSE 5 END AS choice
    FROM embeddings""")
def random_parameters(spark, d):
    """Uniform, integer, normal, coin and discrete draws for each sample."""
    e = table(spark, d, "embeddings").select("vec_id")
    u = lambda k: rng.uniform(42, "parameters", F.col("vec_id"), 0, k)
    return e.select(
        "vec_id", rng.uniform_range(u(0), 0.1, 1.95).alias("alpha"), rng.uniform_int(u(1), -99, 99).alias("adjustment"),
        F.round(rng.normal(u(2), u(3), 1.0, 2.0), 9).alias("normal"), rng.coin(u(4), 0.3).alias("mirror"), rng.discrete(u(5), [1, 2, 5], [0.5, 0.3, 0.2]).alias("choice"),
    )


_RANGES = ", ".join(f"('{effect}', '{name}', {float(a)!r}::DOUBLE, {float(b)!r}::DOUBLE, {isinstance(a, int)})" for effect, own in rng.RANGES.items() for name, (a, b) in own.items())


@query(f"""
    WITH r(effect, parameter, low, high, whole) AS (VALUES {_RANGES}),
    u AS (SELECT vec_id, r.*, ('0x' || substr(md5('42:' || effect || ' ' || parameter || ':0:' || vec_id || ':0'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM embeddings, r)
    SELECT vec_id, effect, parameter, round(CASE WHEN whole THEN floor(u * (high - low + 1)) + low ELSE u * (high - low) + low END, 9) AS value FROM u""")
def default_parameters(spark, d):
    """What each effect draws for each sample where nothing is given."""
    e = table(spark, d, "embeddings").select("vec_id")
    each = [F.struct(F.lit(effect).alias("effect"), F.lit(name).alias("parameter"), F.round(c.cast("double"), 9).alias("value")) for effect in rng.RANGES for name, c in rng.drawn(effect, 42, F.col("vec_id")).items()]
    return e.select("vec_id", F.explode(F.array(*each)).alias("p")).select("vec_id", "p.*")


@query(f"""
    WITH g AS (SELECT vec_id, v, i FROM (SELECT vec_id, {_PIXELS} AS v, unnest(range(0, 64)) AS i FROM embeddings))
    SELECT vec_id, CAST(i AS INT) AS idx, greatest(0.0, least(255.0, floor(v[i + 1] * ({_u('brightness alpha', 'vec_id')} * 1.8499999999999999::DOUBLE + 0.1::DOUBLE) + 5.0::DOUBLE + 0.5))) AS value FROM g""")
def brightness_drawn(spark, d):
    """A factor drawn for each sample, a given offset."""
    p = rng.drawn("brightness", 42, F.col("vec_id"), beta=5.0)
    return long_form(vectors(spark, d, True).select("vec_id", T.brightness(F.col("v"), p["alpha"], p["beta"]).alias("v")), F.col("v"), 4)


_C = lambda name: _u(f"crop{name}", "vec_id", "i")


@query(f"""
    WITH d AS (SELECT vec_id, i, ({_C('area')} * 0.91::DOUBLE + 0.08::DOUBLE) * 3072 AS target, {_C('aspect')} * 0.583::DOUBLE + 0.75::DOUBLE AS ratio, {_C('x')} AS ux, {_C('y')} AS uy FROM embeddings, range(0, 20) r(i)),
    w AS (SELECT *, CAST(floor(sqrt(target * ratio)) AS INT) AS w, CAST(floor(sqrt(target / ratio)) AS INT) AS h FROM d),
    f AS (SELECT vec_id, arg_min({{'x': CAST(floor(ux * (64 - w)) AS INT), 'y': CAST(floor(uy * (48 - h)) AS INT), 'w': w, 'h': h}}, i) AS c FROM w WHERE w BETWEEN 1 AND 63 AND h BETWEEN 1 AND 47 GROUP BY vec_id)
    SELECT vec_id, coalesce(c.x, 0) AS x, coalesce(c.y, 0) AS y, coalesce(c.w, 63) AS w, coalesce(c.h, 48) AS h FROM embeddings LEFT JOIN f USING (vec_id)""")
def random_crop_window(spark, d):
    e = table(spark, d, "embeddings").select("vec_id")
    return random_crops.random_windows(e, "vec_id", 64, 48, seed=42)


_B = lambda name: _u(f"box{name}", "vec_id", "i")


@query(f"""
    WITH {_BOXED},
    o AS (SELECT vec_id, CAST(floor({_u('option', 'vec_id')} * 7) AS INT) AS option FROM embeddings),
    s AS (SELECT vec_id, i, {_B('w')} * 70 + 30 AS w, {_B('h')} * 70 + 30 AS h, {_B('x')} AS ux, {_B('y')} AS uy FROM embeddings, range(0, 20) r(i)),
    c AS (SELECT vec_id, i, ux * (100 - w) AS cl, uy * (100 - h) AS ct, ux * (100 - w) + w AS cr, uy * (100 - h) + h AS cb FROM s),
    m AS (SELECT c.*, greatest(0, least(r, cr) - greatest(l, cl)) * greatest(0, least(b, cb) - greatest(t, ct)) AS inter, (r - l) * (b - t) + (cr - cl) * (cb - ct) AS area,
        (l + r) / 2 > cl AND (l + r) / 2 < cr AND (t + b) / 2 > ct AND (t + b) / 2 < cb AS inside FROM c JOIN bx USING (vec_id)),
    k AS (SELECT vec_id, i, cl, ct, cr, cb, max(inter / (area - inter)) AS best, bool_or(inside) AS inside FROM m GROUP BY ALL),
    f AS (SELECT vec_id, arg_min({{'l': cl, 't': ct, 'r': cr, 'b': cb}}, i) AS c FROM k JOIN o USING (vec_id)
        WHERE inside AND (cr - cl) / (cb - ct) BETWEEN 0.5 AND 2 AND best >= CASE WHEN option = 5 THEN -1 ELSE [0.1, 0.3, 0.5, 0.7, 0.9][option + 1] END AND option < 6 GROUP BY vec_id)
    SELECT vec_id, round(coalesce(c.l, 0), 6) AS l, round(coalesce(c.t, 0), 6) AS t, round(coalesce(c.r, 100), 6) AS r, round(coalesce(c.b, 100), 6) AS b FROM embeddings LEFT JOIN f USING (vec_id)""")
def random_bbox_crop(spark, d):
    found = random_crops.bbox_crop_windows(boxed(spark, d), "vec_id", 100, 100, seed=42)
    return found.select("vec_id", *(F.round(c, 6).alias(c) for c in "ltrb"))


def _gathered(sy: str, sx: str, inside: str = "TRUE", before: str = "") -> str:
    """Bilinear values of 8 x 8 pixels at source places given in terms of x and y; 0 outside."""
    return f"""
        WITH g AS (SELECT vec_id, v, i, i // 8 AS y, i % 8 AS x FROM (SELECT vec_id, {_PIXELS} AS v, unnest(range(0, 64)) AS i FROM embeddings)),
        q AS (SELECT * {before} FROM g),
        s AS (SELECT vec_id, v, i, {sy} AS sy, {sx} AS sx, {inside} AS inside FROM q),
        c AS (SELECT *, inside AND sy BETWEEN -0.5 AND 7.5 AND sx BETWEEN -0.5 AND 7.5 AS hit, greatest(0.0, least(7.0, sy)) AS yc, greatest(0.0, least(7.0, sx)) AS xc FROM s),
        f AS (SELECT *, CAST(floor(yc) AS BIGINT) AS y0, CAST(floor(xc) AS BIGINT) AS x0, yc - floor(yc) AS fy, xc - floor(xc) AS fx FROM c)
        SELECT vec_id, CAST(i AS INT) AS idx, round(CASE WHEN hit THEN
            (v[y0 * 8 + x0 + 1] * (1 - fx) + v[y0 * 8 + least(7, x0 + 1) + 1] * fx) * (1 - fy)
            + (v[least(7, y0 + 1) * 8 + x0 + 1] * (1 - fx) + v[least(7, y0 + 1) * 8 + least(7, x0 + 1) + 1] * fx) * fy ELSE 0 END, 4) + 0.0::DOUBLE AS value FROM f"""


def _effect(name: str, chain: list, digits: int = 4, sql: str | None = None) -> None:
    if sql:
        ORACLES[name] = sql

    def run(spark, d):
        out = augment.apply(vectors(spark, d, True).select("vec_id", "v"), "vec_id", "v", (8, 8, 1), chain, seed=42)
        return long_form(out, F.col("v"), digits)

    run.__name__ = name
    QUERIES[name] = run


_effect("rotate_image", [("rotate", {"degrees": 30.0})], sql=_gathered("-sin(pi() / 6) * (x - 3.5) + cos(pi() / 6) * (y - 3.5) + 3.5", "cos(pi() / 6) * (x - 3.5) + sin(pi() / 6) * (y - 3.5) + 3.5"))
_effect("warp_affine", [("warp_affine", {"matrix": (0.9, 0.1, -0.1, 0.9, 0.5, -0.5)})], sql=_gathered("-0.1 * (x - 3.5) + 0.9 * (y - 3.5) - 0.5 + 3.5", "0.9 * (x - 3.5) + 0.1 * (y - 3.5) + 0.5 + 3.5"))
_R = "sqrt(pow(2 * x / 7.0 - 1, 2) + pow(2 * y / 7.0 - 1, 2))"
_effect("fish_eye", [("fish_eye", {})], sql=_gathered("((2 * y / 7.0 - 1) * k + 1) / 2 * 7", "((2 * x / 7.0 - 1) * k + 1) / 2 * 7", "r <= 1", f", {_R} AS r, CASE WHEN {_R} > 0 THEN ({_R} + 1 - sqrt(greatest(0, 1 - {_R} * {_R}))) / 2 / {_R} ELSE 1 END AS k"))
_RADIAL = "(1 - 0.1 * r2 + 0.01 * r2 * r2)"
_effect("lens_correction", [("lens_correction", {"k1": -0.1, "k2": 0.01})], sql=_gathered(f"(y - 3.5) * {_RADIAL} + 3.5", f"(x - 3.5) * {_RADIAL} + 3.5", before=", (pow(x - 3.5, 2) + pow(y - 3.5, 2)) / 64.0 AS r2"))


def _drawn(name: str, out: Callable, value: str) -> None:
    """An effect with draws by pixel; ``value`` in SQL over v, i, y, x and u(name, place)."""
    QUERIES[name] = lambda spark, d: long_form(vectors(spark, d, True).select("vec_id", out().alias("v")), F.col("v"), 4)
    ORACLES[name] = f"""
        WITH g AS (SELECT vec_id, v, i, i // 8 AS y, i % 8 AS x FROM (SELECT vec_id, {_PIXELS} AS v, unnest(range(0, 64)) AS i FROM embeddings))
        SELECT vec_id, CAST(i AS INT) AS idx, round(CAST({value} AS DOUBLE), 4) + 0.0::DOUBLE AS value FROM g"""


_KEYED = lambda: (F.col("v"), 8, 8, F.col("vec_id"))
_drawn("salt_and_pepper", lambda: effects.salt_and_pepper(*_KEYED(), 0.2, 0.6, seed=42), f"CASE WHEN {_u('salt', 'vec_id', 'i')} < 0.2::DOUBLE * 0.6::DOUBLE THEN 255 WHEN {_u('salt', 'vec_id', 'i')} < 0.2 THEN 0 ELSE v[i + 1] END")
_drawn("snow", lambda: effects.snow(*_KEYED(), 0.3, seed=42), f"CASE WHEN {_u('snow', 'vec_id', 'i')} < 0.03 THEN 255 WHEN v[i + 1] >= 178.5 THEN least(255, v[i + 1] * 1.3) ELSE v[i + 1] END")
_JIT = lambda axis, n: f"greatest(0, least(7, {axis} + CAST(floor({_u('jitter ' + axis, 'vec_id', 'i')} * 3) AS BIGINT) - 1))"
_drawn("jitter", lambda: effects.jitter(*_KEYED(), 3, seed=42), f"v[{_JIT('y', 8)} * 8 + {_JIT('x', 8)} + 1]")
_drawn("rain", lambda: effects.rain(*_KEYED(), 0.2, 3, 1, seed=42), f"CASE WHEN len(list_filter([0, 1, 2], lambda k: y >= k AND x >= k AND {_u('rain', 'vec_id', '(i - 9 * k)')} < 0.2::DOUBLE / 3)) > 0 THEN v[i + 1] * 0.5 + 100 ELSE v[i + 1] END")


@query(f"""
    WITH d AS (SELECT vec_id, i, ({_u('croparea', 'vec_id', 'i')} * 0.91::DOUBLE + 0.08::DOUBLE) * 64 AS target, {_u('cropaspect', 'vec_id', 'i')} * 0.583::DOUBLE + 0.75::DOUBLE AS ratio, {_u('cropx', 'vec_id', 'i')} AS ux, {_u('cropy', 'vec_id', 'i')} AS uy FROM embeddings, range(0, 20) r(i)),
    w AS (SELECT *, CAST(floor(sqrt(target * ratio)) AS INT) AS w, CAST(floor(sqrt(target / ratio)) AS INT) AS h FROM d),
    f AS (SELECT vec_id, arg_min({{'x': CAST(floor(ux * (8 - w)) AS INT), 'y': CAST(floor(uy * (8 - h)) AS INT), 'w': w, 'h': h}}, i) AS c FROM w WHERE w BETWEEN 1 AND 7 AND h BETWEEN 1 AND 7 GROUP BY vec_id),
    g AS (SELECT vec_id, {_PIXELS} AS v, coalesce(c.x, 0) AS cx, coalesce(c.y, 0) AS cy, coalesce(c.w, 8) AS cw, coalesce(c.h, 8) AS ch, unnest(range(0, 36)) AS i FROM embeddings LEFT JOIN f USING (vec_id)),
    s AS (SELECT *, greatest(0.0, least(ch - 1.0, (i // 6 + 0.5) * (ch / 6.0::DOUBLE) - 0.5)) AS fy, greatest(0.0, least(cw - 1.0, (i % 6 + 0.5) * (cw / 6.0::DOUBLE) - 0.5)) AS fx FROM g),
    p AS (SELECT *, CAST(floor(fy) AS BIGINT) AS y0, CAST(floor(fx) AS BIGINT) AS x0, fy - floor(fy) AS dy, fx - floor(fx) AS dx FROM s)
    SELECT vec_id, CAST(i AS INT) AS idx, round(
        (v[(cy + y0) * 8 + cx + x0 + 1] * (1 - dx) + v[(cy + y0) * 8 + cx + least(cw - 1, x0 + 1) + 1] * dx) * (1 - dy)
        + (v[(cy + least(ch - 1, y0 + 1)) * 8 + cx + x0 + 1] * (1 - dx) + v[(cy + least(ch - 1, y0 + 1)) * 8 + cx + least(cw - 1, x0 + 1) + 1] * dx) * dy, 4) + 0.0::DOUBLE AS value FROM p""")
def random_crop_resize(spark, d):
    """A random window of each picture, as 6 x 6 pixels."""
    out = effects.random_crop_resize(F.col("v"), 8, 8, 6, 6, F.col("vec_id"), seed=42)
    return long_form(vectors(spark, d, True).select("vec_id", out.alias("v")), F.col("v"), 4)


_S = lambda name: _u(f"ssd {name}", "vec_id", "i")


@query(f"""
    WITH {_BOXED},
    o AS (SELECT vec_id, CAST(floor({_u('ssd option', 'vec_id')} * 7) AS INT) AS option FROM embeddings),
    s AS (SELECT vec_id, i, {_S('w')} * 70 + 30 AS w, {_S('h')} * 70 + 30 AS h, {_S('x')} AS ux, {_S('y')} AS uy FROM embeddings, range(0, 20) r(i)),
    c AS (SELECT vec_id, i, ux * (100 - w) AS cl, uy * (100 - h) AS ct, ux * (100 - w) + w AS cr, uy * (100 - h) + h AS cb FROM s),
    u AS (SELECT c.*, greatest(0, least(r, cr) - greatest(l, cl)) * greatest(0, least(b, cb) - greatest(t, ct)) AS inter, (r - l) * (b - t) + (cr - cl) * (cb - ct) AS area,
        (l + r) / 2 BETWEEN cl AND cr AND (t + b) / 2 BETWEEN ct AND cb AS inside FROM c JOIN bx USING (vec_id)),
    f AS (SELECT vec_id, arg_min({{'l': cl, 't': ct, 'r': cr, 'b': cb}}, i) AS c FROM u JOIN o USING (vec_id)
        WHERE inside AND option < 6 AND (cr - cl) / (cb - ct) BETWEEN 0.5 AND 2 AND inter / (area - inter) >= [0, 0.1, 0.3, 0.5, 0.7, 0.9][option + 1] GROUP BY vec_id),
    w AS (SELECT vec_id, coalesce(c.l, 0) AS wl, coalesce(c.t, 0) AS wt, coalesce(c.r, 100) AS wr, coalesce(c.b, 100) AS wb, CASE WHEN c IS NULL THEN 0 ELSE [0, 0.1, 0.3, 0.5, 0.7, 0.9, 0][option + 1] END AS low FROM o LEFT JOIN f USING (vec_id)),
    k AS (SELECT w.*, box_id, label, greatest(l, wl) AS il, greatest(t, wt) AS it, least(r, wr) AS ir, least(b, wb) AS ib, l, t, r, b FROM w JOIN bx USING (vec_id) WHERE (l + r) / 2 BETWEEN wl AND wr AND (t + b) / 2 BETWEEN wt AND wb),
    m AS (SELECT *, greatest(0, ir - il) * greatest(0, ib - it) AS inter FROM k),
    n AS (SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY box_id) - 1 AS INT) AS idx, CAST(label AS INT) AS label, (il - wl) / (wr - wl) AS l, (it - wt) / (wb - wt) AS t, (ir - wl) / (wr - wl) AS r, (ib - wt) / (wb - wt) AS b
        FROM m WHERE inter / ((r - l) * (b - t) + (wr - wl) * (wb - wt) - inter) BETWEEN low AND 1),
    z AS (SELECT * FROM n UNION ALL SELECT vec_id, 0, 0, 0, 0, 1, 1 FROM w WHERE vec_id NOT IN (SELECT vec_id FROM n))
    SELECT vec_id, idx, label, round(wl, 6) AS window_l, round(wt, 6) AS window_t, round(l, 4) AS l, round(t, 4) AS t, round(r, 4) AS r, round(b, 4) AS b FROM z JOIN w USING (vec_id)""")
def ssd_random_crop(spark, d):
    """Windows with retries, and the boxes they keep."""
    found = random_crops.ssd_crops(boxed(spark, d), "vec_id", 100, 100, seed=42)
    each = found.select("vec_id", "window", F.posexplode(F.arrays_zip("boxes", "labels")).alias("idx", "o"))
    return each.select("vec_id", "idx", F.col("o.labels").cast("int").alias("label"), F.round("window.l", 6).alias("window_l"), F.round("window.t", 6).alias("window_t"), *(F.round(f"o.boxes.{c}", 4).alias(c) for c in "ltrb"))


_CHAIN = f"""
    WITH e AS (SELECT vec_id, {_PIXELS} AS v FROM embeddings),
    a AS (SELECT vec_id, v, unnest(range(0, 36)) AS i FROM e),
    b AS (SELECT *, greatest(0.0, least(7.0, (i // 6 + 0.5::DOUBLE) * (8 / 6.0::DOUBLE) - 0.5)) AS yc, greatest(0.0, least(7.0, (i % 6 + 0.5::DOUBLE) * (8 / 6.0::DOUBLE) - 0.5)) AS xc FROM a),
    c AS (SELECT *, CAST(floor(yc) AS BIGINT) AS y0, CAST(floor(xc) AS BIGINT) AS x0, yc - floor(yc) AS fy, xc - floor(xc) AS fx FROM b),
    d AS (SELECT vec_id, list((v[y0 * 8 + x0 + 1] * (1 - fx) + v[y0 * 8 + least(7, x0 + 1) + 1] * fx) * (1 - fy) + (v[least(7, y0 + 1) * 8 + x0 + 1] * (1 - fx) + v[least(7, y0 + 1) * 8 + least(7, x0 + 1) + 1] * fx) * fy ORDER BY i) AS v FROM c GROUP BY vec_id),
    g AS (SELECT vec_id, v, i, i // 6 - 2.5 AS y, i % 6 - 2.5 AS x FROM (SELECT vec_id, v, unnest(range(0, 36)) AS i FROM d)),
    s AS (SELECT *, -sin(pi() / 12) * x + cos(pi() / 12) * y + 2.5 AS sy, cos(pi() / 12) * x + sin(pi() / 12) * y + 2.5 AS sx FROM g),
    t AS (SELECT *, sy BETWEEN -0.5 AND 5.5 AND sx BETWEEN -0.5 AND 5.5 AS hit, greatest(0.0, least(5.0, sy)) AS ry, greatest(0.0, least(5.0, sx)) AS rx FROM s),
    f AS (SELECT *, CAST(floor(ry) AS BIGINT) AS y0, CAST(floor(rx) AS BIGINT) AS x0, ry - floor(ry) AS fy, rx - floor(rx) AS fx FROM t),
    o AS (SELECT vec_id, i, CASE WHEN hit THEN (v[y0 * 6 + x0 + 1] * (1 - fx) + v[y0 * 6 + least(5, x0 + 1) + 1] * fx) * (1 - fy)
        + (v[least(5, y0 + 1) * 6 + x0 + 1] * (1 - fx) + v[least(5, y0 + 1) * 6 + least(5, x0 + 1) + 1] * fx) * fy ELSE 0 END AS x FROM f)
    SELECT vec_id, CAST(i AS INT) AS idx, round(CASE WHEN {_u('snow', 'vec_id', 'i').replace('42', '44')} < 0.2::DOUBLE * 0.1::DOUBLE THEN 255 WHEN x >= 255 * (1 - 0.2::DOUBLE) THEN least(255.0, x * (1 + 0.2::DOUBLE)) ELSE x END, 4) + 0.0::DOUBLE AS value FROM o"""
_effect("fused_chain", [("resize", {"height": 6, "width": 6}), ("rotate", {"degrees": 15.0}), ("snow", {"amount": 0.2})], sql=_CHAIN)


def _colours(spark, d):
    """All 64 values as a 2 x 11 image of three channels, whose last pixel is filled up with the first two."""
    e = vectors(spark, d, True)
    return e.select("vec_id", F.concat("v", F.slice("v", 1, 2)).alias("v"))


def _hsv(value: str, saturated: str, degrees: float, last: str = "c", order: str = "i // 3") -> str:
    """Pixels of three channels through hue and saturation; ``value`` changes a channel x before."""
    n = "(n_ + h_ / 60) % 6"
    return f"""
        WITH e AS (SELECT vec_id, {_PIXELS} AS v FROM embeddings),
        w AS (SELECT vec_id, list_transform(list_concat(v, v[1:2]), lambda x: {value}) AS v FROM e),
        p AS (SELECT vec_id, k, v[3 * k + 1] / 255 AS r, v[3 * k + 2] / 255 AS g, v[3 * k + 3] / 255 AS b FROM (SELECT vec_id, v, unnest(range(0, 22)) AS k FROM w)),
        m AS (SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS span FROM p),
        h AS (SELECT vec_id, k, top, CASE WHEN top > 0 THEN span / top ELSE 0 END AS s,
            CASE WHEN span = 0 THEN 0 WHEN top = r THEN ((g - b) / span + 6) % 6 WHEN top = g THEN (b - r) / span + 2 ELSE (r - g) / span + 4 END * 60 AS h FROM m),
        t AS (SELECT vec_id, k, top, {saturated} AS s_, (h + {degrees}) % 360 AS h_ FROM h),
        c AS (SELECT vec_id, k, ch, n_, top, s_, h_ FROM t, (VALUES (0, 5), (1, 3), (2, 1)) q(ch, n_)),
        o AS (SELECT vec_id, k, ch, (top - top * s_ * greatest(0, least(1, {n}, 4 - {n}))) * 255 AS c FROM c)
        SELECT vec_id, CAST(({order}) * 3 + ch AS INT) AS idx, round({last}, 4) + 0.0::DOUBLE AS value FROM o"""


@query(_hsv("greatest(0, least(255, x * 1.1 + 4))", "greatest(0, least(1, s * 0.8))", 30, "(c - [120, 110, 100][ch + 1]) / [60, 50, 40][ch + 1]", "k // 11 * 11 + 10 - k % 11"))
def color_twist_hsv(spark, d):
    """64 values as a 2 x 11 image of three channels: brightness, hue and saturation, then mirrored and normalised by channel."""
    chain = [("color_twist", {"alpha": 1.1, "beta": 4.0, "degrees": 30.0, "factor": 0.8}), ("mirror", {}), ("normalize", {"mean": (120.0, 110.0, 100.0), "std": (60.0, 50.0, 40.0)})]
    return long_form(augment.apply(_colours(spark, d), "vec_id", "v", (2, 11, 3), chain, seed=42), F.col("v"), 4)


@query(_hsv("x", "greatest(0, least(1, s * 1.3))", 40, order="k"))
def hue_saturation(spark, d):
    """64 values as a 2 x 11 image of three channels."""
    return long_form(augment.apply(_colours(spark, d), "vec_id", "v", (2, 11, 3), [("hue", {"degrees": 40.0}), ("saturation", {"factor": 1.3})], seed=42), F.col("v"), 4)


@query("""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    k AS (SELECT vec_id, v, unnest(range(0, 17)) AS k FROM e)
    SELECT vec_id, CAST(k AS INT) AS idx, round(
        pow(list_sum(list_transform(range(0, 32), lambda t: v[t + 1] * (0.5 - 0.5 * cos(2 * pi() * t / 32)) * cos(2 * pi() * t * k / 32))), 2)
        + pow(list_sum(list_transform(range(0, 32), lambda t: v[t + 1] * (0.5 - 0.5 * cos(2 * pi() * t / 32)) * sin(2 * pi() * t * k / 32))), 2), 5) AS value
    FROM k""")
def spectrogram_fft(spark, d):
    """First frame of the FFT spectrogram; ``spectrogram_fft_frames`` returns all."""
    return long_form(_fft(spark, d).select("vec_id", F.slice("v", 1, 17).alias("v")), F.col("v"), 5)


def _fft(spark, d):
    return spectral.spectrogram(vectors(spark, d, False).select("vec_id", "v"), "vec_id", "v", nfft=32, window=32, step=16, center=False)


@query("""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    k AS (SELECT vec_id, v, i, i // 17 * 16 AS f, i % 17 AS k FROM (SELECT vec_id, v, unnest(range(0, 51)) AS i FROM e))
    SELECT vec_id, CAST(i AS INT) AS idx, round(
        pow(list_sum(list_transform(range(0, 32), lambda t: v[f + t + 1] * (0.5 - 0.5 * cos(2 * pi() * t / 32)) * cos(2 * pi() * t * k / 32))), 2)
        + pow(list_sum(list_transform(range(0, 32), lambda t: v[f + t + 1] * (0.5 - 0.5 * cos(2 * pi() * t / 32)) * sin(2 * pi() * t * k / 32))), 2), 5) AS value
    FROM k""")
def spectrogram_fft_frames(spark, d):
    """All three frames of the FFT spectrogram, 17 bins each."""
    return long_form(_fft(spark, d), F.col("v"), 5)


_LOBES = 3 + math.ceil((0.007 * 50 - 0.09) * 50)


@query(f"""
    WITH e AS (SELECT vec_id, {_DOUBLES} AS v FROM embeddings),
    o AS (SELECT vec_id, v, i, i * (16000 / 22050.0::DOUBLE) AS p FROM (SELECT vec_id, v, unnest(range(0, 89)) AS i FROM e)),
    k AS (SELECT vec_id, i, v[j + 1] AS x, p - j AS d FROM (SELECT *, unnest(range(greatest(0, CAST(floor(p) AS BIGINT) - {_LOBES} + 1), least(64, CAST(floor(p) AS BIGINT) + {_LOBES} + 1))) AS j FROM o))
    SELECT vec_id, CAST(i AS INT) AS idx, round(sum(CASE WHEN abs(d) >= {_LOBES} THEN 0 WHEN d = 0 THEN x ELSE x * sin(pi() * d) / (pi() * d) * (0.5 + 0.5 * cos(pi() * d / {_LOBES})) END), 5) + 0.0::DOUBLE AS value
    FROM k GROUP BY vec_id, i""")
def resample_sinc(spark, d):
    out = spectral.resample(vectors(spark, d, False).select("vec_id", "v"), "vec_id", "v", rate_in=16000, rate_out=22050)
    return long_form(out, F.col("v"), 5)


@query(f"""
    WITH e AS (SELECT vec_id, 22050 + label * 1000 AS rate, {_DOUBLES} AS v FROM embeddings),
    o AS (SELECT vec_id, v, i, i * (16000.0::DOUBLE / rate) AS p FROM (SELECT vec_id, v, rate, unnest(range(0, CAST(ceil(64 / (16000.0::DOUBLE / rate)) AS BIGINT))) AS i FROM e)),
    k AS (SELECT vec_id, i, v[j + 1] AS x, p - j AS d FROM (SELECT *, unnest(range(greatest(0, CAST(floor(p) AS BIGINT) - {_LOBES} + 1), least(64, CAST(floor(p) AS BIGINT) + {_LOBES} + 1))) AS j FROM o))
    SELECT vec_id, CAST(i AS INT) AS idx, round(sum(CASE WHEN abs(d) >= {_LOBES} THEN 0 WHEN d = 0 THEN x ELSE x * sin(pi() * d) / (pi() * d) * (0.5 + 0.5 * cos(pi() * d / {_LOBES})) END), 5) + 0.0::DOUBLE AS value
    FROM k GROUP BY vec_id, i""")
def resample_by_sample(spark, d):
    """Each signal to a rate of its own."""
    e = vectors(spark, d, False).select("vec_id", "v", (22050 + F.col("label") * 1000).alias("rate"))
    return long_form(spectral.resample(e, "vec_id", "v", 16000, F.col("rate")), F.col("v"), 5)
