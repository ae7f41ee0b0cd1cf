"""Readers and writers of file formats: each query writes the vectors in a format and reads the files back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import batches
from tilewright.plans.vectors import _BOXED, _DOUBLES, _PIXELS, boxed, vectors
from tilewright.sources import coco, files, headers, records, sinks, splits
from tilewright.storage import new_path
from tilewright.streaming import batching, external

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Pictures in one annotation file.
COCO_FILE = 1000


def query(oracle: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return register


def stored(df: DataFrame, form: str, name: str, **options: str) -> str:
    """The path of a folder of files of a format."""
    records.register(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.format(form).options(**options).mode("append").save(path)
    return path


def samples(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, name, p, raw, text): 64 pixels, as bytes and as text."""
    e = vectors(spark, d, True).select("vec_id", F.col("label").cast("int").alias("label"), F.transform("v", lambda x: x.cast("int")).alias("p"))
    return e.select(
        "*", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), sinks.unsigned_bytes(F.col("p")).alias("raw"), F.array_join("p", ",").cast("binary").alias("text")
    )


_SAMPLES = f"""
    s AS (SELECT vec_id, CAST(label AS INT) AS label, 'v' || vec_id AS name, list_transform({_PIXELS}, lambda x: CAST(x AS INT)) AS p FROM embeddings),
    x AS (SELECT *, array_to_string(p, ',') AS text FROM s)"""


def _digest(content: Column) -> Column:
    return F.sha2(content, 256).alias("digest")


def _id(name: Column, prefix: str = "v") -> Column:
    return F.regexp_extract(name, rf"{prefix}(\d+)", 1).cast("long").alias("vec_id")


# --- records ---


@query(f"WITH {_SAMPLES} SELECT name, label, sha256(text) AS digest FROM x")
def read_tfrecord(spark, d):
    """Encoded samples, their labels and names."""
    s = samples(spark, d).select(
        F.create_map(F.lit("image/encoded"), F.array("text"), F.lit("image/filename"), F.array(F.col("name").cast("binary"))).alias("bytes"),
        F.create_map(F.lit("image/class/label"), F.array(F.col("label").cast("long"))).alias("ints"),
    )
    back = spark.read.format("tfrecord").load(stored(s, "tfrecord", "tfrecord"))
    return records.tf_classification(back).select("name", "label", _digest(F.col("content")))


@query(f"WITH {_SAMPLES} SELECT name, label, CAST(i AS INT) AS idx, p[i + 1] AS value FROM (SELECT *, unnest(range(0, 64)) AS i FROM x)")
def read_tfrecord_raw(spark, d):
    """Samples stored as raw pixels under names of the user's own."""
    s = samples(spark, d).select(
        F.create_map(F.lit("pixels"), F.array("raw"), F.lit("id"), F.array(F.col("name").cast("binary"))).alias("bytes"), F.create_map(F.lit("class"), F.array(F.col("label").cast("long"))).alias("ints")
    )
    back = spark.read.format("tfrecord").load(stored(s, "tfrecord", "tfrecord"))
    return records.tf_classification(back, "pixels", "class", "id").select("name", "label", F.posexplode(files.raw_values(F.col("content"))).alias("idx", "value"))


@query("""
    WITH b AS (SELECT vec_id, unnest([0, 1]) AS k, (label % 4) / 8.0 AS x, (vec_id % 4) / 8.0 AS y FROM embeddings)
    SELECT vec_id, CAST(k AS INT) AS idx, (x + k * 0.25) * 640 AS l, (y + k * 0.25) * 480 AS t, (x + 0.5) * 640 AS r, (y + 0.5) * 480 AS b FROM b""")
def read_tfrecord_detection(spark, d):
    """Two boxes a sample, relative to its size; the class numbers hold the id."""
    e = vectors(spark, d, True).select("vec_id", ((F.col("label") % 4) / 8).alias("x"), ((F.col("vec_id") % 4) / 8).alias("y"))
    edge = lambda name, *values: (F.lit(f"image/object/bbox/{name}"), F.array(*(v.cast("float") for v in values)))
    number = lambda name, *values: (F.lit(name), F.array(*(v.cast("long") for v in values)))
    s = e.select(
        F.create_map(*edge("xmin", F.col("x"), F.col("x") + 0.25), *edge("ymin", F.col("y"), F.col("y") + 0.25), *edge("xmax", F.col("x") + 0.5, F.col("x") + 0.5), *edge("ymax", F.col("y") + 0.5, F.col("y") + 0.5)).alias("floats"),
        F.create_map(*number("image/width", F.lit(640)), *number("image/height", F.lit(480)), *number("image/object/class/label", F.col("vec_id"), F.col("vec_id"))).alias("ints"),
    )
    found = records.tf_detection(spark.read.format("tfrecord").load(stored(s, "tfrecord", "tfrecord")))
    return found.select(F.posexplode(F.arrays_zip("boxes", "labels")).alias("idx", "o")).select(F.col("o.labels").cast("long").alias("vec_id"), "idx", "o.boxes.*")


# --- splits and shards ---

#: Records of the shard between the two given by its number and the number of shards, in the order of vec_id.
_SHARD = "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS k, count(*) OVER () AS n FROM x) WHERE k >= n * {0} // {1} AND k < n * ({0} + 1) // {1}"
#: Bytes of a split: small, so that the files of small tables are split too.
_SPLIT = 8192


def _in_order(df: DataFrame) -> DataFrame:
    """Files, whose order is that of vec_id; adaptive execution makes as many as the rows are worth."""
    return df.repartitionByRange("vec_id").sortWithinPartitions("vec_id")


def _examples(df: DataFrame) -> DataFrame:
    return df.select(
        F.create_map(F.lit("image/encoded"), F.array("text"), F.lit("image/filename"), F.array(F.col("name").cast("binary"))).alias("bytes"),
        F.create_map(F.lit("image/class/label"), F.array(F.col("label").cast("long"))).alias("ints"),
    )


@query(f"WITH {_SAMPLES} SELECT name, label, sha256(text) AS digest FROM x")
def read_tfrecord_splits(spark, d):
    """Every record once, from files that are split at any byte."""
    path = stored(_examples(_in_order(samples(spark, d))), "tfrecord", "tfrecord")
    return records.tf_classification(splits.read(spark, "tfrecord", path, split_bytes=_SPLIT)).select("name", "label", _digest(F.col("content")))


@query(f"WITH {_SAMPLES} SELECT name, label, sha256(text) AS digest FROM ({_SHARD.format(1, 3)})")
def read_tfrecord_shard(spark, d):
    """Shard 1 of 3: only its own splits are planned."""
    path = stored(_examples(_in_order(samples(spark, d))), "tfrecord", "tfrecord")
    return records.tf_classification(splits.read(spark, "tfrecord", path, 1, 3, split_bytes=_SPLIT)).select("name", "label", _digest(F.col("content")))


@query(f"WITH {_SAMPLES} SELECT name, label, sha256(text) AS digest FROM ({_SHARD.format(2, 5)})")
def read_recordio_shard(spark, d):
    s = _in_order(samples(spark, d)).select("label", F.col("vec_id").alias("image_id"), F.col("text").alias("content"))
    back = splits.read(spark, "recordio", stored(s, "recordio", "recordio"), 2, 5, split_bytes=_SPLIT)
    return back.select(F.concat(F.lit("v"), "name").alias("name"), "label", _digest(F.col("content")))


@query(f"WITH {_SAMPLES} SELECT 'd/' || name AS key, sha256(text) AS digest, CASE WHEN vec_id % 3 > 0 THEN CAST(label AS VARCHAR) END AS label FROM ({_SHARD.format(0, 2)})")
def read_webdataset_shard(spark, d):
    """Shard 0 of 2 of tars with an index: splits begin within a tar and keep samples whole."""
    s = _in_order(samples(spark, d))
    label = F.when(F.col("vec_id") % 3 > 0, F.create_map(F.lit("cls"), F.col("label").cast("string").cast("binary")))
    parts = F.map_concat(F.create_map(F.lit("txt"), F.col("text")), F.coalesce(label, F.expr("cast(map() as map<string,binary>)")))
    path = stored(s.select(F.concat(F.lit("d/"), "name").alias("key"), parts.alias("components")), "webdataset", "web")
    splits.write_tar_indexes(spark, path)
    back = splits.read(spark, "webdataset", path, 0, 2, split_bytes=_SPLIT)
    return back.select("key", _digest(F.element_at("components", "txt")), F.element_at("components", "cls").cast("string").alias("label"))


@query(f"WITH {_SAMPLES} SELECT 'c' || label || '/' || lpad(CAST(vec_id AS VARCHAR), 12, '0') || '.txt' AS path, sha256(text) AS digest FROM (SELECT *, row_number() OVER (ORDER BY label, vec_id) - 1 AS k, count(*) OVER () AS n FROM x) WHERE k >= n * 3 // 4")
def read_files_shard(spark, d):
    """The last of four shards of a tree of class folders: other files are listed and not opened."""
    s = samples(spark, d).select(F.format_string("c%d/%012d.txt", "label", "vec_id").alias("path"), F.col("text").alias("content"))
    return splits.read(spark, "files", stored(s, "files", "tree"), 3, 4).select("path", _digest(F.col("content")))


@query(f"WITH {_SAMPLES} SELECT trim(text) AS text, sha256(lpad(text, 400, ' ')) AS digest FROM ({_SHARD.format(1, 4)})")
def read_fixed_shard(spark, d):
    """Shard 1 of 4 of records of 400 bytes, whose places follow from their numbers."""
    rows = _in_order(samples(spark, d)).select(F.lpad(F.col("text").cast("string"), 400, " ").cast("binary").alias("content"))
    back = splits.read(spark, "fixed", stored(rows, "fixed", "fixed"), 1, 4, record_bytes=400)
    return back.select(F.trim(F.col("content").cast("string")).alias("text"), _digest(F.col("content")))


@query(f"WITH {_SAMPLES} SELECT name, sha256(text) AS digest FROM x WHERE name BETWEEN 'v1' AND 'v200'")
def read_lmdb_range(spark, d):
    """Keys between two: pages outside are not read."""
    s = samples(spark, d).select("name", F.col("text").alias("value"))
    return records.lmdb(spark, stored(s, "lmdb", "lmdb"), low="v1", high="v200").select("name", _digest(F.col("value")))


@query(f"WITH {_SAMPLES} SELECT CAST(vec_id AS VARCHAR) AS name, label, vec_id AS image_id, sha256(text) AS digest FROM x")
def read_recordio(spark, d):
    s = samples(spark, d).select("label", F.col("vec_id").alias("image_id"), F.col("text").alias("content"))
    back = spark.read.format("recordio").load(stored(s, "recordio", "recordio"))
    return back.select("name", "label", "image_id", _digest(F.col("content")))


def _web(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    label = F.when(F.col("vec_id") % 3 > 0, F.create_map(F.lit("cls"), F.col("label").cast("string").cast("binary")))
    parts = F.map_concat(F.create_map(F.lit("txt"), F.col("text")), F.coalesce(label, F.expr("cast(map() as map<string,binary>)")))
    return spark.read.format("webdataset").load(stored(s.select(F.concat(F.lit("d/"), "name").alias("key"), parts.alias("components")), "webdataset", "web"))


@query(f"WITH {_SAMPLES} SELECT 'd/' || name AS key, sha256(text) AS digest, CASE WHEN vec_id % 3 > 0 THEN CAST(label AS VARCHAR) END AS label FROM x")
def read_webdataset(spark, d):
    """Components by extension; missing labels stay null."""
    return records.web_components(_web(spark, d), [["jpg", "txt"], ["cls"]]).select("key", _digest(F.col("c0")), F.col("c1").cast("string").alias("label"))


@query(f"WITH {_SAMPLES} SELECT 'd/' || name AS key, CAST(label AS VARCHAR) AS label FROM x WHERE vec_id % 3 > 0")
def read_webdataset_skip(spark, d):
    """Samples with a missing component go."""
    return records.web_components(_web(spark, d), [["txt"], ["cls"]], "skip").select("key", F.col("c1").cast("string").alias("label"))


#: A box of whole (x, y, width, height).
def _whole_box() -> Column:
    return F.array(*(c.cast("double") for c in (F.col("vec_id") % 50, F.col("label") + 1, F.col("vec_id") % 7 + 2, F.col("label") + 3)))


_WHOLE_BOX = "CAST(vec_id % 50 AS DOUBLE) AS l, CAST(label + 1 AS DOUBLE) AS t, CAST(vec_id % 50 + vec_id % 7 + 2 AS DOUBLE) AS r, CAST(2 * label + 4 AS DOUBLE) AS b"


def _lmdb(s: DataFrame, value: Column) -> DataFrame:
    key = F.lpad(F.col("vec_id").cast("string"), 12, "0")
    return s.sparkSession.read.format("lmdb").load(stored(s.select(key.alias("name"), value.alias("value")), "lmdb", "lmdb"))


@query(f"WITH {_SAMPLES} SELECT vec_id, label, sha256(text) AS digest FROM x")
def read_caffe(spark, d):
    found = records.caffe(_lmdb(samples(spark, d), sinks.datum(F.col("label"), F.col("text"))))
    return found.select(F.col("name").cast("long").alias("vec_id"), "label", _digest(F.col("content")))


@query(f"WITH {_SAMPLES} SELECT vec_id, sha256(text) AS digest, label AS box_label, {_WHOLE_BOX} FROM x")
def read_caffe_detection(spark, d):
    value = sinks.datum(F.col("label"), F.col("text"), F.array(_whole_box()), F.array("label"))
    found = records.caffe(_lmdb(samples(spark, d), value))
    return found.select(F.col("name").cast("long").alias("vec_id"), _digest(F.col("content")), F.get("labels", F.lit(0)).alias("box_label"), F.get("boxes", F.lit(0)).alias("o")).select("vec_id", "digest", "box_label", "o.*")


@query(f"WITH {_SAMPLES} SELECT vec_id, label, sha256(text) AS digest FROM x")
def read_caffe2(spark, d):
    found = records.caffe2(_lmdb(samples(spark, d), sinks.tensors(F.array("label"), F.col("text"))))
    return found.select(F.col("name").cast("long").alias("vec_id"), "label", _digest(F.col("content")))


@query(f"WITH {_SAMPLES} SELECT vec_id, sha256(text) AS digest, label AS box_label, {_WHOLE_BOX} FROM x")
def read_caffe2_detection(spark, d):
    found = records.caffe2(_lmdb(samples(spark, d), sinks.tensors(F.array("label"), F.col("text"), F.array(_whole_box()))))
    return found.select(F.col("name").cast("long").alias("vec_id"), _digest(F.col("content")), F.get("labels", F.lit(0)).alias("box_label"), F.get("boxes", F.lit(0)).alias("o")).select("vec_id", "digest", "box_label", "o.*")


@query(f"WITH {_SAMPLES} SELECT label, sha256(repeat(array_to_string(list_transform(p, lambda v: printf('%02X', v)), ''), 48)) AS digest FROM x")
def read_cifar(spark, d):
    """Fixed records of a label byte and 3,072 values."""
    s = samples(spark, d).select(F.concat(F.unhex(F.lpad(F.hex("label"), 2, "0")), *(F.col("raw") for _ in range(48))).alias("content"))
    return files.cifar_files(spark, stored(s, "fixed", "cifar", prefix="data_batch_")).select("label", _digest(F.hex("values")))


# --- a file for each sample ---


def _each_file(s: DataFrame, extension: str, content: Column, folder: Column | None = None) -> str:
    path = F.concat(F.col("name"), F.lit(f".{extension}"))
    return stored(s.select((path if folder is None else F.concat_ws("/", folder, path)).alias("path"), content.alias("content")), "files", extension)


@query(f"SELECT vec_id, CAST(i AS INT) AS idx, '8,8' AS shape, v[i + 1] AS value FROM (SELECT vec_id, {_DOUBLES} AS v, unnest(range(0, 64)) AS i FROM embeddings)")
def read_npy(spark, d):
    s = vectors(spark, d, False).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), "v")
    back = files.npy_files(spark, _each_file(s, "npy", sinks.npy_bytes(F.col("v"), 8, 8)))
    return back.select(_id(F.col("name")), F.array_join("shape", ",").alias("shape"), F.posexplode("values").alias("idx", "value"))


@query(f"SELECT vec_id, CAST(i AS INT) AS idx, '3,8' AS shape, v[i + 17] AS value FROM (SELECT vec_id, {_DOUBLES} AS v, unnest(range(0, 24)) AS i FROM embeddings WHERE vec_id % 2 = 0)")
def read_npy_rows(spark, d):
    """Rows 2 to 5 of the arrays of 8 x 8; those of 4 x 16 are passed over by their headers, and of the others only these rows are read."""
    s = vectors(spark, d, False).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), "vec_id", "v")
    body = F.when(F.col("vec_id") % 2 == 0, sinks.npy_bytes(F.col("v"), 8, 8)).otherwise(sinks.npy_bytes(F.col("v"), 4, 16))
    back = headers.arrays(spark, _each_file(s, "npy", body), "float32", "8,8", "2:5")
    return back.select(_id(F.col("path")), F.array_join("shape", ",").alias("shape"), F.posexplode("values").alias("idx", "value"))


def _wav(spark: SparkSession, d: str, downmix: bool) -> DataFrame:
    s = vectors(spark, d, False).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), "v")
    back = files.wav_files(spark, _each_file(s, "wav", sinks.wav_bytes(F.col("v"), 16000, 2)), downmix)
    return back.select(_id(F.col("name")), F.col("sample_rate").cast("double").alias("rate"), "channels", F.posexplode("samples").alias("idx", "value"))


@query(f"SELECT vec_id, CAST(16000 AS DOUBLE) AS rate, 2 AS channels, CAST(i AS INT) AS idx, v[i + 1] AS value FROM (SELECT vec_id, {_DOUBLES} AS v, unnest(range(0, 64)) AS i FROM embeddings)")
def read_wav(spark, d):
    return _wav(spark, d, False)


@query(f"SELECT vec_id, CAST(16000 AS DOUBLE) AS rate, 1 AS channels, CAST(i AS INT) AS idx, (v[2 * i + 1] + v[2 * i + 2]) / 2 AS value FROM (SELECT vec_id, {_DOUBLES} AS v, unnest(range(0, 32)) AS i FROM embeddings)")
def read_wav_downmix(spark, d):
    return _wav(spark, d, True)


def _colour() -> Column:
    """Three channels of an 8 x 8 picture: the pixels, their complements, and zero."""
    return F.flatten(F.transform("p", lambda x: F.array(x, 255 - x, F.lit(0))))


@query(f"WITH {_SAMPLES} SELECT vec_id, 8 AS height, 8 AS width, CAST(i AS INT) AS idx, CAST(CASE i % 3 WHEN 0 THEN p[i // 3 + 1] WHEN 1 THEN 255 - p[i // 3 + 1] ELSE 0 END AS DOUBLE) AS value FROM (SELECT *, unnest(range(0, 192)) AS i FROM x)")
def read_images(spark, d):
    """Pictures decoded to RGB."""
    path = _each_file(samples(spark, d), "bmp", sinks.bmp_bytes(_colour(), 8, 8))
    return files.decoded_images(spark, path).select(_id(F.element_at(F.split("path", "/"), -1)), "height", "width", F.posexplode("values").alias("idx", "value"))


@query("SELECT vec_id, 'bmp' AS format, CASE label % 2 WHEN 0 THEN 8 ELSE 16 END AS width, CASE label % 2 WHEN 0 THEN 8 ELSE 4 END AS height FROM embeddings")
def image_header_sizes(spark, d):
    """Sizes of pictures from their heads; nothing is decoded."""
    body = F.when(F.col("label") % 2 == 0, sinks.bmp_bytes(_colour(), 8, 8)).otherwise(sinks.bmp_bytes(_colour(), 4, 16))
    return headers.image_sizes(spark, _each_file(samples(spark, d), "bmp", body)).select(_id(F.col("path")), "format", "width", "height")


@query(f"""
    WITH {_SAMPLES},
    b AS (SELECT *, vec_id // 32 AS batch, vec_id % 32 AS slot, vec_id % 7 = 3 AS failed FROM x),
    l AS (SELECT batch, arg_max(vec_id, slot) AS last FROM b WHERE NOT failed GROUP BY batch),
    r AS (SELECT b.*, CASE WHEN failed THEN last ELSE vec_id END AS shown FROM b JOIN l USING (batch))
    SELECT r.vec_id, r.failed AS replaced, CAST(i AS INT) AS idx, CAST(CASE i % 3 WHEN 0 THEN o.p[i // 3 + 1] WHEN 1 THEN 255 - o.p[i // 3 + 1] ELSE 0 END AS DOUBLE) AS value
    FROM r JOIN x o ON o.vec_id = r.shown, range(0, 192) q(i)""")
def failed_decode_replaced(spark, d):
    """Pictures in batches of 32, of which one in seven is broken and gives way to the last good one of its batch."""
    content = F.when(F.col("vec_id") % 7 == 3, F.col("text")).otherwise(sinks.bmp_bytes(_colour(), 8, 8))
    found = files.decoded_images(spark, _each_file(samples(spark, d), "bmp", content), keep_failed=True)
    placed = found.select(_id(F.element_at(F.split("path", "/"), -1)), "values").select(
        "*", F.floor(F.col("vec_id") / 32).alias("batch"), (F.col("vec_id") % 32).alias("slot"), F.col("values").isNull().alias("failed")
    )
    whole = batches.replace_failed(placed, "batch", "slot", "failed", ["values"])
    return whole.select("vec_id", "replaced", F.posexplode("values").alias("idx", "value"))


@query(f"WITH {_SAMPLES}, f AS (SELECT *, 'c' || (label * 7 % 10) AS folder FROM x) SELECT name || '.bmp' AS name, folder, CAST(dense_rank() OVER (ORDER BY folder) - 1 AS INT) AS label, sha256(text) AS digest FROM f")
def read_class_folders(spark, d):
    """A picture's class is the ordinal of its folder."""
    s = samples(spark, d)
    folder = F.concat(F.lit("c"), (F.col("label") * 7 % 10).cast("string"))
    return files.image_files(spark, _each_file(s, "bmp", F.col("text"), folder)).select("name", "folder", "label", _digest(F.col("content")))


@query("""
    WITH n AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
    w AS (SELECT 'f' || label AS folder, vec_id, k - 2 * f AS start, f, n FROM n, range(0, 3) r(f))
    SELECT folder, vec_id, CAST(start // 2 AS INT) AS sequence, CAST(f AS INT) AS frame FROM w WHERE start >= 0 AND start % 2 = 0 AND start + 4 < n""")
def read_frame_sequences(spark, d):
    """Windows of three frames, two apart, one every two, over the sorted files of a folder."""
    s = samples(spark, d).select("*").withColumn("name", F.lpad(F.col("vec_id").cast("string"), 12, "0"))
    path = _each_file(s, "bmp", F.col("text"), F.concat(F.lit("f"), F.col("label").cast("string")))
    found = files.frame_sequences(spark, path, 3, 2, 2)
    return found.select("folder", _id(F.element_at(F.split("path", "/"), -1), ""), "sequence", "frame")


@query("SELECT 'v' || vec_id || '.bmp' AS name, CAST(label AS INT) AS label FROM embeddings WHERE vec_id % 10 > 0")
def read_label_list(spark, d):
    """Lines of a name and a label; those without a number are left out."""
    e = vectors(spark, d, False).select(F.concat(F.lit("some/where/v"), F.col("vec_id").cast("string"), F.lit(".bmp "), F.when(F.col("vec_id") % 10 == 0, "none").otherwise(F.col("label").cast("string"))).alias("value"))
    path = new_path(spark, "labels")
    e.write.text(path)
    return files.label_list(spark, path)


@query("""
    WITH v AS (SELECT vec_id, CAST(label AS INT) AS label, vec_id % 20 / 10.0 AS s, vec_id % 20 / 10.0 + (vec_id % 3) * 0.5 AS e FROM embeddings),
    f AS (SELECT *, CASE WHEN vec_id % 4 = 0 THEN 0 ELSE CAST(ceil(s * 25) AS INT) END AS first, CASE WHEN vec_id % 4 = 0 THEN 60 ELSE CAST(floor(e * 25) AS INT) END AS last FROM v)
    SELECT 'v' || vec_id || '.mp4' AS file, label, first, last FROM f WHERE first < last AND last <= 60""")
def read_video_list(spark, d):
    """Lines of a file, a label and, for three of four, a stretch in seconds; videos have 60 frames at 25 a second."""
    e = vectors(spark, d, False)
    name = F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(".mp4"))
    start = F.col("vec_id") % 20 / 10
    stretch = F.when(F.col("vec_id") % 4 == 0, "").otherwise(F.concat_ws(" ", start.cast("string"), (start + F.col("vec_id") % 3 * 0.5).cast("string")))
    path = new_path(spark, "videos")
    e.select(F.concat_ws(" ", name, F.col("label").cast("string"), stretch).alias("value")).write.text(path)
    return files.video_list(spark, path, e.select(name.alias("file"), F.lit(25.0).alias("fps"), F.lit(60).cast("long").alias("frames")), by_frame=False)


# --- annotations: three objects a picture of 100 x 80 ---


def _coco(spark: SparkSession, d: str) -> DataFrame:
    b = boxed(spark, d)
    joints = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.array(i * 3.0, i * 2.0, (F.pmod(i + F.col("vec_id"), F.lit(3))).cast("double"))))

    def one(x: Column, k: Column) -> Column:
        corners = F.array(F.array(x["l"], x["t"], x["r"], x["t"]), F.array(x["r"], x["b"]))
        return F.struct(
            (F.col("vec_id") * 3 + k).alias("id"), F.col("vec_id").alias("image_id"), F.pmod(F.col("label") + k, F.lit(10)).alias("category_id"), (F.pmod(F.col("vec_id") + k, F.lit(5)) == 0).cast("int").alias("iscrowd"),
            F.array(x["l"], x["t"], x["r"] - x["l"], x["b"] - x["t"]).alias("bbox"), corners.alias("segmentation"), joints.alias("keypoints"),
        )

    picture = F.struct(F.col("vec_id").alias("id"), F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(100).alias("width"), F.lit(80).alias("height"))
    grouped = b.select(F.floor(F.col("vec_id") / COCO_FILE).alias("part"), picture.alias("i"), F.transform("boxes", one).alias("a")).groupBy("part").agg(F.collect_list("i").alias("images"), F.flatten(F.collect_list("a")).alias("annotations"))
    classes = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((9 - i).alias("id"), F.concat(F.lit("c"), (9 - i).cast("string")).alias("name")))
    text = F.to_json(F.struct("images", classes.alias("categories"), "annotations"))
    return coco.scan(spark, stored(grouped.select(F.concat(F.lit("part-"), F.col("part").cast("string"), F.lit(".json")).alias("path"), text.cast("binary").alias("content")), "files", "coco"), 65536)


_OBJECTS = f"{_BOXED}, o AS (SELECT vec_id AS image_id, vec_id * 3 + box_id AS id, box_id, label % 10 AS category_id, (vec_id + box_id) % 5 = 0 AS crowd, l, t, r, b FROM bx)"


@query(f"WITH {_OBJECTS} SELECT image_id, 'v' || image_id || '.jpg' AS name, 100 AS img_w, 80 AS img_h, CAST(box_id AS INT) AS idx, CAST(10 - category_id AS INT) AS label, round(l / 100, 5) AS l, round(t / 80, 5) AS t, round(r / 100, 5) AS r, round(b / 80, 5) AS b FROM o")
def coco_detections(spark, d):
    """Boxes relative to the picture, classes renumbered in the file's order."""
    found = coco.detections(_coco(spark, d), relative=True)
    each = found.select("image_id", "name", "img_w", "img_h", F.posexplode(F.arrays_zip("boxes", "labels")).alias("idx", "o"))
    return each.select("image_id", "name", "img_w", "img_h", "idx", F.col("o.labels").alias("label"), *(F.round(f"o.boxes.{c}", 5).alias(c) for c in "ltrb"))


@query(f"WITH {_OBJECTS} SELECT 'v' || image_id || '.jpg' AS name, CAST(2 * count(*) AS INT) AS total, CAST(count(*) AS INT) AS objects, round(sum(l + 2 * t + 2 * r + b), 4) AS sum FROM o WHERE NOT crowd GROUP BY image_id")
def coco_masks(spark, d):
    """Polygons by object and all their vertices; crowds are left out."""
    found = coco.detections(_coco(spark, d), masks=True)
    total = F.aggregate("coordinates", F.lit(0.0), lambda a, x: a + x)
    return coco.mask_counts(found).join(coco.mask_coordinates(found), "name").select("name", "total", F.size("counts").alias("objects"), F.round(total, 4).alias("sum"))


@query(f"""
    WITH {_OBJECTS}, n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY id) - 1 AS object FROM o WHERE NOT crowd),
    p AS (SELECT *, 0 AS polygon, [l, t, r, t] AS v FROM n UNION ALL SELECT *, 1 AS polygon, [r, b] AS v FROM n)
    SELECT image_id, CAST(object AS INT) AS object, CAST(polygon AS INT) AS polygon, CAST(i AS INT) AS idx, round(v[i + 1], 5) AS value FROM (SELECT *, unnest(range(0, len(v))) AS i FROM p)""")
def coco_mask_vertices(spark, d):
    """Each coordinate at its place in its polygon of its object."""
    found = coco.detections(_coco(spark, d), masks=True).select("image_id", F.posexplode("masks").alias("object", "m"))
    polygons = found.select("image_id", "object", F.posexplode("m").alias("polygon", "v"))
    return polygons.select("image_id", "object", "polygon", F.posexplode("v").alias("idx", "value")).withColumn("value", F.round("value", 5))


@query(f"""
    WITH {_OBJECTS},
    c AS (SELECT *, greatest(0, l) AS x1, greatest(0, t) AS y1, least(99, greatest(0, l) + greatest(0, r - l - 1)) AS x2, least(79, greatest(0, t) + greatest(0, b - t - 1)) AS y2 FROM o WHERE category_id = 1 AND NOT crowd),
    k AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h, row_number() OVER (PARTITION BY image_id ORDER BY id) AS n FROM c WHERE x2 >= x1 AND y2 >= y1)
    SELECT image_id, id AS annotation_id, round(x1 + w / 2, 5) AS cx, round(y1 + h / 2, 5) AS cy,
        round(greatest(w, h * 0.75) / 200 * 1.25, 6) AS sx, round(greatest(h, w / 0.75) / 200 * 1.25, 6) AS sy,
        CAST(i AS INT) AS joint, i * 3.0::DOUBLE AS x, i * 2.0::DOUBLE AS y, CAST((i + image_id) % 3 > 0 AS INT)::DOUBLE AS visible
    FROM k, range(0, 17) r(i) WHERE n = 1""")
def coco_keypoints(spark, d):
    """Joints, centre and scale of the first person of a picture."""
    found = coco.keypoints(_coco(spark, d))
    at = lambda c, i: F.get(c, F.lit(i))
    each = found.select("image_id", "annotation_id", "center", "scale", F.posexplode(F.arrays_zip("joints", "visibility")).alias("joint", "j"))
    return each.select(
        "image_id", "annotation_id", F.round(at("center", 0), 5).alias("cx"), F.round(at("center", 1), 5).alias("cy"), F.round(at("scale", 0), 6).alias("sx"), F.round(at("scale", 1), 6).alias("sy"),
        "joint", at("j.joints", 0).alias("x"), at("j.joints", 1).alias("y"), at("j.visibility", 0).alias("visible"),
    )


# --- external source ---


@query("""
    WITH d AS (SELECT 'f' || doc_id % 3 AS feed, doc_id, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY doc_id % 3) AS n FROM documents)
    SELECT feed, doc_id AS sample, k // 16 AS batch_id, CAST(k % 16 AS INT) AS slot, false AS is_pad FROM d
    UNION ALL SELECT feed, doc_id, k // 16, CAST(p AS INT), true FROM d, range(0, 16) r(p) WHERE k = n - 1 AND p > k % 16""")
def external_batches(spark, d):
    """Samples of three feeds, fed in four pieces and streamed by a query that is stopped and restarted after each: batches go on over the pieces, the last is filled."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string")).alias("feed"), F.col("doc_id").alias("sample"))
    bounds = docs.agg(F.min("sample").alias("a"), F.max("sample").alias("b")).first()
    fed, sink, checkpoint = (new_path(spark, n) for n in ("fed", "batched", "stream"))
    schema = "feed string, sample long, last boolean"
    step = -(-(bounds["b"] - bounds["a"] + 1) // 4)
    for k in range(5):
        low = bounds["a"] + k * step
        some = docs.where((F.col("sample") >= low) & (F.col("sample") < low + step)).withColumn("last", F.lit(False))
        external.feed(some if k < 4 else docs.select("feed").distinct().select("feed", F.lit(None).cast("long").alias("sample"), F.lit(True).alias("last")), fed)
        carried = batching.carried(external.stream(spark, fed, schema), 16, "fill")
        carried.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.parquet(sink)
