"""Detection, mask and keypoint annotations from COCO JSON.

Files may be larger than a task's memory: ``jsonscan`` finds the arrays of each
file and cuts them into ranges, and each of the three tables is a scan of its
own array alone.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.sources import jsonscan, records


def _number(kind: type, value):
    return kind(value) if isinstance(value, (int, float)) else None


def _numbers(values) -> list | None:
    return [_number(float, v) for v in values] if isinstance(values, list) else None


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


class ImageReader(jsonscan.ArrayReader):
    section = "images"

    def row(self, x: dict) -> tuple:
        return _number(int, x.get("id")), _text(x.get("file_name")), _number(int, x.get("width")), _number(int, x.get("height"))


class CategoryReader(jsonscan.ArrayReader):
    section = "categories"

    def row(self, x: dict) -> tuple:
        return _number(int, x.get("id")), _text(x.get("name"))


class AnnotationReader(jsonscan.ArrayReader):
    """Segmentations stay text until they are asked for."""

    section = "annotations"

    def row(self, x: dict) -> tuple:
        whole = (_number(int, x.get(k)) for k in ("id", "image_id", "category_id", "iscrowd"))
        return *whole, _number(float, x.get("area")), _numbers(x.get("bbox")), _text(x.get("segmentation")), _numbers(x.get("keypoints"))


_SOURCES = {
    "coco_images": ("file string, position long, id long, file_name string, width int, height int", ImageReader),
    "coco_categories": ("file string, position long, id long, name string", CategoryReader),
    "coco_annotations": (
        "file string, position long, id long, image_id long, category_id long, iscrowd int, area double, bbox array<double>, segmentation string, keypoints array<double>",
        AnnotationReader,
    ),
}


@dataclass
class Coco:
    """The three arrays of the files below a path; ``position`` is an object's place in its file."""

    images: DataFrame
    categories: DataFrame
    annotations: DataFrame


SCHEMA = (
    "images array<struct<id:long,file_name:string,width:int,height:int>>, categories array<struct<id:long,name:string>>, "
    "annotations array<struct<id:long,image_id:long,category_id:long,iscrowd:int,area:double,bbox:array<double>,segmentation:string,keypoints:array<double>>>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file, for files that fit in a task; ``scan`` reads files of any size."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def _tables(data: Coco | DataFrame) -> Coco:
    if isinstance(data, Coco):
        return data
    each = lambda c: data.select(F.input_file_name().alias("file"), F.posexplode(c).alias("position", "x")).select("file", F.col("position").cast("long"), "x.*")
    return Coco(*(each(c) for c in ("images", "categories", "annotations")))


def scan(spark: SparkSession, path: str, split_bytes: int = jsonscan.SPLIT_BYTES) -> Coco:
    """A corpus of annotations may be one large file or many; an array that is lacking is an empty table."""
    for label, (columns, kind) in _SOURCES.items():
        spark.dataSource.register(records._source(label, columns, kind))
    where = jsonscan.index(spark, path, split_bytes)
    return Coco(*(spark.read.format(label).option("arrays", where).load(path) for label in _SOURCES))


def images(data: Coco | DataFrame) -> DataFrame:
    return _tables(data).images.select(F.col("id").alias("image_id"), F.col("file_name").alias("name"), F.col("width").alias("img_w"), F.col("height").alias("img_h"))


def categories(data: Coco | DataFrame) -> DataFrame:
    """(category_id, class): classes are 1..n in the file's order; a file's categories are few."""
    place = F.row_number().over(Window.partitionBy("file").orderBy("position"))
    return _tables(data).categories.select(F.col("id").alias("category_id"), place.alias("place")).groupBy("category_id").agg(F.min("place").alias("class"))


def annotations(data: Coco | DataFrame) -> DataFrame:
    return _tables(data).annotations.drop("file")


def detections(data: Coco | DataFrame, masks: bool = False, remap: bool = True, relative: bool = False) -> DataFrame:
    """(name, image_id, img_w, img_h, boxes, labels, masks): one row for each annotated image, objects in file order.

    With ``masks`` crowds are left out, right and bottom edges are one less,
    and polygons come as ``array<array<double>>``. ``remap`` numbers classes
    from 1 in file order. ``relative`` divides edges by the image's size.
    """
    a = annotations(data)
    if masks:
        a = a.where("coalesce(iscrowd, 0) = 0")
    if remap:
        a = a.join(categories(data), "category_id")
    label = (F.col("class") if remap else F.col("category_id")).cast("int")
    joined = a.join(images(data), "image_id")
    off = 1 if masks else 0
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    fx, fy = (F.col("img_w"), F.col("img_h")) if relative else (F.lit(1.0), F.lit(1.0))
    edges = F.struct((x / fx).alias("l"), (y / fy).alias("t"), ((x + w - off) / fx).alias("r"), ((y + h - off) / fy).alias("b"))
    polygons = F.from_json("segmentation", "array<array<double>>") if masks else F.lit(None).cast("array<array<double>>")
    rows = joined.select("name", "image_id", "img_w", "img_h", F.struct("position", edges.alias("box"), label.alias("label"), polygons.alias("mask")).alias("o"))
    grouped = rows.groupBy("name", "image_id", "img_w", "img_h").agg(F.sort_array(F.collect_list("o")).alias("o"))
    return grouped.select("name", "image_id", "img_w", "img_h", F.col("o.box").alias("boxes"), F.col("o.label").alias("labels"), F.col("o.mask").alias("masks"))


def mask_counts(found: DataFrame) -> DataFrame:
    """(name, counts, total): polygons of each object."""
    counts = F.transform("masks", lambda m: F.size(m))
    return found.select("name", counts.alias("counts"), F.aggregate(counts, F.lit(0), lambda a, x: a + x).alias("total"))


def mask_coordinates(found: DataFrame) -> DataFrame:
    """(name, coordinates): all vertices of an image in one array."""
    return found.select("name", F.flatten(F.flatten("masks")).alias("coordinates"))


def keypoints(data: Coco | DataFrame, pose_w: int = 288, pose_h: int = 384, person: int = 1) -> DataFrame:
    """(name, image_id, annotation_id, center, scale, joints, visibility, score, rotation): one person for each image, the first in the file.

    Crowds, other categories and people without joints are left out. The box is
    clipped to the image; its longer side, by the pose's aspect, sets the scale
    in units of 200 pixels, with a margin of a quarter.
    """
    rows = annotations(data).join(images(data), "image_id")
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    x1, y1 = F.greatest(F.lit(0.0), x), F.greatest(F.lit(0.0), y)
    x2 = F.least(F.col("img_w") - 1.0, x1 + F.greatest(F.lit(0.0), w - 1))
    y2 = F.least(F.col("img_h") - 1.0, y1 + F.greatest(F.lit(0.0), h - 1))
    seen = F.filter(F.col("keypoints"), lambda v, i: (i % 3 == 2) & (v > 0))
    part = lambda k: F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.get("keypoints", i * 3 + k))
    xs, ys, vs = part(0), part(1), part(2)
    bw, bh, aspect = x2 - x1, y2 - y1, pose_w / pose_h

    def side(a: Column, b: Column, tall: Column, wide: Column) -> Column:
        return F.when(bw > aspect * bh, wide).when(bw < aspect * bh, tall).otherwise(a)

    sw, sh = side(bw, bh, bh * aspect, bw), side(bh, bw, bh, bw / aspect)
    rows = rows.where((F.col("category_id") == person) & (F.coalesce("iscrowd", F.lit(0)) == 0) & (F.size(seen) > 0) & (x2 >= x1) & (y2 >= y1))
    flag = F.transform(vs, lambda v: F.least(v, F.lit(1.0)))
    out = rows.select(
        "name", "image_id", "position", F.col("id").alias("annotation_id"),
        F.array(x1 + bw / 2, y1 + bh / 2).alias("center"), F.array(sw / 200 * 1.25, sh / 200 * 1.25).alias("scale"),
        F.zip_with(xs, ys, lambda a, b: F.array(a, b)).alias("joints"), F.transform(flag, lambda v: F.array(v, v)).alias("visibility"),
        F.lit(1.0).alias("score"), F.lit(0.0).alias("rotation"),
    )
    columns = [c for c in out.columns if c not in ("image_id", "position")]
    first = out.groupBy("image_id").agg(F.min_by(F.struct(*columns), "position").alias("p"))
    return first.select("image_id", "p.*")
