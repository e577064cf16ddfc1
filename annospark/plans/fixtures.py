"""Inputs of the reference operators' queries, in Spark and as SQL text with the same meaning.

Every key counts once. ``boxes``: the annotations with an existing image of known
size and four finite coordinates; ``preds``: the same boxes shifted as a model
might, with a score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..runtime import table


def images(spark: SparkSession, d: str) -> DataFrame:
    """``image_id``, ``w``, ``h``, ``file_name``, ``split``, ``source``."""
    t = table(spark, d, "images", "image_id", "file_name", "width", "height", "split", "source")
    return t.dropDuplicates(["image_id"]).select("image_id", F.col("width").alias("w"), F.col("height").alias("h"), "file_name", "split", "source")


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """The annotations, each key once."""
    return table(spark, d, "annotations", "ann_id", "image_id", "category_id", "bbox", "area", "iscrowd", "score").dropDuplicates(["ann_id"])


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """``ann_id``, ``image_id``, ``category_id``, ``w``, ``h``, ``box`` (xyxy), ``score``."""
    known = images(spark, d).where("w is not null and h is not null").select("image_id", "w", "h")
    return annotations(spark, d).where("image_id is not null and size(bbox) = 4").join(known, "image_id").select("ann_id", "image_id", "category_id", "w", "h", G.xywh_to_xyxy(F.col("bbox")).alias("box"), "score").where("not exists(box, x -> x is null)")


def with_prediction(df: DataFrame) -> DataFrame:
    """Adds ``pred``: the box moved and stretched by a fixed function of its key."""
    x, y = (F.pmod(F.col("ann_id"), F.lit(k)) - k // 2 for k in (9, 7))
    return df.withColumn("pred", F.array(*[F.get("box", F.lit(i)) + s for i, s in enumerate((x, y, x * 2, y * 2))]))


def sql_rounded(x: str, digits: int) -> str:
    """The SQL of ``geometry.rounded``."""
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


#: SQL with the same meaning; used as common table expressions.
IMAGES = """images_ as (select image_id, width as w, height as h, file_name, split, source from (select *, row_number() over (partition by image_id) as rn_ from images) where rn_ = 1)"""
ANNOTATIONS = """annotations_ as (select ann_id, image_id, category_id, bbox, area, iscrowd, score from (select *, row_number() over (partition by ann_id) as rn_ from annotations) where rn_ = 1)"""
BOXES = f"""{IMAGES}, {ANNOTATIONS}, boxes_ as (
  select a.ann_id, a.image_id, a.category_id, i.w, i.h, a.score, a.bbox[1] as x1, a.bbox[2] as y1, a.bbox[1] + a.bbox[3] as x2, a.bbox[2] + a.bbox[4] as y2
  from annotations_ a join images_ i on a.image_id = i.image_id
  where i.w is not null and i.h is not null and len(a.bbox) = 4 and a.bbox[1] is not null and a.bbox[2] is not null and a.bbox[3] is not null and a.bbox[4] is not null)"""
PREDS = f"""{BOXES}, preds_ as (
  select *, x1 + dx as px1, y1 + dy as py1, x2 + 2 * dx as px2, y2 + 2 * dy as py2
  from (select *, (ann_id % 9) - 4 as dx, (ann_id % 7) - 3 as dy from boxes_))"""
