"""Queries over boxes, points and keypoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import fixtures as X

_C = ("x1", "y1", "x2", "y2")


def _spread(df: DataFrame, column: str, digits: int = 6, names: tuple[str, ...] = _C) -> DataFrame:
    """The entries of a box as columns, rounded."""
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, *[G.rounded(F.get(column, F.lit(i)), digits).alias(n) for i, n in enumerate(names)])


def box_expand_square(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in the padded square."""
    b = X.boxes(spark, d)
    return _spread(b.select("ann_id", G.expand_box(F.col("box"), F.col("w"), F.col("h")).alias("b")), "b")


def box_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as parts of the image size."""
    b = X.boxes(spark, d)
    return _spread(b.select("ann_id", G.normalize_box(F.col("box"), F.col("w"), F.col("h")).alias("b")), "b")


def box_format_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """To centre format and back; the largest difference per image size."""
    b = X.boxes(spark, d).withColumn("back", G.center_to_xyxy(G.xyxy_to_center(F.col("box"))))
    gap = F.array_max(F.zip_with("box", "back", lambda x, y: F.abs(x - y)))
    return b.groupBy("w", "h").agg(F.count(F.lit(1)).alias("n"), G.rounded(F.max(gap), 6).alias("worst"), G.rounded(F.avg(F.get(G.xyxy_to_center(F.col("box")), F.lit(0))), 6).alias("mean_cx"))


def box_square2origin(spark: SparkSession, d: str) -> DataFrame:
    """From the padded square back to the original image."""
    b = X.boxes(spark, d)
    side = F.greatest("w", "h")
    square = G.normalize_box(G.expand_box(F.col("box"), F.col("w"), F.col("h")), side, side)
    return _spread(b.select("ann_id", G.square_to_origin(square, F.col("w"), F.col("h")).alias("b")), "b", 4)


def box_resize(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in scaled images."""
    b = X.boxes(spark, d)
    small = _spread(b.select("ann_id", G.resize_longest(F.col("box"), F.col("w"), F.col("h")).alias("l"), G.resize_box(F.col("box"), F.col("w"), F.col("h")).alias("b")), "b", 4)
    return _spread(small, "l", 4, ("lx1", "ly1", "lx2", "ly2"))


def point_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Box centres as points of the padded square, as parts of its side."""
    b = X.boxes(spark, d)
    centre = F.slice(G.xyxy_to_center(F.col("box")), 1, 2)
    side = F.greatest("w", "h")
    return _spread(b.select("ann_id", G.normalize_point(G.expand_point(centre, F.col("w"), F.col("h")), side, side).alias("p")), "p", 6, ("px", "py"))


def _keypoints() -> F.Column:
    """Seventeen points along the diagonal of a box, every third unseen."""
    at = lambda i, k: F.get("box", F.lit(i)) + (F.get("box", F.lit(i + 2)) - F.get("box", F.lit(i))) * k / 16
    return F.transform(F.sequence(F.lit(0), F.lit(16)), lambda k: F.array(at(0, k), at(1, k), F.pmod(k + F.col("ann_id"), F.lit(3)).cast("double")))


def keypoint_denorm(spark: SparkSession, d: str) -> DataFrame:
    """Keypoints through the padded square; sums per image size."""
    b = X.boxes(spark, d).withColumn("k", _keypoints())
    whole = G.denormalize_keypoint(F.array(F.lit(0.5), F.lit(0.25), F.get(F.get("k", F.lit(1)), F.lit(2))), F.col("w"), F.col("h"))
    same = G.let(F.flatten("k"), lambda f: G.keypoints_split(G.keypoints_join(f)) == f)
    return b.select("w", "h", whole.alias("p"), same.alias("same")).groupBy("w", "h").agg(F.count(F.lit(1)).alias("n"), G.rounded(F.sum(F.get("p", F.lit(0))), 4).alias("sx"), G.rounded(F.sum(F.get("p", F.lit(1))), 4).alias("sy"), F.sum(F.col("same").cast("int")).alias("n_same"))


def coco_bbox_convert(spark: SparkSession, d: str) -> DataFrame:
    """Corner, width and height and back."""
    a = X.annotations(spark, d).where("size(bbox) = 4")
    return _spread(a.select("ann_id", G.xyxy_to_xywh(G.xywh_to_xyxy(F.col("bbox"))).alias("b")), "b", 4, ("x", "y", "bw", "bh"))


def pairwise_iou(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each box with its prediction."""
    p = X.with_prediction(X.boxes(spark, d))
    return p.select("ann_id", G.rounded(G.iou(F.col("pred"), F.col("box")), 6).alias("iou"), G.rounded(G.iou(F.col("pred"), F.col("box"), 1e-6), 6).alias("iou_eps"))


def pairwise_giou(spark: SparkSession, d: str) -> DataFrame:
    """Generalised overlap of each box with its prediction."""
    p = X.with_prediction(X.boxes(spark, d)).where(G.valid_box(F.col("box")))
    return p.select("ann_id", G.rounded(G.giou(F.col("pred"), F.col("box")), 6).alias("giou"))


def rec_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """AG12: share of boxes with overlap above one half and mean overlap, per image size."""
    b = X.with_prediction(X.boxes(spark, d))
    norm = lambda c: G.normalize_box(F.col(c), F.col("w"), F.col("h"))
    scored = b.select("w", "h", G.iou(norm("pred"), norm("box")).alias("iou"))
    return scored.groupBy("w", "h").agg(F.count(F.lit(1)).alias("n"), G.rounded(F.avg((F.col("iou") > 0.5).cast("double")), 6).alias("accuracy"), G.rounded(F.avg("iou"), 5).alias("mean_iou"))


QUERIES = {f.__name__: f for f in (rec_accuracy, box_expand_square, box_normalize, box_format_roundtrip, box_square2origin, box_resize, point_normalize, keypoint_denorm, coco_bbox_convert, pairwise_iou, pairwise_giou)}

_EXPAND = "x1 + floor(greatest(h - w, 0) / 2) as x1, y1 + floor(greatest(w - h, 0) / 2) as y1, x2 + floor(greatest(h - w, 0) / 2) as x2, y2 + floor(greatest(w - h, 0) / 2) as y2"
_NORM = "(floor(greatest(0, least({0} / {1}, 1)) * 1e3 + 0.5) / 1e3)"
_norm = lambda c, s: _NORM.format(c, s)
_IOU = "coalesce(greatest(least({2}, {6}) - greatest({0}, {4}), 0) * greatest(least({3}, {7}) - greatest({1}, {5}), 0) / nullif(greatest({2} - {0}, 0) * greatest({3} - {1}, 0) + greatest({6} - {4}, 0) * greatest({7} - {5}, 0) - greatest(least({2}, {6}) - greatest({0}, {4}), 0) * greatest(least({3}, {7}) - greatest({1}, {5}), 0) + {8}, 0), 0)"


def _iou_sql(a: tuple[str, ...], b: tuple[str, ...], eps: str = "0") -> str:
    return _IOU.format(*a, *b, eps)


_P, _B = ("px1", "py1", "px2", "py2"), ("x1", "y1", "x2", "y2")

SQL = {
    "box_expand_square": f"with {X.BOXES} select ann_id, (floor((x1 + floor(greatest(h - w, 0) / 2)) * 1e6 + 0.5) / 1e6) as x1, (floor((y1 + floor(greatest(w - h, 0) / 2)) * 1e6 + 0.5) / 1e6) as y1, (floor((x2 + floor(greatest(h - w, 0) / 2)) * 1e6 + 0.5) / 1e6) as x2, (floor((y2 + floor(greatest(w - h, 0) / 2)) * 1e6 + 0.5) / 1e6) as y2 from boxes_",
    "box_normalize": f"with {X.BOXES} select ann_id, {_norm('x1', 'w')} as x1, {_norm('y1', 'h')} as y1, {_norm('x2', 'w')} as x2, {_norm('y2', 'h')} as y2 from boxes_",
    "box_format_roundtrip": f"""with {X.BOXES}, c as (select w, h, x1, y1, x2, y2, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, x2 - x1 as bw, y2 - y1 as bh from boxes_)
        select w, h, count(*) as n, (floor((max(greatest(abs(cx - bw / 2 - x1), abs(cy - bh / 2 - y1), abs(cx + bw / 2 - x2), abs(cy + bh / 2 - y2)))) * 1e6 + 0.5) / 1e6) as worst, (floor((avg(cx)) * 1e6 + 0.5) / 1e6) as mean_cx from c group by w, h""",
    "box_square2origin": f"""with {X.BOXES}, e as (select ann_id, w, h, greatest(w, h) as s, floor(greatest(h - w, 0) / 2) as dx, floor(greatest(w - h, 0) / 2) as dy, {_EXPAND} from boxes_),
        q as (select ann_id, w, h, s, dx, dy, {_norm('x1', 's')} as a, {_norm('y1', 's')} as b, {_norm('x2', 's')} as c, {_norm('y2', 's')} as d from e)
        select ann_id, (floor((greatest(0, least(a * s - dx, w))) * 1e4 + 0.5) / 1e4) as x1, (floor((greatest(0, least(b * s - dy, h))) * 1e4 + 0.5) / 1e4) as y1, (floor((greatest(0, least(c * s - dx, w))) * 1e4 + 0.5) / 1e4) as x2, (floor((greatest(0, least(d * s - dy, h))) * 1e4 + 0.5) / 1e4) as y2 from q""",
    "box_resize": f"""with {X.BOXES}, k as (select *, cast(1024 as double) / greatest(w, h) as f from boxes_)
        select ann_id, (floor((x1 * floor(w * f + 0.5) / w) * 1e4 + 0.5) / 1e4) as lx1, (floor((y1 * floor(h * f + 0.5) / h) * 1e4 + 0.5) / 1e4) as ly1, (floor((x2 * floor(w * f + 0.5) / w) * 1e4 + 0.5) / 1e4) as lx2, (floor((y2 * floor(h * f + 0.5) / h) * 1e4 + 0.5) / 1e4) as ly2,
        (floor(({_norm('x1', 'w')} * floor(w * cast(0.3 as double))) * 1e4 + 0.5) / 1e4) as x1, (floor(({_norm('y1', 'h')} * floor(h * cast(0.3 as double))) * 1e4 + 0.5) / 1e4) as y1, (floor(({_norm('x2', 'w')} * floor(w * cast(0.3 as double))) * 1e4 + 0.5) / 1e4) as x2, (floor(({_norm('y2', 'h')} * floor(h * cast(0.3 as double))) * 1e4 + 0.5) / 1e4) as y2 from k""",
    "point_normalize": f"""with {X.BOXES} select ann_id, (floor((greatest(0, least(((x1 + x2) / 2 + floor(greatest(h - w, 0) / 2)) / greatest(w, h), 1))) * 1e6 + 0.5) / 1e6) as px, (floor((greatest(0, least(((y1 + y2) / 2 + floor(greatest(w - h, 0) / 2)) / greatest(w, h), 1))) * 1e6 + 0.5) / 1e6) as py from boxes_""",
    "keypoint_denorm": f"""with {X.BOXES}, v as (select w, h, (1 + ann_id) % 3 as v from boxes_)
        select w, h, count(*) as n, (floor((sum(case when v <> 0 then floor(cast(0.5 as double) * w) else 0 end)) * 1e4 + 0.5) / 1e4) as sx, (floor((sum(case when v <> 0 then floor(cast(0.25 as double) * h) else 0 end)) * 1e4 + 0.5) / 1e4) as sy, count(*) as n_same from v group by w, h""",
    "coco_bbox_convert": f"""with {X.ANNOTATIONS} select ann_id, (floor((bbox[1]) * 1e4 + 0.5) / 1e4) as x, (floor((bbox[2]) * 1e4 + 0.5) / 1e4) as y, (floor(((bbox[1] + bbox[3]) - bbox[1]) * 1e4 + 0.5) / 1e4) as bw, (floor(((bbox[2] + bbox[4]) - bbox[2]) * 1e4 + 0.5) / 1e4) as bh from annotations_ where len(bbox) = 4""",
    "pairwise_iou": f"with {X.PREDS} select ann_id, (floor(({_iou_sql(_P, _B)}) * 1e6 + 0.5) / 1e6) as iou, (floor(({_iou_sql(_P, _B, '1e-6')}) * 1e6 + 0.5) / 1e6) as iou_eps from preds_",
    "pairwise_giou": f"""with {X.PREDS}, t as (select ann_id, greatest(least(px2, x2) - greatest(px1, x1), 0) * greatest(least(py2, y2) - greatest(py1, y1), 0) as i, greatest(px2 - px1, 0) * greatest(py2 - py1, 0) + greatest(x2 - x1, 0) * greatest(y2 - y1, 0) as ab,
        (greatest(px2, x2) - least(px1, x1)) * (greatest(py2, y2) - least(py1, y1)) as hull from preds_ where x2 >= x1 and y2 >= y1)
        select ann_id, (floor((coalesce(i / nullif(ab - i, 0), 0) - coalesce((hull - (ab - i)) / nullif(hull, 0), 0)) * 1e6 + 0.5) / 1e6) as giou from t""",
    "rec_accuracy": f"""with {X.PREDS}, n as (select w, h, {", ".join(f"{_norm(c, 'w' if 'x' in c else 'h')} as {c}" for c in (*_P, *_B))} from preds_), s as (select w, h, {_iou_sql(_P, _B)} as iou from n)
        select w, h, count(*) as n, (floor((avg(case when iou > 0.5 then 1 else 0 end)) * 1e6 + 0.5) / 1e6) as accuracy, (floor((avg(iou)) * 1e5 + 0.5) / 1e5) as mean_iou from s group by w, h""",
}
