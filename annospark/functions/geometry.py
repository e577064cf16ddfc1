"""Boxes, points and keypoints as column expressions.

A box is ``array<double>`` of four numbers, a point of two, a keypoint of three
(x, y, visibility). Everything is a built-in expression, so plans stay inside
code generation; boxes made by one function and read by the next dissolve into
plain arithmetic. A null or missing entry, or a null size, makes the entries
computed from it null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard deviations of the 17 body keypoints.
COCO_SIGMAS = (0.026, 0.025, 0.025, 0.035, 0.035, 0.079, 0.079, 0.072, 0.072, 0.062, 0.062, 0.107, 0.107, 0.087, 0.087, 0.089, 0.089)


def _at(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i))


def _box(*parts: Column) -> Column:
    return F.array(*[p.cast("double") for p in parts])


def rounded(x: Column, digits: int) -> Column:
    """Round half up on the binary value, the same arithmetic in every engine."""
    unit = float(10**digits)
    return F.floor(x * unit + 0.5) / unit


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _clamp(x: Column, top: Column | float = 1.0) -> Column:
    top = top if isinstance(top, Column) else F.lit(float(top))
    return F.when(x.isNotNull() & top.isNotNull(), F.greatest(F.lit(0.0), F.least(x, top)))


def _ratio(x: Column, y: Column) -> Column:
    return F.try_divide(x.cast("double"), y.cast("double"))


def valid_box(box: Column) -> Column:
    """Whether an xyxy box has four numbers and no negative extent (F1); null counts as not valid."""
    return F.coalesce((F.size(box) == 4) & (_at(box, 2) >= _at(box, 0)) & (_at(box, 3) >= _at(box, 1)), F.lit(False))


def xywh_to_xyxy(box: Column) -> Column:
    """Corner, width and height to two corners."""
    return _box(_at(box, 0), _at(box, 1), _at(box, 0) + _at(box, 2), _at(box, 1) + _at(box, 3))


def xyxy_to_xywh(box: Column) -> Column:
    """Two corners to corner, width and height."""
    return _box(_at(box, 0), _at(box, 1), _at(box, 2) - _at(box, 0), _at(box, 3) - _at(box, 1))


def xyxy_to_center(box: Column, digits: int | None = None) -> Column:
    """Two corners to centre, width and height (G10 with ``digits=3``, G27 without)."""
    parts = [(_at(box, 0) + _at(box, 2)) / 2, (_at(box, 1) + _at(box, 3)) / 2, _at(box, 2) - _at(box, 0), _at(box, 3) - _at(box, 1)]
    return _box(*[rounded(p, digits) if digits is not None else p for p in parts])


def center_to_xyxy(box: Column, digits: int | None = None, w: Column | None = None, h: Column | None = None) -> Column:
    """Centre, width and height to two corners, clamped to a size if given."""
    parts = [_at(box, 0) - _at(box, 2) / 2, _at(box, 1) - _at(box, 3) / 2, _at(box, 0) + _at(box, 2) / 2, _at(box, 1) + _at(box, 3) / 2]
    if w is not None and h is not None:
        parts = [_clamp(p, s.cast("double")) for p, s in zip(parts, (w, h, w, h), strict=True)]
    return _box(*[rounded(p, digits) if digits is not None else p for p in parts])


def square_offset(w: Column, h: Column) -> tuple[Column, Column]:
    """Offsets of an image inside the square it is padded to: half the difference, rounded down, on the short axis."""
    return F.floor(F.greatest(h - w, F.lit(0)) / 2).cast("double"), F.floor(F.greatest(w - h, F.lit(0)) / 2).cast("double")


def expand_box(box: Column, w: Column, h: Column) -> Column:
    """A box in the padded square (G1)."""
    dx, dy = square_offset(w, h)
    return _box(_at(box, 0) + dx, _at(box, 1) + dy, _at(box, 2) + dx, _at(box, 3) + dy)


def expand_boxes(boxes: Column, w: Column, h: Column) -> Column:
    """All boxes of an array."""
    return F.transform(boxes, lambda b: expand_box(b, w, h))


def expand_point(point: Column, w: Column, h: Column) -> Column:
    """A point in the padded square (G3); entries after the second stay."""
    dx, dy = square_offset(w, h)
    return F.concat(F.array(_at(point, 0) + dx, _at(point, 1) + dy), F.slice(point, 3, 10))


def expand_points(points: Column, w: Column, h: Column) -> Column:
    """All points or keypoints of an array."""
    return F.transform(points, lambda p: expand_point(p, w, h))


def normalize_box(box: Column, w: Column, h: Column) -> Column:
    """Two corners as parts of the size, clamped to 0..1, three digits."""
    return _box(*[rounded(_clamp(_ratio(_at(box, i), s)), 3) for i, s in enumerate((w, h, w, h))])


def normalize_center_box(box: Column, w: Column, h: Column) -> Column:
    """A centre-format box: to corners, normalised, and back."""
    return xyxy_to_center(normalize_box(center_to_xyxy(box, 3, w, h), w, h), 3)


def normalize_point(point: Column, w: Column, h: Column) -> Column:
    """A point as parts of the size, clamped, not rounded."""
    return _box(_clamp(_ratio(_at(point, 0), w)), _clamp(_ratio(_at(point, 1), h)))


def denormalize_box(box: Column, w: Column, h: Column) -> Column:
    """Parts of the size back to pixels."""
    return _box(*[_at(box, i) * s for i, s in enumerate((w, h, w, h))])


def denormalize_center_box(box: Column, w: Column, h: Column) -> Column:
    """A normalised centre-format box as corner pixels."""
    return denormalize_box(center_to_xyxy(box, 3), w, h)


def square_to_origin(box: Column, w: Column, h: Column) -> Column:
    """A box normalised to the padded square, in pixels of the original image, clamped to it (G13); square images too."""
    side = F.greatest(w, h).cast("double")
    dx, dy = square_offset(w, h)
    parts = [_at(box, i) * side - o for i, o in enumerate((dx, dy, dx, dy))]
    return _box(*[_clamp(p, s.cast("double")) for p, s in zip(parts, (w, h, w, h), strict=True)])


def square_center_to_origin(box: Column, w: Column, h: Column) -> Column:
    """The same for a centre-format box."""
    return square_to_origin(center_to_xyxy(box, 3), w, h)


def denormalize_keypoint(point: Column, w: Column, h: Column) -> Column:
    """A keypoint in whole pixels; zeros where it is not visible."""
    seen = _at(point, 2) != 0
    return F.when(seen.isNotNull(), F.array(F.when(seen, F.floor(_at(point, 0) * w)).otherwise(0).cast("double"), F.when(seen, F.floor(_at(point, 1) * h)).otherwise(0).cast("double"), _at(point, 2)))


def keypoint_square_to_origin(point: Column, w: Column, h: Column) -> Column:
    """A keypoint normalised to the padded square, in pixels of the original; a third entry stays."""
    side = F.greatest(w, h).cast("double")
    dx, dy = square_offset(w, h)
    x, y = _clamp(_at(point, 0) * side - dx, w.cast("double")), _clamp(_at(point, 1) * side - dy, h.cast("double"))
    return F.concat(F.array(x, y), F.slice(point, 3, 1))


def resize_box(box: Column, w: Column, h: Column, ratio: float = 0.3) -> Column:
    """A box in an image scaled by ``ratio``: normalised, then to the new size."""
    return denormalize_box(normalize_box(box, w, h), F.floor(w * ratio), F.floor(h * ratio))


def resize_longest(box: Column, w: Column, h: Column, target: int = 1024) -> Column:
    """Coordinates after the longest side is scaled to ``target`` (G31); sizes are rounded half up."""
    scale = F.lit(float(target)) / F.greatest(w, h)
    new_w, new_h = F.floor(w * scale + 0.5), F.floor(h * scale + 0.5)
    return _box(*[_at(box, i) * n / o for i, (n, o) in enumerate(((new_w, w), (new_h, h), (new_w, w), (new_h, h)))])


def area(box: Column) -> Column:
    """Area of an xyxy box, 0 for negative extents."""
    return F.greatest(_at(box, 2) - _at(box, 0), F.lit(0.0)) * F.greatest(_at(box, 3) - _at(box, 1), F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    """Common area of two xyxy boxes."""
    w = F.least(_at(a, 2), _at(b, 2)) - F.greatest(_at(a, 0), _at(b, 0))
    h = F.least(_at(a, 3), _at(b, 3)) - F.greatest(_at(a, 1), _at(b, 1))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Intersection over union of two xyxy boxes (G21, G24; G22 with ``epsilon=1e-6``); two empty boxes give 0."""
    inter = intersection(a, b)
    return F.when(_at(a, 3).isNotNull() & _at(b, 3).isNotNull(), F.coalesce(F.try_divide(inter, area(a) + area(b) - inter + F.lit(epsilon)), F.lit(0.0)))


def giou(a: Column, b: Column) -> Column:
    """Generalised intersection over union."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    hull = (F.greatest(_at(a, 2), _at(b, 2)) - F.least(_at(a, 0), _at(b, 0))) * (F.greatest(_at(a, 3), _at(b, 3)) - F.least(_at(a, 1), _at(b, 1)))
    return F.when(_at(a, 3).isNotNull() & _at(b, 3).isNotNull(), F.coalesce(F.try_divide(inter, union), F.lit(0.0)) - F.coalesce(F.try_divide(hull - union, hull), F.lit(0.0)))


def iou_matrix(a: Column, b: Column) -> Column:
    """Overlap of every box of one array with every box of another, for boxes of one image."""
    return F.transform(a, lambda x: F.transform(b, lambda y: iou(x, y)))


def keypoints_split(flat: Column) -> Column:
    """``x1 y1 x2 y2 … v1 v2 …`` to ``x1 y1 v1 x2 y2 v2 …``."""

    def body(f: Column) -> Column:
        k = (F.size(f) / 3).cast("int")
        return F.flatten(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.array(F.get(f, i * 2), F.get(f, i * 2 + 1), F.get(f, k * 2 + i))))

    return F.when(F.size(flat) >= 3, let(flat, body)).otherwise(flat)


def keypoints_join(flat: Column) -> Column:
    """The inverse layout."""

    def body(f: Column) -> Column:
        at = F.sequence(F.lit(0), (F.size(f) / 3).cast("int") - 1)
        return F.concat(F.flatten(F.transform(at, lambda i: F.array(F.get(f, i * 3), F.get(f, i * 3 + 1)))), F.transform(at, lambda i: F.get(f, i * 3 + 2)))

    return F.when(F.size(flat) >= 3, let(flat, body)).otherwise(flat)


def pose_row(points: Column, w: Column, h: Column) -> Column:
    """Keypoints of the padded square as one flat row ``x y v …`` of the original image."""
    return F.flatten(F.transform(points, lambda p: keypoint_square_to_origin(p, w, h)))


def oks(pred: Column, truth: Column, box_area: Column, sigmas: tuple[float, ...] = COCO_SIGMAS) -> Column:
    """Object keypoint similarity over the visible points of ``truth`` (X5); null without any."""
    sigma = F.array(*[F.lit(s) for s in sigmas])

    def term(pair: Column, i: Column) -> Column:
        d2 = F.pow(_at(pair["p"], 0) - _at(pair["t"], 0), 2) + F.pow(_at(pair["p"], 1) - _at(pair["t"], 1), 2)
        return F.when(_at(pair["t"], 2) > 0, F.exp(-d2 / (F.pow(F.get(sigma, i) * 2, 2) * 2 * F.greatest(box_area, F.lit(1e-9)))))

    pairs = F.zip_with(pred, truth, lambda p, t: F.struct(p.alias("p"), t.alias("t")))
    terms = F.filter(F.transform(pairs, term), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.size(terms).cast("double"))
