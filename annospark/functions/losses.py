"""Losses as functions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import IGNORE
from . import geometry as G


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    """Logistic function."""
    return 1 / (1 + F.exp(-x))


def box_l1(pred: Column, truth: Column) -> Column:
    """Sum of absolute differences of two boxes."""
    return _sum(F.zip_with(pred, truth, lambda p, t: F.abs(p - t)))


def box_giou(pred: Column, truth: Column) -> Column:
    """One minus generalised overlap."""
    return 1 - G.giou(pred, truth)


def dice(logits: Column, labels: Column, valid: Column) -> Column:
    """Dice loss of one mask over its valid pixels, with one added to both sides."""
    p = F.zip_with(F.transform(logits, sigmoid), valid, lambda x, v: x * v)
    t = F.zip_with(labels, valid, lambda x, v: x * v)
    return 1 - (2 * _sum(F.zip_with(p, t, lambda x, y: x * y)) + 1) / (_sum(p) + _sum(t) + 1)


def cross_entropy(logit: Column, label: Column) -> Column:
    """Binary cross entropy of a logit, stable for large values."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def focal_term(logit: Column, label: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Focal loss of one logit."""
    p = sigmoid(logit)
    right = p * label + (1 - p) * (1 - label)
    return cross_entropy(logit, label) * F.pow(1 - right, F.lit(gamma)) * (F.lit(alpha) * label + F.lit(1 - alpha) * (1 - label))


def focal(logits: Column, labels: Column, valid: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Mean focal loss of one mask over its valid pixels."""
    terms = F.zip_with(logits, labels, lambda x, y: focal_term(x, y, alpha, gamma))
    return F.try_divide(_sum(F.zip_with(terms, valid, lambda x, v: x * v)), _sum(F.transform(valid, lambda v: v.cast("double"))))


def mask_loss(logits: Column, labels: Column, valid: Column) -> Column:
    """Focal and dice together."""
    return focal(logits, labels, valid) + dice(logits, labels, valid)


def keypoint_distance(pred: Column, truth: Column) -> Column:
    """Mean distance of points (X5 as reported), null without any."""
    d = F.zip_with(pred, truth, lambda p, t: F.sqrt(F.pow(F.get(p, F.lit(0)) - F.get(t, F.lit(0)), 2) + F.pow(F.get(p, F.lit(1)) - F.get(t, F.lit(1)), 2)))
    return F.try_divide(_sum(d), F.size(d).cast("double"))


def oks_loss(pred: Column, truth: Column, area: Column) -> Column:
    """One minus object keypoint similarity, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - G.oks(pred, truth, area)))


def keypoint_l1(pred: Column, truth: Column) -> Column:
    """Absolute differences over visible points."""
    return _sum(F.zip_with(pred, truth, lambda p, t: F.when(F.get(t, F.lit(2)) > 0, F.abs(F.get(p, F.lit(0)) - F.get(t, F.lit(0))) + F.abs(F.get(p, F.lit(1)) - F.get(t, F.lit(1)))).otherwise(0.0)))


def visibility_focal(logits: Column, truth: Column) -> Column:
    """Focal loss of two logits per point, unseen against seen."""
    return _sum(F.zip_with(logits, truth, lambda z, t: focal_term(F.get(z, F.lit(0)), F.when(F.get(t, F.lit(2)) == 0, 1.0).otherwise(0.0)) + focal_term(F.get(z, F.lit(1)), F.when(F.get(t, F.lit(2)) == 0, 0.0).otherwise(1.0))))


def language_loss(logprobs: Column, labels: Column) -> Column:
    """Mean negative log probability of learned tokens (X8), null without any; ``logprobs[i]`` predicts ``labels[i + 1]``."""
    terms = F.filter(F.transform(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), lambda y, i: F.when(y != IGNORE, -F.get(logprobs, i))), lambda x: x.isNotNull())
    return F.try_divide(_sum(terms), F.size(terms).cast("double"))


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum (X9); a missing weight is 1, a null part 0."""
    out = F.lit(0.0)
    for name, part in parts.items():
        out = out + F.coalesce(part, F.lit(0.0)) * weights.get(name, 1.0)
    return out
