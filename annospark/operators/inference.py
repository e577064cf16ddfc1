"""The boundary to models, and what is done with their raw scores (M18, M24-M27, N1-N13, H5, AG33, AG34, R2-R4).

A model is a function from a pandas batch to a pandas batch, made once per worker.
Its weights, tokenizer and device are its own business; the engine only moves
Arrow batches. Pictures come as one row each with the scores of its queries.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import masks as M
from ..functions.geometry import let

Model = Callable[[pd.DataFrame], pd.DataFrame]
METRICS: dict[str, Callable[..., DataFrame]] = {}
MAPS: dict[str, Callable[..., DataFrame]] = {}


def metric(name: str) -> Callable:
    """Register a metric ``(predictions, targets, **options) -> DataFrame`` (R2, AG31)."""
    return lambda f: METRICS.setdefault(name, f)


def mapping(name: str) -> Callable:
    """Register a step ``DataFrame -> DataFrame`` (R3); ``pipeline`` calls it by name."""
    return lambda f: MAPS.setdefault(name, f)


def pipeline(df: DataFrame, steps: list[str | dict | Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Steps by name, by ``{"function": name, "args": {…}}`` or as functions, in order (R3, R4); unknown names fail before anything runs."""
    chosen = []
    for step in steps:
        name, args = (step["function"], step.get("args", {})) if isinstance(step, dict) else (step, {})
        if not callable(name) and name not in MAPS:
            raise KeyError(f"no step named {name}")
        chosen.append((MAPS[name] if not callable(name) else name, args))
    for f, args in chosen:
        df = f(df, **args)
    return df


def predict(df: DataFrame, make_model: Callable[[], Model], schema: str) -> DataFrame:
    """Run a model over Arrow batches (N1-N13, T29); it is made once per task, not once per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            yield model(pdf)

    return df.mapInPandas(run, schema)


def hash_encoder(size: int = 16) -> Callable[[], Model]:
    """A stand-in text encoder for tests (T29): hashed words as a unit vector; ``key`` and ``text`` to ``key`` and ``vector``."""

    def make() -> Model:
        def one(text: str | None) -> list[float]:
            v = np.zeros(size)
            for w in (text or "").lower().split():
                v[zlib.crc32(w.encode()) % size] += 1
            return (v / max(1e-12, np.linalg.norm(v))).tolist()

        return lambda pdf: pd.DataFrame({"key": pdf["key"], "vector": [one(t) for t in pdf["text"]]})

    return make


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def class_probabilities(scores: Column) -> Column:
    """Softmax of the class scores of a query."""
    return let(scores, lambda c: let(F.transform(c, lambda x: F.exp(x - F.array_max(c))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))))


def query_rows(df: DataFrame) -> DataFrame:
    """One row per query of each picture: ``image_id``, ``h``, ``w``, ``query``, ``classes`` (scores, the last for no object), ``mask`` (a score per pixel, row by row)."""
    return df.select("image_id", "h", "w", F.posexplode(F.arrays_zip(F.col("classes").alias("c"), F.col("masks").alias("m"))).alias("query", "q")).select("image_id", "h", "w", "query", F.col("q.c").alias("classes"), F.col("q.m").alias("mask"))


def pixel_rows(queries: DataFrame, *keep: str) -> DataFrame:
    """One row per query and pixel: ``image_id``, ``query``, ``pixel``, ``p`` (probability that the pixel is the query's) and the columns to keep."""
    return queries.select("image_id", "query", *keep, F.posexplode("mask").alias("pixel", "x")).select("image_id", "query", *keep, "pixel", _logistic(F.col("x")).alias("p"))


def semantic_labels(df: DataFrame) -> DataFrame:
    """The likeliest class of each pixel (M24): ``image_id``, ``pixel``, ``category_id``, ``score``.

    A class scores the sum over queries of the query's probability for it, no
    object aside, times its probability for the pixel. Sums are compared to nine
    digits, so the order of adding up decides nothing; ties go to the smaller class.
    """
    q = query_rows(df).withColumn("prob", class_probabilities(F.col("classes")))
    one = pixel_rows(q, "prob").select("image_id", "pixel", "p", F.posexplode(F.slice("prob", 1, F.greatest(F.size("prob") - 1, F.lit(0)))).alias("category_id", "c"))
    summed = one.groupBy("image_id", "pixel", "category_id").agg(F.sum(F.col("p") * F.col("c")).alias("score"))
    return summed.groupBy("image_id", "pixel").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("category_id")).alias("c"))).alias("m")).select("image_id", "pixel", (-F.col("m.c")).alias("category_id"), F.col("m.score").alias("score"))


def panoptic_segments(df: DataFrame, things: list[int], overlap: float = 0.8) -> DataFrame:
    """Segments that share no pixel (M25): ``image_id``, ``segment`` (first query of it), ``category_id``, ``thing``, ``pixels`` (sorted).

    Every pixel is won by the query with the greatest product of class and pixel
    probability (ties: the first query); queries whose likeliest class is no object
    take no part. A query keeps the pixels it won and fills, and is dropped when
    those it won are less than ``overlap`` of those it fills. Queries of one class
    that is no thing are one segment. All of it is joins of aggregates over
    (picture, query, pixel) rows, so no picture has to fit a task.
    """
    q = query_rows(df).withColumn("best", F.array_max("classes"))
    q = q.withColumn("category_id", F.array_position("classes", F.col("best")) - 1).where(F.col("category_id") < F.size("classes") - 1).withColumn("score", _logistic(F.col("best")))
    rows = pixel_rows(q, "category_id", "score")
    winner = rows.groupBy("image_id", "pixel").agg(F.max(F.struct((F.col("score") * F.col("p")).alias("v"), (-F.col("query")).alias("q"), "category_id", (F.col("p") >= 0.5).alias("fills"))).alias("w"))
    won = winner.select("image_id", "pixel", (-F.col("w.q")).alias("query"), "w.category_id", "w.fills")
    filled = rows.where("p >= 0.5").groupBy("image_id", "query").agg(F.count(F.lit(1)).alias("n_filled"))
    kept = won.groupBy("image_id", "query").agg(F.count(F.lit(1)).alias("n_won"), F.max("fills").alias("some")).join(filled, ["image_id", "query"]).where(F.col("some") & (F.col("n_won") / F.col("n_filled") >= overlap)).select("image_id", "query")
    thing = F.col("category_id").isin(*things) if things else F.lit(False)
    mine = won.where("fills").join(kept, ["image_id", "query"]).withColumn("thing", thing)
    grouped = mine.groupBy("image_id", "category_id", "thing", F.when(F.col("thing"), F.col("query")).alias("__own")).agg(F.min("query").alias("segment"), F.sort_array(F.collect_list("pixel")).alias("pixels"))
    return grouped.select("image_id", "segment", "category_id", "thing", "pixels")


def instance_rows(df: DataFrame, things: list[int], most: int = 100) -> DataFrame:
    """Instances of each picture (M26, L12, S40): ``image_id``, ``query``, ``category_id``, ``score``, ``counts``.

    The ``most`` best pairs of a query and a class, by the class's probability, ties
    by query and class; of those, things, their score weighted by the mean
    probability of the pixels in the mask.
    """
    q = query_rows(df)
    pairs = q.select("image_id", "query", F.posexplode("classes").alias("category_id", "x")).select("image_id", "query", "category_id", _logistic(F.col("x")).alias("score"))
    ranked = pairs.withColumn("__r", F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("score").desc(), "query", "category_id"))).where(F.col("__r") <= most)
    best = ranked.where(F.col("category_id").isin(*things) if things else F.lit(False)).drop("__r")
    inside = F.filter("mask", lambda x: x > 0)
    mean = F.aggregate(inside, F.lit(0.0), lambda s, x: s + _logistic(x)) / (F.size(inside) + 1e-6)
    # the run lengths go column by column, the scores row by row
    column = F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda k: F.when(F.get("mask", (k % F.col("h")) * F.col("w") + F.floor(k / F.col("h")).cast("int")) > 0, 1).otherwise(0))
    shapes = q.select("image_id", "query", mean.alias("inside"), M.from_pixels(column, F.col("h"), F.col("w"))["counts"].alias("counts"))
    return best.join(shapes, ["image_id", "query"]).select("image_id", "query", "category_id", (F.col("score") * F.col("inside")).alias("score"), "counts")


def prompt_masks(boxes: Column, w: Column, h: Column, most: int) -> Column:
    """Box prompts as masks, at most so many."""
    return F.transform(F.slice(boxes, 1, most), lambda b: M.box_mask(b, w, h))


def stroke_box(before: np.ndarray, after: np.ndarray, least: int = 5) -> list[int] | None:
    """Box around the pixels a brush changed (M23); None for strokes of at most ``least`` pixels."""
    ys, xs = np.nonzero(before != after)
    return [int(xs.min()), int(ys.min()), int(xs.max()), int(ys.max())] if len(xs) > least else None


def top_k_correct(scores: Column, label: Column, k: int) -> Column:
    """Whether the label is among the ``k`` best of ``array<struct<score, label>>`` (AG33); ties by label."""
    best = F.slice(F.array_sort(F.transform(scores, lambda s: F.struct((-s["score"]).alias("s"), s["label"].alias("l")))), 1, k)
    return F.exists(best, lambda b: b["l"] == label)


def cardinality_error(scores: Column, n_truth: Column, least: float = 0.5) -> Column:
    """Difference of the number of confident predictions and of targets (AG34)."""
    return F.abs(F.size(F.filter(scores, lambda s: s > least)) - n_truth)


def global_matches(pairs: Column, top_labels: Column) -> Column:
    """For each prediction the best-overlapping target whose class is among the prediction's best classes (H5).

    ``pairs``: ``array<struct<i, j, iou, label>>``; ``top_labels``: map of ``i`` to labels.
    """
    good = F.filter(pairs, lambda p: F.array_contains(F.try_element_at(top_labels, p["i"]), p["label"]))
    ids = F.array_distinct(F.transform(good, lambda p: p["i"]))
    return F.transform(ids, lambda i: F.array_sort(F.transform(F.filter(good, lambda p: p["i"] == i), lambda p: F.struct((-p["iou"]).alias("s"), p["i"].alias("i"), p["j"].alias("j"))))[0])
