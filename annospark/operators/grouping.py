"""Instances grouped by class, and joins of annotation tables (AG27, AG28, J1-J19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BOXES, PHRASE_END, PHRASE_START


def class_groups(df: DataFrame, image: str, label: str, pos: str) -> DataFrame:
    """Per image and class the places of its instances, and the first of them (AG27).

    An image with very many instances is pre-aggregated per class before it comes
    together; the arrays hold places, not rows.
    """
    return df.groupBy(image, label).agg(F.min(pos).alias("first_pos"), F.sort_array(F.collect_list(pos)).alias("places"))


def detection_captions(df: DataFrame, image: str, label: str, pos: str, placeholder: str = BOXES) -> DataFrame:
    """``<Phrase>class</Phrase><boxes>…,`` per image, classes in order of first appearance, and the index lists (AG27, Z8)."""
    groups = class_groups(df, image, label, pos)
    phrase = F.concat(F.lit(PHRASE_START), label, F.lit(PHRASE_END), F.repeat(F.lit(placeholder), F.size("places")))
    whole = groups.groupBy(image).agg(F.sort_array(F.collect_list(F.struct("first_pos", phrase.alias("phrase"), "places"))).alias("g"))
    return whole.select(image, F.concat(F.array_join(F.transform("g", lambda g: g["phrase"]), ","), F.lit(".")).alias("caption"), F.transform("g", lambda g: g["places"]).alias("seq"))


def class_counts(df: DataFrame, image: str, label: str) -> DataFrame:
    """Instances per image and class (AG28)."""
    return df.groupBy(image, label).agg(F.count(F.lit(1)).alias("n"))


def first_contained(text: Column, names: Column) -> Column:
    """The first name that occurs in a text (J11), null if none does."""
    return F.get(F.filter(names, lambda n: F.contains(text, n)), F.lit(0))


def by_id(objects: Column, others: Column, key: Column) -> Column:
    """The object with an id, looked for in two arrays in turn."""
    return F.get(F.filter(F.concat(objects, others), lambda o: o["id"] == key), F.lit(0))


def scene_lookup(questions: DataFrame, scenes: DataFrame, key: str, ids: str, objects: str) -> DataFrame:
    """Objects of a scene graph by id for each question (J3, J4): a join on the scene, lookups in its map; a missing scene or id gives null."""
    joined = questions.join(scenes, key, "left")
    return joined.withColumn("found", F.transform(ids, lambda i: F.try_element_at(F.col(objects), i)))


def overlapping_names(train: Column, test: Column) -> Column:
    """Whether two lists of class names share any."""
    return F.arrays_overlap(train, test)


def indexed(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations with their image and category (J1, J2, S16-S18); the categories are broadcast where small enough."""
    return annotations.join(images, "image_id").join(categories, "category_id", "left")
