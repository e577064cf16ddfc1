"""Registered queries of the llm operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import leakage, mixing, mojibake, overlap, packing, pairs

Query = Callable[[SparkSession, str], DataFrame]


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text", "lang")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_rounds(table(spark, d, "samples", "sample_id", "conversations"), _labelled(spark, d))


def p1_defects(spark: SparkSession, d: str) -> DataFrame:
    """Every defect of every defective round, one row each."""
    found = pairs.round_defects(table(spark, d, "samples", "sample_id", "conversations"), _labelled(spark, d))
    return found.select("sample_id", "round_idx", F.posexplode("defects").alias("place", "defect"))


def p1_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Defective rounds per source and kind."""
    sources = table(spark, d, "samples", "sample_id", "source").dropDuplicates(["sample_id"])
    return p1_found(spark, d).join(sources, "sample_id").groupBy("source", "defect").agg(F.count(F.lit(1)).alias("n_rounds"))


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "images", "image_id", "file_name", "split", "source"), table(spark, d, "samples", "sample_id", "image", "split", "source")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(*_names(spark, d))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Pairs, evaluation records and pictures per split and source, counted from the classes."""
    return overlap.overlap_report(overlap.overlap_classes(*_names(spark, d)))


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Records with a partner: class, number of partners, part of the name that shared spans cover."""
    return overlap.coverage(*_names(spark, d))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(table(spark, d, "samples", "sample_id", "source", "system_tasks", "conversations"), table(spark, d, "mix_targets"))


def p3_mix_plan(spark: SparkSession, d: str) -> DataFrame:
    """How often each sample is taken into each mix."""
    return _mixed(spark, d)[0]


def p3_mix_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of each mix."""
    return _mixed(spark, d)[1]


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "pack_specs"))


def p5_packed(spark: SparkSession, d: str) -> DataFrame:
    """Container, place and share of every document under every spec."""
    return _packed(spark, d)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used and their fill."""
    return packing.pack_report(_packed(spark, d), table(spark, d, "pack_specs"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items and documents holding them, per benchmark and split."""
    items = table(spark, d, "eval_items", "item_id", "benchmark", "split")
    return _leaks(spark, d).join(items, "item_id").groupBy("benchmark", "split").agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct("doc_id").alias("n_docs"))


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, d, "documents", "doc_id", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("doc_id").distinct()


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    """The damaged documents with their restored text."""
    return _garbled(spark, d)


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_defects, p1_by_source, p2_found, p2_report, p2_coverage, p3_mix_plan, p3_mix_report, p5_packed, p5_report, p6_found, p6_report, p7_found, p7_restored)}

#: None of these operators is expressible in SQL; ``tests/llm`` holds them against brute force.
SQL: dict[str, str] = {}
