"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boxes, composed, corpus, dialogue, evaluation, ingest, nested, signals

_MODULES = (boxes, corpus, dialogue, evaluation, ingest, nested, signals, composed)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in _MODULES for name, text in getattr(m, "SQL", {}).items()}
