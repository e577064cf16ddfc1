"""Data contracts: good rows on one side, bad rows with a reason on the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BOXES, POINTS
from ..functions import geometry as G
from ..functions import text as T


def point_encoding_ok(point: Column) -> Column:
    """Two numbers, or four of which the last two are negative (F2)."""
    return F.coalesce((F.size(point) == 2) | ((F.size(point) == 4) & (F.get(point, F.lit(2)) < 0) & (F.get(point, F.lit(3)) < 0)), F.lit(False))


def slots_ok(template: Column, slots: tuple[str, ...]) -> Column:
    """Every slot exactly once."""
    ok = F.lit(True)
    for s in slots:
        ok = ok & (T.count_of(template, s) == 1)
    return F.coalesce(ok, F.lit(False))


def placeholders_match(value: Column, seq: Column, placeholder: str = BOXES) -> Column:
    """As many placeholders as targets."""
    return F.coalesce(T.count_of(value, placeholder), F.lit(0)) == F.coalesce(F.size(F.flatten(seq)), F.lit(0))


def one_unit(system: Column) -> Column:
    """All entries of a sample that name a unit name the same one (F8)."""
    units = F.flatten(F.transform(system, lambda e: F.coalesce(e["unit"], F.array().cast("array<string>"))))
    return F.coalesce(F.size(F.array_distinct(F.filter(units, lambda u: u.isNotNull()))) <= 1, F.lit(True))


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails, null if none does; a null check fails."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks])


def split(df: DataFrame, checks: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the others with ``reason`` (F1-F8)."""
    marked = df.withColumn("reason", first_reason(checks))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def sample_checks() -> list[tuple[str, Column]]:
    """Contracts of a conversation row with ``turns``, ``system`` and ``boxes``."""
    from .conversation import rounds_of

    turns = F.col("turns")
    return [
        ("no turns", F.coalesce(F.size(turns), F.lit(0)) >= 2),
        ("bad box", F.coalesce(F.forall(F.col("boxes"), G.valid_box), F.lit(True))),
        ("placeholders", F.forall(turns, lambda t: placeholders_match(t["value"], t["boxes_seq"]))),
        ("index", F.forall(turns, lambda t: F.coalesce(F.forall(F.flatten(t["boxes_seq"]), lambda i: (i >= 0) & (i < F.coalesce(F.size(F.col("boxes")), F.lit(0)))), F.lit(True)))),
        ("system entries", F.coalesce(F.size("system"), F.lit(0)) == F.size(rounds_of(turns))),
        ("units", one_unit(F.col("system"))),
    ]


def without_leading_answer(turns: Column) -> Column:
    """Turns from the first question on."""
    at = F.array_position(F.transform(turns, lambda t: t["role"] == "human"), True)
    return F.when(at > 0, F.slice(turns, at.cast("int"), F.greatest(F.size(turns), F.lit(1)))).otherwise(F.slice(turns, 1, 0))


def nested_phrase_ok(text: Column) -> Column:
    """No phrase holds a placeholder."""
    return ~F.exists(F.regexp_extract_all(text, F.lit(r"(?s)<Phrase>(.*?)</Phrase>"), F.lit(1)), lambda c: F.contains(c, F.lit("<masks>")) | F.contains(c, F.lit(BOXES)) | F.contains(c, F.lit(POINTS)))


def common_keys(*tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each table restricted to the keys all of them have (F16, J16, U6), by semi joins on distinct keys."""
    keys = None
    for df, key in tables:
        one = df.select(F.col(key).alias("__key")).distinct()
        keys = one if keys is None else keys.join(one, "__key", "left_semi")
    return [df.join(keys, df[key] == keys["__key"], "left_semi") for df, key in tables]


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once and how often."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
