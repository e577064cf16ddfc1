"""Queries of the nested-record operator (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nested import FlatTables
from ..runtime import table


def _tables(spark: SparkSession, d: str) -> FlatTables:
    return FlatTables(table(spark, d, "raw_records", "raw_id", "loaded_at", "payload")).materialised()


def _named(df: DataFrame, *identities: str) -> DataFrame:
    """Identities as text."""
    return df.withColumns({c: F.lower(F.hex(c)) for c in identities})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).unit_rows().select("raw_id", "turn_idx", "task_idx", "unit_idx")


def p4_objects(spark: SparkSession, d: str) -> DataFrame:
    """The distinct objects, each with its identity."""
    return _named(_tables(spark, d).nodes, "node").select("node", "content", "fields", "role", "has_task", "has_unit")


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Bridge rows: the places of children in their parents."""
    return _named(_tables(spark, d).edges, "parent", "child")


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per readable record with the identity of its payload."""
    return _named(_tables(spark, d).roots, "node")


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns with the key of their record."""
    return _named(_tables(spark, d).turns(), "node")


def p4_task_entries(spark: SparkSession, d: str) -> DataFrame:
    """Task entries with the keys of record and turn."""
    return _named(_tables(spark, d).task_entries(), "entry")


def p4_units(spark: SparkSession, d: str) -> DataFrame:
    """Units with the keys of record, turn and task entry."""
    return _tables(spark, d).unit_rows()


def p4_sharing(spark: SparkSession, d: str) -> DataFrame:
    """How far identities save storage: places and distinct objects per field."""
    edges = _tables(spark, d).edges
    return edges.where("child is not null").groupBy("field").agg(F.count(F.lit(1)).alias("n_places"), F.countDistinct("child").alias("n_objects"))


QUERIES = {f.__name__: f for f in (p4_found, p4_objects, p4_links, p4_records, p4_turns, p4_task_entries, p4_units, p4_sharing)}

_UNITS = """with r_ as (select raw_id, payload from (select *, row_number() over (partition by raw_id order by loaded_at) as rn_ from raw_records) where rn_ = 1),
        o_ as (select raw_id, cast(payload as json) as j from r_ where json_valid(payload) and json_type(payload) = 'OBJECT'),
        c_ as (select raw_id, json_extract(j, '$.conversations') as c from o_), i_ as (select raw_id, c, cast(unnest(range(0, case when json_type(c) = 'ARRAY' then cast(json_array_length(c) as bigint) else 0 end)) as int) as turn_idx from c_),
        t_ as (select raw_id, turn_idx, json_extract(c, '$[' || turn_idx || ']') as t from i_ union all select raw_id, 0, c from c_ where json_type(c) = 'OBJECT'),
        s_ as (select raw_id, turn_idx, t, case when json_type(t, '$.value') = 'VARCHAR' then case when json_valid(json_extract_string(t, '$.value')) then cast(json_extract_string(t, '$.value') as json) end else json_extract(t, '$.value') end as v from t_ where json_type(t) = 'OBJECT' and json_extract_string(t, '$.from') = 'system'),
        n_ as (select raw_id, turn_idx, v, cast(unnest(range(0, case when json_type(v) = 'ARRAY' then cast(json_array_length(v) as bigint) else 0 end)) as int) as task_idx from s_),
        e_ as (select raw_id, turn_idx, task_idx, json_extract(v, '$[' || task_idx || ']') as e from n_ union all select raw_id, turn_idx, 0, v from s_ where json_type(v) = 'OBJECT' union all select raw_id, turn_idx, 0, t from s_),
        k_ as (select raw_id, turn_idx, task_idx, json_extract(e, '$.unit') as u from e_ where json_type(e) = 'OBJECT' and (json_exists(e, '$.task') or json_exists(e, '$.unit'))),
        u_ as (select raw_id, turn_idx, task_idx, case when json_type(u) = 'ARRAY' then list_filter(range(0, cast(json_array_length(u) as bigint)), lambda x: json_type(u, '$[' || x || ']') <> 'NULL') when u is null or json_type(u) = 'NULL' then [] else [0] end as p, u from k_),
        f_ as (select raw_id, turn_idx, task_idx, u, cast(unnest(case when len(p) = 0 then [-1] else p end) as int) as unit_idx from u_)"""

SQL = {
    "p4_found": f"{_UNITS} select raw_id, turn_idx, task_idx, unit_idx from f_",
    "p4_units": f"{_UNITS} select raw_id, turn_idx, task_idx, unit_idx, case when unit_idx < 0 then null when json_type(u) = 'ARRAY' then json_extract_string(u, '$[' || unit_idx || ']') else json_extract_string(u, '$') end as unit from f_",
}
