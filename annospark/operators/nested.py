"""Deeply nested JSON records as flat, linked tables, by Merkle subtree identities.

Every object of a payload is written in canonical form (keys sorted, numbers and
strings as JSON) and hashed bottom-up: its identity covers its own scalar fields
and the identities and places of everything below it. Equal objects have equal
identities, so each is stored once, however many records hold it; where it occurs
is kept by bridge rows.

* ``roots``: one row per record, the identity of its payload.
* ``nodes``: one row per distinct object: identity, scalar fields as JSON, the
  names of all its fields.
* ``edges``: one row per distinct parent and child place: field, shape, ordinal,
  the child's identity or the scalar in that place. Places count from 0 in the
  stored arrays; nulls keep theirs.

The tables hold all that the payloads hold; ``rebuild`` turns them back. Typed
tables (records, turns, task entries, units) are joins of them.

A part may be stored as JSON text inside a string (the value of a system turn);
it is read like the part itself and its shape says so.

Defined results: payloads that are null, blank, cut off or not an object are no
record and are listed by ``rejects``; a repeated key counts once (the payload of
the smallest ``loaded_at``, then the smallest identity); numbers keep their
written value; of a key given twice in one object the last counts, as in JSON
readers; payloads nested deeper than ``DEPTH`` are rejected, and text that holds
deeper JSON stays text.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import skew_join, stored

#: Deepest nesting that is read.
DEPTH = 500
#: Rows of one object that meet one copy of its children in a join.
HOT = 100_000
#: Identities a worker remembers so as to write each object once; beyond it they are written again and removed later.
REMEMBER = 200_000

_TYPES = {
    "kind": pa.string(), "raw_id": pa.int64(), "loaded_at": pa.timestamp("us"), "node": pa.binary(), "parent": pa.binary(), "field": pa.string(), "shape": pa.string(), "ordinal": pa.int32(), "child": pa.binary(), "system": pa.bool_(), "entry": pa.bool_(),
    "scalar": pa.string(), "content": pa.string(), "fields": pa.list_(pa.string()), "role": pa.string(), "has_task": pa.bool_(), "has_unit": pa.bool_(),
}
ROWS = "kind string, raw_id long, loaded_at timestamp_ntz, node binary, parent binary, field string, shape string, ordinal int, child binary, system boolean, entry boolean, scalar string, content string, fields array<string>, role string, has_task boolean, has_unit boolean"
_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S)


def _too_deep(text: str) -> bool:
    """Whether JSON text nests deeper than ``DEPTH``; brackets in its strings do not count."""
    if text.count("[") + text.count("{") <= DEPTH:
        return False
    depth = 0
    for m in _BRACKETS.finditer(text):
        if m.group() in "[{":
            depth += 1
            if depth > DEPTH:
                return True
        elif m.group() in "]}":
            depth -= 1
    return False


#: Canonical JSON: keys sorted, no blanks.
_dump = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode
_NUMBERS = {int, float}


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def read_payload(text: str | None) -> dict | None:
    """The payload as an object, or None where it is no whole JSON object."""
    if not text or not text.strip() or _too_deep(text):
        return None
    try:
        value = json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _leaf(value: object) -> bool:
    """What stays inside its parent: scalars, null, empty arrays, and arrays of numbers (coordinates)."""
    if isinstance(value, dict):
        return False
    if isinstance(value, list):
        return all(type(x) in _NUMBERS for x in value)
    return True


def _embedded(value: object) -> object | None:
    """The array or object written as text in a string, or None."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{") and not _too_deep(value):
        try:
            inner = json.loads(value, parse_constant=_refuse)
        except (ValueError, RecursionError):
            return None
        if isinstance(inner, dict | list):
            return inner
    return None


class _Store:
    """Rows of the objects met; each identity once as long as it is remembered."""

    def __init__(self) -> None:
        self.roots: list[tuple] = []
        self.nodes: list[tuple] = []
        self.edges: list[tuple] = []
        self.seen: set[bytes] = set()

    def node(self, value: dict) -> bytes:
        content, fields, edges = {}, sorted(value), []
        system = value.get("from") == "system"
        for field in fields:
            part = value[field]
            inner = _embedded(part) if system and field == "value" else None
            if inner is not None:
                edges += self.parts(field, inner, "text-")
            elif _leaf(part):
                content[field] = part
            else:
                edges += self.parts(field, part, "")
        text = _dump(content)
        below = [text]
        for field, shape, ordinal, child, scalar, _, _ in edges:
            # identities as characters of one byte each; nothing else is as long as its mark says
            below.append(f"{len(field)} {field} {shape} {ordinal} {'-' + (scalar or '') if child is None else '+' + child.decode('latin-1')}")
        key = hashlib.blake2b("".join(below).encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key not in self.seen:
            if len(self.seen) >= REMEMBER:
                self.seen.clear()
            self.seen.add(key)
            role = value.get("from")
            self.nodes.append((key, text, fields, role if isinstance(role, str) else None, "task" in value, "unit" in value))
            # an entry lies in the value of a system turn
            self.edges += [(key, *e[:6], system and e[0] == "value" and e[6]) for e in edges]
        return key

    def parts(self, field: str, value: object, prefix: str) -> list[tuple]:
        """Places of a field: field, shape, ordinal, child, scalar, whether the child is a system turn, and whether it has a task or a unit."""
        if isinstance(value, dict):
            return [(field, prefix + "object", 0, *self.place(value))]
        if isinstance(value, list):
            if not value:
                return [(field, prefix + "empty", 0, None, None, False, False)]
            return [(field, prefix + "array", i, *self.place(x)) for i, x in enumerate(value)]
        return [(field, prefix + "scalar", 0, None, _dump(value), False, False)]

    def place(self, value: object) -> tuple[bytes | None, str | None, bool, bool]:
        if isinstance(value, dict):
            return self.node(value), None, value.get("from") == "system", "task" in value or "unit" in value
        if _leaf(value):
            return None, _dump(value), False, False
        return self.node({"": value}), None, False, False  # an array within an array

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The rows so far, one batch of each kind."""
        for kind, rows, names in (
            (None, self.roots, ("kind", "raw_id", "loaded_at", "node")),
            ("node", self.nodes, ("node", "content", "fields", "role", "has_task", "has_unit")),
            ("edge", self.edges, ("parent", "field", "shape", "ordinal", "child", "scalar", "system", "entry")),
        ):
            if not rows:
                continue
            columns = dict(zip(names, zip(*rows, strict=True), strict=True))
            if kind:
                columns["kind"] = [kind] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(len(rows), t) for c, t in _TYPES.items()], list(_TYPES))
            rows.clear()


def _hash_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # an object takes up to three calls a level, and text within a payload may be as deep as the payload
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEPTH * 10))
    store = _Store()
    for batch in batches:
        for raw_id, loaded, payload in zip(batch.column("raw_id").to_pylist(), batch.column("loaded_at").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            value = read_payload(payload)
            store.roots.append(("reject", raw_id, loaded, None) if value is None else ("root", raw_id, loaded, store.node(value)))
        yield from store.batches()


class FlatTables:
    """The three linked tables of nested records, and the typed tables made of them."""

    def __init__(self, raw: DataFrame):
        rows = raw.select(F.col("raw_id").cast("long").alias("raw_id"), F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"), F.col("payload").cast("string").alias("payload")).where("raw_id is not null")
        self._all = rows.mapInArrow(_hash_trees, ROWS)

    def materialised(self) -> FlatTables:
        """The same, with the hashed rows written once, by kind; for several tables of one corpus."""
        self._all = stored(self._all, "kind")
        return self

    @property
    def roots(self) -> DataFrame:
        found = self._all.where("kind in ('root', 'reject')").groupBy("raw_id").agg(F.min(F.struct(F.col("node").isNull().alias("broken"), "loaded_at", "node")).alias("first"))
        return found.where("first.node is not null").select("raw_id", F.col("first.node").alias("node"))

    @property
    def rejects(self) -> DataFrame:
        """Keys none of whose payloads is a whole JSON object."""
        return self._all.where("kind in ('root', 'reject')").groupBy("raw_id").agg(F.max(F.col("node").isNotNull()).alias("ok")).where("not ok").select("raw_id")

    # An identity fixes all that its rows hold, so whole rows can be made distinct, which is cheaper than keeping the first of each key.

    @property
    def nodes(self) -> DataFrame:
        return self._nodes("true", "node", "content", "fields", "role", "has_task", "has_unit")

    @property
    def edges(self) -> DataFrame:
        return self._edges("true", "parent", "field", "shape", "ordinal", "child", "scalar")

    def _nodes(self, condition: str, *columns: Column | str) -> DataFrame:
        return self._all.where("kind = 'node'").where(condition).select(*columns).distinct()

    def _edges(self, condition: str, *columns: Column | str) -> DataFrame:
        return self._all.where("kind = 'edge'").where(condition).select(*columns).distinct()

    def turns(self) -> DataFrame:
        """``raw_id``, ``turn_idx``, ``node``, ``role``, ``value`` of every turn that is an object."""
        places = self._edges("field = 'conversations' and child is not null", F.col("parent").alias("node"), F.col("ordinal").alias("turn_idx"), F.col("child"))
        kinds = self._nodes("true", F.col("node").alias("child"), "role", F.get_json_object("content", "$.value").alias("value"))
        where = skew_join(self.roots, places, "node", "raw_id", HOT).select("raw_id", "turn_idx", "child")
        return skew_join(where, kinds, "child", "raw_id", HOT).select("raw_id", "turn_idx", F.col("child").alias("node"), "role", "value")

    def _entries(self) -> DataFrame:
        """``turn``, ``task_idx``, ``entry`` of the distinct system turns."""
        direct = self._nodes("role = 'system' and (has_task or has_unit)", F.col("node").alias("turn"), F.lit(0).alias("task_idx"), F.col("node").alias("entry"))
        inside = self._edges("entry", F.col("parent").alias("turn"), F.col("ordinal").alias("task_idx"), F.col("child").alias("entry"))
        return direct.unionByName(inside)

    def _units(self) -> DataFrame:
        """``turn``, ``task_idx``, ``entry``, ``unit_idx``, ``unit`` of the distinct system turns; -1 for an entry without unit."""
        listed = self._edges("field = 'unit' and (child is not null or scalar <> 'null')", F.col("parent").alias("entry"), F.col("ordinal").alias("unit_idx"), F.coalesce(F.lower(F.hex("child")), F.get_json_object(F.concat(F.lit('{"u":'), "scalar", F.lit("}")), "$.u")).alias("unit"))
        bare = self._nodes("has_unit", F.col("node").alias("entry"), F.lit(0).alias("unit_idx"), F.get_json_object("content", "$.unit").alias("unit")).where("unit is not null and unit <> '[]'")
        units = listed.unionByName(bare)
        return self._entries().join(units, "entry", "left").select("turn", "task_idx", "entry", F.coalesce("unit_idx", F.lit(-1)).alias("unit_idx"), "unit")

    def task_entries(self) -> DataFrame:
        """``raw_id``, ``turn_idx``, ``task_idx``, ``entry``, ``task_name``, ``use_unit`` of every task entry."""
        where = self.turn_places()
        places = self._edges("field = 'task' and child is not null", F.col("parent").alias("entry"), F.col("ordinal").alias("at"), F.col("child").alias("node"))
        named_tasks = self._nodes("true", "node", F.get_json_object("content", "$.task_name").alias("task_name"), F.get_json_object("content", "$.use_unit").alias("use_unit"))
        task = places.where("at = 0").drop("at").join(named_tasks, "node").drop("node")
        named = self._entries().join(task, "entry", "left")
        return skew_join(where, named, "turn", "raw_id", HOT).select("raw_id", "turn_idx", "task_idx", "entry", "task_name", "use_unit")

    def turn_places(self) -> DataFrame:
        """``raw_id``, ``turn_idx``, ``turn``: where each distinct system turn occurs."""
        places = self._edges("field = 'conversations' and system", F.col("parent").alias("node"), F.col("ordinal").alias("turn_idx"), F.col("child").alias("turn"))
        return skew_join(self.roots, places, "node", "raw_id", HOT).select("raw_id", "turn_idx", "turn")

    def unit_rows(self) -> DataFrame:
        """``raw_id``, ``turn_idx``, ``task_idx``, ``unit_idx``, ``unit`` of every unit of the system turns' task entries."""
        return skew_join(self.turn_places(), self._units(), "turn", "raw_id", HOT).select("raw_id", F.col("turn_idx").cast("int").alias("turn_idx"), F.col("task_idx").cast("int").alias("task_idx"), F.col("unit_idx").cast("int").alias("unit_idx"), "unit")


def rebuild(node: bytes, nodes: dict[bytes, str], edges: dict[bytes, list[tuple]]) -> dict:
    """A payload from its rows; ``nodes``: identity to content, ``edges``: parent to (field, shape, ordinal, child, scalar)."""
    value = json.loads(nodes[node])
    fields: dict[str, list[tuple]] = {}
    for field, shape, ordinal, child, scalar in edges.get(node, []):
        fields.setdefault(field, []).append((ordinal, shape, child, scalar))
    for field, parts in fields.items():
        parts.sort()
        shape = parts[0][1]
        items = []
        for _, _, child, scalar in parts:
            if child is None:
                items.append(None if scalar is None else json.loads(scalar))
            else:
                item = rebuild(child, nodes, edges)
                items.append(item[""] if set(item) == {""} else item)
        whole = [] if shape.endswith("empty") else items if shape.endswith("array") else items[0]
        value[field] = json.dumps(whole, ensure_ascii=False) if shape.startswith("text-") else whole
    return value
