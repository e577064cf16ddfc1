"""Conversations compiled to rounds of prompt and answer text.

The input is an array of turns ``struct<role, value, boxes_seq>`` and one system
entry ``struct<task_name, element, use_unit, unit>`` per round. All of it stays in
arrays of one row, so compiling needs no shuffle.

Defined results: leading answers are dropped; questions that follow each other
are joined; a question without an answer at the end gives no round; null turns
are passed over, a null value is empty text; a different number of rounds and
system entries is for ``validation`` to set aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BOXES, IMAGE, REFERENCE, TASK_COMMAND, TASK_END, TASK_START, UNIT_END, UNIT_OF, UNIT_START, VISUAL_PROMPT
from ..functions import text as T
from ..functions.geometry import let


def human_text(value: Column) -> Column:
    """A question with its image mark moved to the front."""
    v = F.coalesce(value, F.lit(""))
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(F.contains(v, F.lit(IMAGE)), trim(F.concat(F.lit(IMAGE + "\n"), trim(F.replace(v, F.lit(IMAGE), F.lit("")))))).otherwise(v)


def rounds_of(turns: Column) -> Column:
    """``array<struct<input, output, seq>>`` from turns in order."""
    kind = "struct<rounds:array<struct<input:string,output:string,seq:array<array<int>>>>,open:string,begun:boolean>"
    start = F.struct(F.array().cast("array<struct<input:string,output:string,seq:array<array<int>>>>").alias("rounds"), F.lit("").alias("open"), F.lit(False).alias("begun")).cast(kind)

    def step(s: Column, t: Column) -> Column:
        human, answer = t["role"] == "human", (t["role"] == "gpt") & s["begun"]
        done = F.struct(s["open"].alias("input"), F.coalesce(t["value"], F.lit("")).alias("output"), t["boxes_seq"].alias("seq"))
        return F.struct(F.when(answer, F.concat(s["rounds"], F.array(done))).otherwise(s["rounds"]).alias("rounds"), F.when(answer, F.lit("")).when(human, F.concat(s["open"], human_text(t["value"]))).otherwise(s["open"]).alias("open"), (s["begun"] | human).alias("begun")).cast(kind)

    return F.aggregate(F.filter(turns, lambda t: t["role"].isNotNull()), start, step, lambda s: s["rounds"])


def system_text(entry: Column) -> Column:
    """The task command of one system entry (P15), null without one."""
    use = F.coalesce(entry["use_unit"], F.lit(False))
    element = F.when(use, F.concat(F.coalesce(entry["element"], F.array().cast("array<string>")), F.array(F.lit("unit")))).otherwise(F.coalesce(entry["element"], F.array().cast("array<string>")))
    unit = F.when(use, F.concat(F.lit("- unit: "), F.array_join(F.transform(entry["unit"], lambda u: F.concat(F.lit(UNIT_START), u, F.lit(UNIT_END))), ", "), F.lit("\n"))).otherwise(F.lit("- unit: None"))
    return F.when(entry.isNotNull(), F.concat(F.lit("Task Command:\n- task name: "), F.coalesce(entry["task_name"], F.lit("None")), F.lit("\n- answer element: "), F.array_join(element, ", "), F.lit("\n"), F.coalesce(unit, F.lit("- unit: None"))))


def thought(output: Column, placeholders: tuple[str, ...] = (BOXES,)) -> Column:
    """The task block before an answer: class names, units and numbers, or that there are none."""
    units = {p: UNIT_OF[p] for p in placeholders}
    name = lambda p: F.coalesce(*[F.when(p == k, F.lit(u)) for k, u in units.items()])
    found = F.filter(T.phrase_elements(output, placeholders), lambda e: e["n"] > 0)
    lines = F.array_join(F.transform(found, lambda e: F.concat(F.lit("- Name: "), e["phrase"], F.lit(" Unit: "), name(e["placeholder"]), F.lit(" Num: "), e["n"].cast("string"), F.lit("\n"))), "")
    any_unit = F.lit(False)
    for p in placeholders:
        any_unit = any_unit | F.contains(output, F.lit(p))
    return F.when(any_unit, F.concat(F.lit(TASK_START + "\nUnit decode (True). Class name, target unit and number:\n"), lines, F.lit(TASK_END + "\n"))).otherwise(F.lit(TASK_START + "\nUnit decode (False).\n" + TASK_END + "\n"))


def referenced(output: Column, seq: Column, placeholder: str = BOXES) -> Column:
    """Placeholders as references ``(<Unit>box</Unit>[0]<REF>[1]<REF>)`` by the sequences."""
    unit = F.lit("(" + UNIT_START + UNIT_OF[placeholder] + UNIT_END)
    marks = F.flatten(F.transform(seq, lambda s: F.transform(s, lambda _, i: F.concat(F.when(i == 0, unit).otherwise(F.lit("")), F.lit("["), i.cast("string"), F.lit("]" + REFERENCE), F.when(i == F.size(s) - 1, F.lit(")")).otherwise(F.lit(""))))))
    return F.when(F.coalesce(F.size(seq), F.lit(0)) > 0, T.splice(output, placeholder, marks)).otherwise(output)


def answer_text(output: Column, seq: Column, use_cot: bool = True) -> Column:
    """The whole answer: task block and referenced text; an empty answer stays empty."""
    body = referenced(output, seq)
    return F.when(F.coalesce(output, F.lit("")) == "", F.lit("")).otherwise(F.concat(thought(output), body) if use_cot else body)


def compiled(turns: Column, system: Column, use_cot: bool = True) -> Column:
    """``array<struct<input, output, system>>`` of a conversation."""
    return let(system, lambda e: F.transform(rounds_of(turns), lambda r, i: F.struct(F.replace(r["input"], F.lit(BOXES), F.lit(VISUAL_PROMPT)).alias("input"), answer_text(r["output"], r["seq"], use_cot).alias("output"), system_text(F.get(e, i)).alias("system"))))


def prompted(rounds: Column, template: dict[str, str] | None = None) -> Column:
    """Rounds as chat text (P18): prefix on the first, system text on each, instruction, separator."""
    t = template or TASK_COMMAND
    before, after = t["system"].split("{system}")
    left, right = t["instruction"].split("{input}")

    def one(r: Column, i: Column) -> Column:
        system = F.when(F.coalesce(r["system"], F.lit("")) != "", F.concat(F.lit(before), r["system"], F.lit(after))).otherwise(F.lit(""))
        prefix = F.when(i == 0, F.lit(t.get("prefix", ""))).otherwise(F.lit(""))
        return F.struct(F.concat(prefix, system, F.lit(left), F.coalesce(r["input"], F.lit("")), F.lit(right)).alias("input"), F.concat(r["output"], F.lit(t.get("suffix", ""))).alias("output"), F.lit(not t.get("suffix_as_eos")).alias("need_eos"), F.lit(t.get("sep", "")).alias("sep"))

    return F.transform(rounds, one)


def stage1_text(value: Column, boxes: Column, seq: Column, placeholder: str = BOXES) -> Column:
    """Placeholders as written numbers."""
    written = F.transform(T.lookup(boxes, seq), lambda rows: T.format_numbers(rows))
    return T.splice(value, placeholder, written)


def joined_conversations(conversations: Column) -> Column:
    """Several conversations as one; only the first question keeps the image mark."""
    flat = F.flatten(conversations)
    return F.transform(flat, lambda t, i: F.struct(t["role"].alias("role"), F.when((i > 0) & (t["role"] == "human"), F.replace(t["value"], F.lit(IMAGE), F.lit(""))).otherwise(t["value"]).alias("value"), t["boxes_seq"].alias("boxes_seq")))


def used_targets(boxes: Column, seqs: Column) -> Column:
    """Only the targets that sequences use, and the sequences renumbered (P22, P23): ``struct<boxes, seqs>``."""
    used = F.array_distinct(F.flatten(F.flatten(seqs)))
    return let(used, lambda u: F.struct(F.transform(u, lambda i: F.get(boxes, i)).alias("boxes"), F.transform(seqs, lambda a: F.transform(a, lambda b: F.transform(b, lambda i: (F.array_position(u, i) - 1).cast("int")))).alias("seqs")))


def deduplicated_boxes(boxes: Column) -> Column:
    """Distinct boxes in order and the place of each box among them (P26): ``struct<boxes, index>``."""
    return let(F.array_distinct(boxes), lambda d: F.struct(d.alias("boxes"), F.transform(boxes, lambda b: (F.array_position(d, b) - 1).cast("int")).alias("index")))


def session_windows(turns: DataFrame, limit: int) -> DataFrame:
    """Dialogue history per session (ST1): turns kept so that their lengths from the end stay within ``limit``.

    ``turns``: ``session``, ``pos``, ``value``. Adds ``used`` (length up to and
    including the turn since the last reset) and ``resets`` (times the history was
    dropped before). A fold over the ordered turns of a session.
    """
    kept = turns.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("pos", F.length(F.coalesce("value", F.lit(""))).alias("n")))).alias("t"))
    kind = "struct<out:array<struct<pos:bigint,used:bigint,resets:int>>,used:bigint,resets:int>"

    def step(s: Column, t: Column) -> Column:
        over = s["used"] + t["n"] > limit
        used, resets = F.when(over, t["n"]).otherwise(s["used"] + t["n"]), F.when(over & (s["used"] > 0), s["resets"] + 1).otherwise(s["resets"])
        return F.struct(F.concat(s["out"], F.array(F.struct(t["pos"].cast("bigint").alias("pos"), used.cast("bigint").alias("used"), resets.cast("int").alias("resets")))).alias("out"), used.cast("bigint").alias("used"), resets.cast("int").alias("resets")).cast(kind)

    start = F.struct(F.array().cast("array<struct<pos:bigint,used:bigint,resets:int>>").alias("out"), F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("resets")).cast(kind)
    return kept.select("session", F.inline(F.aggregate("t", start, step, lambda s: s["out"])))
