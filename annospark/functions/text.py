"""Text mark-up as column expressions: placeholders, phrases, answers, tags.

Nulls give null; a pattern that does not occur gives an empty array or the text
as it is. Nothing here calls Python per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BOXES, PHRASE_END, PHRASE_START, REFERENCE, TASK_END, TASK_START, UNIT_END, UNIT_OF, UNIT_START
from .geometry import let


def _q(text: str) -> str:
    """A literal inside a Java regular expression."""
    return re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", text)


def count_of(text: Column, part: str) -> Column:
    """How often ``part`` occurs."""
    return F.regexp_count(text, F.lit(_q(part)))


def splice(text: Column, placeholder: str, values: Column) -> Column:
    """Replace the n-th placeholder by the n-th value (P4, P5, P6, P17); missing values leave nothing."""
    parts = F.split(text, _q(placeholder), -1)
    return F.when(text.isNotNull(), let(values, lambda v: F.array_join(F.transform(parts, lambda x, i: F.concat(F.when(i > 0, F.coalesce(F.get(v, i - 1), F.lit(""))).otherwise(F.lit("")), x)), "")))


def repeated(seq: Column, placeholder: str = BOXES) -> Column:
    """For each list of indices, its placeholder once per index."""
    return F.transform(seq, lambda s: F.repeat(F.lit(placeholder), F.size(s)))


def lookup(values: Column, seq: Column) -> Column:
    """Values by nested indices (P8); an index out of range or a null value gives null in its place."""
    return F.transform(seq, lambda s: F.transform(s, lambda i: F.when(i >= 0, F.get(values, i))))


def format_numbers(rows: Column, digits: int = 3, small: bool = False) -> Column:
    """``[a,b;c,d]`` with fixed digits."""
    inner = F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda v: F.format_string(f"%.{digits}f", v)), ",")), ";")
    a, b = ("(", ")") if small else ("[", "]")
    return F.concat(F.lit(a), inner, F.lit(b))


def _numbers(n: int, small: bool) -> str:
    number = r"\d(?:\.\d*)?"
    row = number + "(?:," + number + "){" + str(n - 1) + "}"
    a, b = (r"\(", r"\)") if small else (r"\[", r"\]")
    return f"{a}({row}(?:;{row})*){b}"


def extract_rows(text: Column, n: int = 4, small: bool = False) -> Column:
    """Boxes (``n=4``, T2) or points (``n=2``, T3) written in a text, one array of rows per bracket (T4)."""
    found = F.regexp_extract_all(text, F.lit(_numbers(n, small)), F.lit(1))
    return F.transform(found, lambda g: F.transform(F.split(g, ";"), lambda r: F.transform(F.split(r, ","), lambda v: v.try_cast("double"))))


def placeholder_order(text: Column, placeholders: tuple[str, ...]) -> Column:
    """Placeholders in the order in which they stand (T5)."""
    return F.regexp_extract_all(text, F.lit("|".join(_q(p) for p in placeholders)), F.lit(0))


def phrase_elements(text: Column, placeholders: tuple[str, ...] = tuple(UNIT_OF)) -> Column:
    """Marked phrases with the placeholder after each and how often it stands there.

    ``array<struct<phrase, placeholder, n>>``; a phrase without a placeholder has a null one and 0.
    """
    any_of = "|".join(_q(p) for p in placeholders)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s){PHRASE_START}.*?{PHRASE_END}.*?(?={PHRASE_START}|$)"), F.lit(0))

    def element(piece: Column) -> Column:
        head = F.regexp_extract(piece, f"(?s)^{PHRASE_START}(.*?){PHRASE_END}", 1)
        rest = F.regexp_replace(piece, f"(?s)^{PHRASE_START}.*?{PHRASE_END}", "")
        found = F.regexp_extract_all(rest, F.lit(any_of), F.lit(0))
        first = F.get(found, F.lit(0))
        return F.struct(F.regexp_replace(head, any_of, "").alias("phrase"), first.alias("placeholder"), F.size(F.filter(found, lambda x: x == first)).alias("n"))

    return F.transform(pieces, element)


def after_last(text: Column, mark: str) -> Column:
    """What follows the last ``mark``, or the whole text."""
    return F.element_at(F.split(text, _q(mark), -1), -1)


def before_first(text: Column, mark: str) -> Column:
    """What precedes the first ``mark``, or the whole text."""
    return F.get(F.split(text, _q(mark), -1), F.lit(0))


def caption_answer(text: Column) -> Column:
    """A caption inside a chat transcript."""
    return before_first(F.lower(after_last(text, "ASSISTANT: ")), "</s>")


def vqa_answer(text: Column) -> Column:
    """A short answer inside a chat transcript."""
    return before_first(after_last(caption_answer(text), "the answer is "), ".")


def marked_answer(text: Column) -> Column:
    """The answer named exactly once by ``The answer is …`` (Z22), else null."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)the answer is (.+?)(?:\.\s*|$)"), F.lit(1))
    return F.when(F.size(found) == 1, F.regexp_replace(F.trim(F.get(found, F.lit(0))), r"\.$", ""))


def yes_no_answer(text: Column) -> Column:
    """Yes or no: the marked answer, else whether the text says yes."""
    low = F.lower(after_last(text, "ASSISTANT: "))
    named = F.lower(marked_answer(low))
    return F.when(text.isNull(), F.lit(None)).otherwise(F.coalesce(named, F.when(F.contains(low, F.lit("yes")), F.lit("yes")).otherwise(F.lit("no"))))


def triples(text: Column) -> Column:
    """``- Name: … Unit: … Num: …`` lines with tags (T12), as ``array<struct<name, unit, n>>``."""
    pattern = F.lit(r"- Name: <Phrase>(.*?)</Phrase> Unit: <Unit>(.*?)</Unit> Num: (\d+)")
    names, units, nums = (F.regexp_extract_all(text, pattern, F.lit(g)) for g in (1, 2, 3))
    return F.transform(F.arrays_zip(names.alias("a"), units.alias("b"), nums.alias("c")), lambda z: F.struct(z["a"].alias("name"), z["b"].alias("unit"), z["c"].try_cast("int").alias("n")))


def plain_triples(text: Column) -> Column:
    """The same lines as the compiler writes them, without tags."""
    pattern = F.lit(r"- Name: (.*?) Unit: (\w+) Num: (\d+)")
    names, units, nums = (F.regexp_extract_all(text, pattern, F.lit(g)) for g in (1, 2, 3))
    return F.transform(F.arrays_zip(names.alias("a"), units.alias("b"), nums.alias("c")), lambda z: F.struct(z["a"].alias("name"), z["b"].alias("unit"), z["c"].try_cast("int").alias("n")))


def box_mask_triples(text: Column) -> Column:
    """``Name: … Unit: <Unit>box|mask</Unit> Num: …``."""
    pattern = F.lit(r"Name:\s*(.+?)\s*Unit:\s*<Unit>(box|mask)</Unit>\s*Num:\s*(\d+)")
    names, units, nums = (F.regexp_extract_all(text, pattern, F.lit(g)) for g in (1, 2, 3))
    return F.transform(F.arrays_zip(names.alias("a"), units.alias("b"), nums.alias("c")), lambda z: F.struct(z["a"].alias("name"), z["b"].alias("unit"), z["c"].try_cast("int").alias("n")))


def strip_task(text: Column) -> Column:
    """The text without its task block."""
    return F.regexp_replace(text, f"(?s){TASK_START}.*?{TASK_END}", "")


def task_block(text: Column) -> Column:
    """What the first task block holds, null without one."""
    return F.get(F.regexp_extract_all(text, F.lit(f"(?s){TASK_START}(.*?){TASK_END}"), F.lit(1)), F.lit(0))


def caption_text(text: Column) -> Column:
    """A caption without task block, line breaks, phrase tags and bracketed groups."""
    t = F.regexp_replace(strip_task(text), r"\n+", "")
    t = F.regexp_replace(t, r"</?Phrase>", "")
    t = F.regexp_replace(t, r"\s*\([^)]*\)\s*", " ")
    return F.trim(F.regexp_replace(t, r"\s{2,}", " "))


def phrase_references(text: Column) -> Column:
    """Phrases with the number of references after each."""
    return phrase_elements(text, (REFERENCE,))


def task_lines(text: Column) -> Column:
    """Class, unit and number of the lines of a task block (T17); the block's first line is its heading."""
    lines = F.filter(F.split(F.coalesce(task_block(text), F.lit("")), "\n", -1), lambda x: F.contains(x, F.lit(PHRASE_START)))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, f"{PHRASE_START}(.*?){PHRASE_END}", 1).alias("name"), F.regexp_extract(x, f"{UNIT_START}(.*?){UNIT_END}", 1).alias("unit"), F.regexp_extract(F.regexp_replace(x, f"{PHRASE_START}.*?{PHRASE_END}", ""), r"\d+", 0).try_cast("int").alias("n")))


def answer_units(text: Column) -> Column:
    """``<Phrase>p</Phrase>(<Unit>u</Unit>[0]<REF>…)`` as phrase, unit and number of references."""
    pattern = F.lit(r"<Phrase>(.*?)</Phrase>\(<Unit>(.*?)</Unit>(.*?)\)")
    names, units, refs = (F.regexp_extract_all(strip_task(text), pattern, F.lit(g)) for g in (1, 2, 3))
    return F.transform(F.arrays_zip(names.alias("a"), units.alias("b"), refs.alias("c")), lambda z: F.struct(z["a"].alias("name"), z["b"].alias("unit"), F.regexp_count(z["c"], F.lit(r"\[\d+\]<REF>")).alias("n")))


def old_answer_units(text: Column) -> Column:
    """The older grammar ``<Phrase>p</Phrase>(<Unit>u</Unit><REF>[0]…)``."""
    clean = F.regexp_replace(strip_task(text), r"(?s)<v>.*?</v>", "")
    pattern = F.lit(r"<Phrase>(.*?)</Phrase>\((.*?)\)")
    names, rest = (F.regexp_extract_all(clean, pattern, F.lit(g)) for g in (1, 2))
    one = r"<Unit>(.*?)</Unit><REF>\[(\d+)\]"
    return F.transform(F.arrays_zip(names.alias("a"), rest.alias("b")), lambda z: F.struct(z["a"].alias("name"), F.regexp_extract(z["b"], one, 1).alias("unit"), F.regexp_count(z["b"], F.lit(one)).alias("n")))


def list_literal(text: Column) -> Column:
    """A written list of strings (T20); null where it is none."""
    return F.from_json(F.regexp_replace(F.regexp_replace(text, r"'(\s*[,\]])", '"$1'), r"([\[,]\s*)'", '$1"'), "array<string>")


def reference_ids(text: Column) -> Column:
    """Numbers in brackets that name objects of a scene."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\((\d+(?:,\d+)*)\)"), F.lit(1)), lambda g: F.transform(F.split(g, ","), lambda x: x.try_cast("int")))


def repeat_labels(pairs: Column) -> Column:
    """Each label as often as its count (T22); ``pairs``: ``array<struct<phrase, n>>``."""
    return F.flatten(F.transform(pairs, lambda p: F.array_repeat(p["phrase"], p["n"])))


def zero_fill(number: Column, width: int = 12) -> Column:
    """A number with leading zeros (T23); longer numbers stay whole."""
    s = number.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def stem(path: Column) -> Column:
    """The file name up to its first dot."""
    return before_first(after_last(path, "/"), ".")


def fix_punctuation(text: Column) -> Column:
    """No blanks before commas and full stops."""
    return F.regexp_replace(text, r"\s+([,.])", "$1")


def synonyms(names: Column) -> Column:
    """Names of a class written in one string."""
    return F.filter(F.transform(F.split(names, ","), lambda x: F.trim(x)), lambda x: x != "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors (T28); null if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return F.try_divide(dot, norm(a) * norm(b))


def insert_phrases(text: Column, spans: Column, placeholder: str = BOXES) -> Column:
    """Mark phrases by character offsets.

    ``spans``: ``array<struct<start int, end int, seq array<int>>>``. Marks go in
    from the right, so offsets stay valid; at one offset a start stands before an
    end, as the order of the words has it. Gives the text and the sequences in the
    order in which their ends stand.
    """
    events = F.flatten(F.transform(spans, lambda s: F.array(F.struct(s["start"].alias("at"), F.lit("start").alias("kind"), s["seq"].alias("seq")), F.struct(s["end"].alias("at"), F.lit("end").alias("kind"), s["seq"].alias("seq")))))
    ordered = F.sort_array(F.filter(events, lambda e: e["at"].isNotNull()), asc=False)

    def put(state: Column, e: Column) -> Column:
        mark = F.when(e["kind"] == "end", F.concat(F.lit(PHRASE_END), F.repeat(F.lit(placeholder), F.size(e["seq"])))).otherwise(F.lit(PHRASE_START))
        head, tail = F.substring(state["text"], F.lit(1), e["at"]), F.substring(state["text"], e["at"] + 1, F.length(state["text"]))
        return F.struct(F.concat(head, mark, tail).alias("text"), F.when(e["kind"] == "end", F.concat(F.array(e["seq"]), state["seq"])).otherwise(state["seq"]).alias("seq"))

    return F.when(text.isNotNull(), F.aggregate(ordered, F.struct(text.alias("text"), F.array().cast("array<array<int>>").alias("seq")), put))


def words_with_boxes(words: Column) -> Column:
    """A sentence of words and index lists (P10): ``array<struct<word, ids>>`` to text and sequences."""
    return F.struct(F.array_join(F.transform(words, lambda w: F.when(w["ids"].isNotNull(), F.lit(BOXES)).otherwise(w["word"])), " ").alias("text"), F.transform(F.filter(words, lambda w: w["ids"].isNotNull()), lambda w: w["ids"]).alias("seq"))


def lettered(choices: Column) -> Column:
    """``(A) … (B) …``."""
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.lit("("), F.char(i + 65), F.lit(") "), c)), " ")


def letter_answer(index: Column) -> Column:
    """``The answer is (B).``."""
    return F.concat(F.lit("The answer is ("), F.char(index + 65), F.lit(")."))


def nth_occurrence(text: Column, part: Column, n: Column) -> Column:
    """Start (from 0) of the n-th (from 1) occurrence of a part without regard to case (T8), -1 if there is none."""
    pieces = F.split(F.lower(text), F.regexp_replace(F.lower(part), r"([\\.^$|()\[\]{}*+?])", r"\\$1"), -1)
    return F.when(F.size(pieces) <= n, F.lit(-1)).otherwise(F.aggregate(F.slice(pieces, 1, n), F.lit(0), lambda s, x: s + F.length(x)) + (n - 1) * F.length(part))
