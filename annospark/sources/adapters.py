"""Adapters: source records to the canonical record.

An adapter is a function of a DataFrame of raw records and options. It builds
``sample_id``, ``source``, ``image``, ``target``, ``system`` and ``turns`` with
column expressions only, so that Catalyst prunes what a query does not use.
Question templates are chosen by a hash of the record's key; options that say
"random" in other systems are hashes here and repeat on any cluster.

Raw records need ``key`` (unique). Fields are named in each docstring. A null
field gives a null part, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BOXES, IMAGE, KEYPOINTS, MASKS, PHRASE_END, PHRASE_START, POINTS, STAGE1_END, STAGE1_START
from ..functions import geometry as G
from ..functions import masks as M
from ..functions import text as T
from ..operators import conversation as C
from ..operators import corpora as K
from ..operators import grouping as J
from .. import schema as S

Adapter = Callable[..., DataFrame]
REGISTRY: dict[str, Adapter] = {}

_SEQ = "array<array<int>>"


def adapter(*names: str) -> Callable[[Adapter], Adapter]:
    """Register an adapter under its names (R1, DM10)."""

    def put(f: Adapter) -> Adapter:
        for n in names:
            if n in REGISTRY:
                raise ValueError(f"adapter {n} is registered twice")
            REGISTRY[n] = f
        return f

    return put


def load(name: str, raw: DataFrame, **options: object) -> DataFrame:
    """Canonical records of a registered source; unknown names and options fail at once."""
    if name not in REGISTRY:
        raise KeyError(f"no adapter named {name}")
    return REGISTRY[name](raw, **options)


def _one_of(value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{value!r} is none of {allowed}")
    return value


def seq(*groups: tuple[int, ...]) -> Column:
    """A literal sequence of index lists."""
    return F.array(*[F.array(*[F.lit(i) for i in g]) for g in groups]).cast(_SEQ)


def turn(role: str, value: Column, boxes: Column | None = None, masks: Column | None = None, points: Column | None = None, keypoints: Column | None = None) -> Column:
    """One turn; sequences that are not given are null."""
    part = lambda c, n: (c if c is not None else F.lit(None)).cast(_SEQ).alias(n)
    return F.struct(F.lit(role).alias("role"), value.alias("value"), part(boxes, "boxes_seq"), part(masks, "masks_seq"), part(points, "points_seq"), part(keypoints, "keypoints_seq")).cast(S.TURN)


def task(name: str, *element: str, unit: str | None = None) -> Column:
    """One system entry."""
    return F.struct(F.lit(name).alias("task_name"), F.array(*[F.lit(e) for e in element]).cast("array<string>").alias("element"), F.lit(unit is not None).alias("use_unit"), (F.array(F.lit(unit)) if unit else F.lit(None)).cast("array<string>").alias("unit")).cast(S.SYSTEM)


VQA = ("vqa", ("sentence",), None)
GCG_BOX, GCG_MASK = ("gcg_detection", ("phrase", "sentence"), "box"), ("gcg_segmentation", ("phrase", "sentence"), "mask")


def _task(kind: tuple[str, tuple[str, ...], str | None]) -> Column:
    return task(kind[0], *kind[1], unit=kind[2])


def target(boxes: Column | None = None, points: Column | None = None, masks: Column | None = None, keypoints: Column | None = None, depth: Column | None = None) -> Column:
    """The targets of a record."""
    part = lambda c, n: (c if c is not None else F.lit(None)).alias(n)
    return F.struct(part(boxes, "boxes"), part(points, "points"), part(masks, "masks"), part(keypoints, "keypoints"), part(depth, "depth")).cast(S.TARGET)


def question(templates: list[str], key: Column, **slots: Column) -> Column:
    """A template chosen by hash, with its slots filled."""
    if not templates:
        raise ValueError("no question templates")
    text = F.get(F.array(*[F.lit(t) for t in templates]), K.chosen(key, len(templates)).cast("int"))
    for name, value in slots.items():
        text = F.replace(text, F.lit(f"<{name}>"), value)
    return text


def record(df: DataFrame, source: str, image: Column, turns: list[Column] | Column, system: list[Column] | Column, targets: Column | None = None, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """The canonical row."""
    size = lambda c: (c if c is not None else F.lit(None)).cast("int")
    return df.select(
        F.col("key").cast("string").alias("sample_id"),
        F.lit(source).alias("source"),
        F.when(image.isNotNull(), F.struct(image.alias("path"), size(width).alias("width"), size(height).alias("height"))).alias("image"),
        (targets if targets is not None else target()).alias("target"),
        (F.array(*system) if isinstance(system, list) else system).alias("system"),
        (F.array(*turns) if isinstance(turns, list) else turns).alias("turns"),
    )


def _stage2_marks(text: Column, groups: Column) -> Column:
    """Stage-1 phrase marks as stage-2 marks with a placeholder per index."""
    ends = F.replace(F.replace(text, F.lit(STAGE1_START), F.lit(PHRASE_START)), F.lit(STAGE1_END), F.lit(PHRASE_END + "\x01"))
    return T.splice(ends, "\x01", T.repeated(groups))


# --- captions and questions -------------------------------------------------------------------------------------


@adapter("caption")
def caption(df: DataFrame, templates: list[str], source: str = "caption") -> DataFrame:
    """A1: ``img_path``, ``caption``."""
    return record(df, source, F.col("img_path"), [turn("human", question(templates, F.col("key"))), turn("gpt", F.col("caption"))], [_task(VQA)])


@adapter("nocaps")
def nocaps(df: DataFrame, images: DataFrame, templates: list[str], source: str = "nocaps") -> DataFrame:
    """A2: ``image_id``, ``caption`` joined with ``images`` (``id``, ``file_name``)."""
    joined = df.join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id")
    return caption(joined.withColumnRenamed("file_name", "img_path"), templates, source)


@adapter("flickr")
def flickr(df: DataFrame, templates: list[str], plain: list[str], stage: int = 2, source: str = "flickr") -> DataFrame:
    """A3: ``image_id``, ``sentence`` with stage-1 marks, ``boxes``, ``boxes_seq``; without sequences a plain caption."""
    none = F.coalesce(F.size("boxes_seq"), F.lit(0)) == 0
    clean = F.regexp_replace("sentence", f"{STAGE1_START}|{STAGE1_END}", "")
    marked = _stage2_marks(F.col("sentence"), F.col("boxes_seq")) if stage == 2 else F.replace(F.replace(F.col("sentence"), F.lit(STAGE1_START), F.lit("")), F.lit(STAGE1_END), F.lit(BOXES))
    asked = F.when(none, question(plain, F.col("key"))).otherwise(question(templates, F.col("key")))
    return record(df, source, F.concat(F.col("image_id"), F.lit(".jpg")), [turn("human", asked), turn("gpt", F.when(none, clean).otherwise(marked), boxes=F.when(~none, F.col("boxes_seq")))], F.array(F.when(none, _task(VQA)).otherwise(_task(GCG_BOX))), target(boxes=F.col("boxes")))


@adapter("flickr_caption")
def flickr_caption(df: DataFrame, templates: list[str], source: str = "flickr_caption") -> DataFrame:
    """A4: ``image_id``, ``sentence``; marks dropped, punctuation closed up."""
    return record(df, source, F.concat(F.col("image_id"), F.lit(".jpg")), [turn("human", question(templates, F.col("key"))), turn("gpt", T.fix_punctuation(F.regexp_replace("sentence", f"{STAGE1_START}|{STAGE1_END}", "")))], [_task(VQA)])


@adapter("flickr_segmentation")
def flickr_segmentation(df: DataFrame, templates: list[str], source: str = "flickr_segmentation") -> DataFrame:
    """A5: ``image_id``, ``sentence``, ``masks`` (run lengths), ``masks_seq``."""
    ends = F.replace(F.replace(F.col("sentence"), F.lit(STAGE1_START), F.lit(PHRASE_START)), F.lit(STAGE1_END), F.lit(PHRASE_END + "\x01"))
    return record(df, source, F.concat(F.col("image_id"), F.lit(".jpg")), [turn("human", question(templates, F.col("key"))), turn("gpt", T.splice(ends, "\x01", T.repeated(F.col("masks_seq"), MASKS)), masks=F.col("masks_seq"))], [_task(GCG_MASK)], target(masks=F.col("masks")))


def _answered(df: DataFrame, source: str, image: Column, asked: Column, answer: Column) -> DataFrame:
    return record(df, source, image, [turn("human", asked), turn("gpt", answer)], [_task(VQA)])


@adapter("vqav2")
def vqav2(df: DataFrame, templates: list[str], has_annotation: bool = True, source: str = "vqav2") -> DataFrame:
    """A10: ``image_path``, ``question``, ``annotation.multiple_choice_answer``."""
    answer = F.concat(F.lit("The answer is "), F.col("annotation.multiple_choice_answer") if has_annotation else F.lit("UNKNOWN"), F.lit("."))
    return _answered(df, source, F.col("image_path"), question(templates, F.col("key"), question=F.col("question")), answer)


@adapter("vqae", "vqax")
def vqa_explained(df: DataFrame, templates: list[str], is_e: bool = True, has_annotation: bool = True, source: str = "vqae") -> DataFrame:
    """``file_path``, ``question``; ``explanation``, ``multiple_answers`` or ``justification``, ``multiple_choice_answer``."""
    why = F.get("explanation", F.lit(0)) if is_e else F.array_join("justification", "")
    answer = F.concat(why, F.lit(" So the answer is "), F.col("multiple_answers" if is_e else "multiple_choice_answer"), F.lit(".")) if has_annotation else F.lit("UNKNOWN")
    return _answered(df, source, F.col("file_path"), question(templates, F.col("key"), question=F.col("question")), answer)


@adapter("okvqa")
def okvqa(df: DataFrame, templates: list[str], has_annotation: bool = True, source: str = "okvqa") -> DataFrame:
    """``image_name``, ``question``, ``answers``; for evaluation all of them as one list."""
    answer = F.concat(F.lit("The answer is "), F.get("answers", F.lit(0)), F.lit(".")) if has_annotation else F.to_json("answers")
    return _answered(df, source, F.col("image_name"), question(templates, F.col("key"), question=F.col("question")), answer)


@adapter("pope")
def pope(df: DataFrame, templates: list[str], source: str = "pope") -> DataFrame:
    """``image``, ``text``, ``label``."""
    return _answered(df, source, F.col("image"), question(templates, F.col("key"), question=F.col("text")), F.concat(F.lit("The answer is "), F.lower("label"), F.lit(" .")))


@adapter("gpt4gen")
def gpt4gen(df: DataFrame, templates: list[str], version: str = "bc", stage: int = 2, source: str = "gpt4gen") -> DataFrame:
    """``img_path``, ``boxes``, ``question``, ``question_boxes_seq``, ``answer``, ``cot_with_ans``, ``answer_boxes_seq``; versions a, c, bc."""
    _one_of(version, ("a", "c", "bc"))
    bare = lambda c: F.regexp_replace(c, f"{STAGE1_START}|{STAGE1_END}", "")
    boxed = lambda c, s: _stage2_marks(F.col(c), F.col(s)) if stage == 2 else F.replace(F.replace(F.col(c), F.lit(STAGE1_START), F.lit("")), F.lit(STAGE1_END), F.lit(BOXES))
    used = lambda c: F.when(F.size(c) > 0, F.col(c))
    answer = {"a": F.col("answer"), "c": bare("cot_with_ans"), "bc": boxed("cot_with_ans", "answer_boxes_seq")}[version]
    kind = F.when(F.coalesce(F.size("answer_boxes_seq"), F.lit(0)) > 0, _task(GCG_BOX)).otherwise(_task(VQA)) if version == "bc" else _task(VQA)
    return record(df, source, F.col("img_path"), [turn("human", question(templates, F.col("key"), question=boxed("question", "question_boxes_seq")), boxes=used("question_boxes_seq")), turn("gpt", answer, boxes=used("answer_boxes_seq") if version == "bc" else None)], F.array(kind), target(boxes=F.col("boxes")))


# --- referring --------------------------------------------------------------------------------------------------


@adapter("rec")
def rec(df: DataFrame, templates: list[str], stage: int = 2, named_target: bool = False, source: str = "rec") -> DataFrame:
    """``img_path``, ``expression``, ``bbox``."""
    asked = question(templates, F.col("key"), expr=F.col("expression"))
    name = F.lit("target") if named_target else F.col("expression")
    answer = F.concat(F.lit(PHRASE_START), name, F.lit(PHRASE_END + BOXES)) if stage == 2 else F.lit(f"Answer: {BOXES}.")
    return record(df, source, F.col("img_path"), [turn("human", asked), turn("gpt", answer, boxes=seq((0,)))], [task("grounding_detection", "phrase", unit="box")], target(boxes=F.array("bbox")))


@adapter("res")
def res(df: DataFrame, templates: list[str], named_target: bool = False, source: str = "res") -> DataFrame:
    """``img_path``, ``expression``, ``mask`` (polygons), ``height``, ``width``."""
    name = F.lit("target") if named_target else F.col("expression")
    answer = F.concat(F.lit(PHRASE_START), name, F.lit(PHRASE_END + MASKS))
    return record(df, source, F.col("img_path"), [turn("human", question(templates, F.col("key"), expr=F.col("expression"))), turn("gpt", answer, masks=seq((0,)))], [task("grounding_segmentation", "phrase", unit="mask")], target(masks=F.array(M.polygon_mask("mask", "height", "width"))), F.col("width"), F.col("height"))


@adapter("reg", "gc")
def reg(df: DataFrame, templates: list[str], version: str = "box", source: str = "reg") -> DataFrame:
    """``img_path``, ``expression``, ``bbox`` or ``mask`` with ``height``, ``width``."""
    if _one_of(version, ("box", "mask")) == "box":
        return record(df, source, F.col("img_path"), [turn("human", question(templates, F.col("key"), objs=F.lit(BOXES)), boxes=seq((0,))), turn("gpt", F.col("expression"))], [_task(VQA)], target(boxes=F.array("bbox")))
    return record(df, source, F.col("img_path"), [turn("human", question(templates, F.col("key")), masks=seq((0,))), turn("gpt", F.col("expression"))], [_task(VQA)], target(masks=F.array(M.polygon_mask("mask", "height", "width"))), F.col("width"), F.col("height"))


@adapter("point_qa_local", "point_qa_twice")
def point_qa(df: DataFrame, templates: list[str], version: str = "p", question_field: str = "question", share: float = 0.5, source: str = "point_qa") -> DataFrame:
    """``file_path``, a question field, ``answer``, ``bbox``, ``point``; versions b, p, bp."""
    _one_of(version, ("b", "p", "bp"))
    by_point = {"p": F.lit(True), "b": F.lit(False), "bp": K.coin(F.col("key"), share)}[version]
    asked = F.concat(F.col(question_field), F.when(by_point, F.lit(POINTS)).otherwise(F.lit(BOXES)))
    return record(df, source, F.col("file_path"), [turn("human", question(templates, F.col("key"), question=asked), boxes=F.when(~by_point, seq((0,))), points=F.when(by_point, seq((0,)))), turn("gpt", F.concat(F.lit("The answer is "), F.col("answer"), F.lit(" .")))], [_task(VQA)], target(boxes=F.array("bbox"), points=F.array("point")))


@adapter("v7w_point")
def v7w_point(df: DataFrame, templates: list[str], version: str = "b", shuffle: bool = True, source: str = "v7w") -> DataFrame:
    """``file_path``, ``question``, ``candidates``, ``answer``, ``point``; versions p and b."""
    _one_of(version, ("p", "b"))
    order = F.sequence(F.lit(0), F.size("candidates") - 1)
    if shuffle:
        order = F.transform(F.array_sort(F.transform(order, lambda i: F.struct(F.md5(F.concat(F.lit("42:"), F.col("key").cast("string"), F.lit(":"), i.cast("string"))).alias("h"), i.alias("i")))), lambda x: x["i"])
    asked = F.concat(F.col("question"), F.lit(" Candidates: "), F.array_join(F.array_repeat(F.lit(BOXES), F.size("candidates")), " "), F.lit(" answer in box format." if version == "b" else " answer in point format."))
    answer = F.lit(f"The answer is {PHRASE_START}target{PHRASE_END}{BOXES if version == 'b' else POINTS} .")
    at = (F.array_position("candidates", F.col("answer")) - 1).cast("int")
    gpt = turn("gpt", answer, boxes=F.array(F.array(at))) if version == "b" else turn("gpt", answer, points=seq((0,)))
    return record(df, source, F.col("file_path"), [turn("human", question(templates, F.col("key"), question=asked), boxes=F.transform(order, lambda i: F.array(i))), gpt], [task("gcg_detection", "sentence", "phrase", unit="box" if version == "b" else "point")], target(boxes=F.col("candidates"), points=F.array("point") if version == "p" else None))


# What the layouts of multiple-choice questions put before and after their parts.
_CHOOSE = "You should decide on the best choice and output the corresponding letter."
_EXPLAIN = "You should explain the reason for the above answer."
_CHOOSE_WHY = "You should decide on the best choice that explains the above answer and output the corresponding letter."
# Layouts; q question, A answer options, a gold answer, c answer letter, R rationale options, r gold rationale, l rationale letter.
VCR_LAYOUTS = {
    "q-a": [[("QUESTION:", "q", "")], [("", "a", "")]],
    "q-ra": [[("QUESTION:", "q", "")], [("", "r", ""), ("", "a", "")]],
    "qc-a": [[("QUESTION:", "q", ""), ("\nOPTIONS:", "A", _CHOOSE)], [("", "c", "")]],
    "qc-ra": [[("QUESTION:", "q", ""), ("\nOPTIONS:", "A", _CHOOSE)], [("", "r", ""), ("", "c", "")]],
    "qc-rac": [[("QUESTION:", "q", ""), ("\nOPTIONS:", "A", _CHOOSE)], [("", "r", ""), ("", "a", ""), ("", "c", "")]],
    "qa-r": [[("QUESTION:", "q", ""), ("\nANSWER:", "a", _EXPLAIN)], [("", "r", "")]],
    "qac-r": [[("QUESTION:", "q", ""), ("\nANSWER:", "a", ""), ("\nRATIONALE OPTIONS:", "R", _CHOOSE_WHY)], [("", "l", "")]],
    "q-a-q-r": [[("QUESTION:", "q", "")], [("", "a", "")], [("", "", _EXPLAIN)], [("", "r", "")]],
    "qc-a-qc-r": [[("QUESTION:", "q", ""), ("\nOPTIONS:", "A", _CHOOSE)], [("", "c", "")], [("RATIONALE OPTIONS:", "R", _CHOOSE_WHY)], [("", "l", "")]],
}


@adapter("vcr")
def vcr(df: DataFrame, templates: list[str], version: str = "q-a", source: str = "vcr") -> DataFrame:
    """``img_fn``, ``boxes``, ``question``, ``answer_choices``, ``rationale_choices`` (words ``struct<word, ids>``), ``answer_label``, ``rationale_label``."""
    layout = VCR_LAYOUTS[_one_of(version, tuple(VCR_LAYOUTS))]
    packs = lambda c: F.transform(c, lambda w: T.words_with_boxes(w))
    plain = lambda text: F.struct(text.alias("text"), F.array().cast(_SEQ).alias("seq"))
    options = lambda p: F.struct(T.lettered(F.transform(p, lambda x: x["text"])).alias("text"), F.flatten(F.transform(p, lambda x: x["seq"])).alias("seq"))
    answers, reasons = packs("answer_choices"), packs("rationale_choices")
    part = {
        "q": T.words_with_boxes(F.col("question")), "A": options(answers), "R": options(reasons), "a": F.get(answers, F.col("answer_label")), "r": F.get(reasons, F.col("rationale_label")),
        "c": plain(T.letter_answer(F.col("answer_label"))), "l": plain(T.letter_answer(F.col("rationale_label"))), "": None,
    }

    def merged(items: list[tuple[str, str, str]]) -> tuple[Column, Column]:
        texts, seqs = [], []
        for before, name, after in items:
            texts += [F.lit(before)] if before else []
            if part[name] is not None:
                texts.append(part[name]["text"])
                seqs.append(part[name]["seq"])
            texts += [F.lit(after)] if after else []
        return F.concat_ws(" ", *texts), F.flatten(F.array(*seqs)) if seqs else F.array().cast(_SEQ)

    turns, system = [], []
    for k, items in enumerate(layout):
        text, groups = merged(items)
        some = F.size(groups) > 0
        if k % 2:
            # the answer's boxes are targets: each group gets the phrase ``target`` before it
            value = T.splice(text, BOXES, F.transform(T.repeated(groups), lambda b: F.concat(F.lit(f"{PHRASE_START}target{PHRASE_END}"), b)))
            turns.append(turn("gpt", value, boxes=F.when(some, groups)))
            system.append(F.when(some, _task(GCG_BOX)).otherwise(_task(VQA)))
        else:
            value = T.splice(text, BOXES, T.repeated(groups))
            turns.append(turn("human", question(templates, F.col("key"), question=value) if k == 0 else value, boxes=F.when(some, groups)))
    return record(df, source, F.col("img_fn"), turns, system, target(boxes=F.transform("boxes", lambda b: F.slice(b, 1, 4))))


@adapter("vcr_predictions")
def vcr_predictions(df: DataFrame, templates: list[str], version: str = "qc-a", source: str = "vcr_pred") -> DataFrame:
    """Every question with each answer forced, and each rationale where the layout has one."""
    four = F.sequence(F.lit(0), F.lit(3))
    forced = df.withColumn("answer_label", F.explode(four)) if "R" not in str(VCR_LAYOUTS[version]) else df.withColumn("answer_label", F.explode(four)).withColumn("rationale_label", F.explode(four))
    keyed = forced.withColumn("key", F.concat_ws("#", F.col("key").cast("string"), "answer_label", *(["rationale_label"] if "R" in str(VCR_LAYOUTS[version]) else [])))
    return vcr(keyed, templates, version, source)


# --- scene graphs -----------------------------------------------------------------------------------------------


@adapter("gqa")
def gqa(df: DataFrame, scenes: DataFrame, templates: list[str], answer: str = "s", boxed_question: str = "none", share: float = 0.5, source: str = "gqa") -> DataFrame:
    """``imageId``, ``question``, ``answer``, ``fullAnswer``, ``question_spans``, ``answer_spans`` (``array<struct<start, end, ids>>``, word offsets); scenes: ``imageId``, ``objects`` map of id to ``struct<x, y, w, h>``.

    Answers: ``s`` short, ``l`` long, ``bl`` long with boxes. Questions: ``none``, ``box``, ``mixed`` by a coin.
    Equal boxes are stored once; an id the scene lacks is left out.
    """
    _one_of(answer, ("s", "l", "bl"))
    _one_of(boxed_question, ("none", "box", "mixed"))
    joined = df.join(scenes, "imageId", "left")
    box = lambda o: F.array(o["x"], o["y"], o["x"] + o["w"], o["y"] + o["h"]).cast("array<double>")
    spans_of = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<struct<start:int,end:int,ids:array<string>>>")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.filter(F.transform(s["ids"], lambda i: F.try_element_at("objects", i)), lambda o: o.isNotNull()).alias("os"))), lambda s: F.size(s["os"]) > 0)
    with_box = {"none": F.lit(False), "box": F.lit(True), "mixed": K.coin(F.col("key"), share)}[boxed_question]
    qs = F.when(with_box, spans_of(F.col("question_spans"))).otherwise(F.slice(spans_of(F.col("question_spans")), 1, 0))
    as_ = spans_of(F.col("answer_spans")) if answer == "bl" else F.slice(spans_of(F.col("answer_spans")), 1, 0)
    staged = joined.withColumn("__q", qs).withColumn("__a", as_)
    staged = staged.withColumn("__boxes", F.array_distinct(F.flatten(F.transform(F.concat("__q", "__a"), lambda s: F.transform(s["os"], box)))))
    groups = lambda c: F.transform(c, lambda s: F.transform(s["os"], lambda o: (F.array_position("__boxes", box(o)) - 1).cast("int")))

    def marked(text: Column, spans: str, phrase: bool) -> Column:
        words = F.split(text, " ")
        before = lambda i: F.when(F.exists(spans, lambda s: s["start"] == i), F.lit(PHRASE_START if phrase else "")).otherwise(F.lit(""))
        after = lambda i: F.array_join(F.transform(F.filter(spans, lambda s: s["end"] == i + 1), lambda s: F.concat(F.lit(PHRASE_END if phrase else ""), F.repeat(F.lit(BOXES), F.size(s["os"])))), "")
        return F.array_join(F.transform(words, lambda w, i: F.concat(before(i), w, after(i))), " ")

    value = {"s": F.concat(F.lit("The answer is "), F.col("answer"), F.lit(".")), "l": F.col("fullAnswer"), "bl": marked(F.col("fullAnswer"), "__a", True)}[answer]
    some = F.size("__a") > 0
    return record(staged, source, F.concat(F.col("imageId"), F.lit(".jpg")), [turn("human", question(templates, F.col("key"), question=marked(F.col("question"), "__q", False)), boxes=F.when(F.size("__q") > 0, groups("__q"))), turn("gpt", value, boxes=F.when(some, groups("__a")))], F.array(F.when(some, _task(GCG_BOX)).otherwise(_task(VQA))), target(boxes=F.col("__boxes")))


# Steps of a functional program that name objects, and those that do if a count follows.
_NAMING = ("unique", "union", "intersect", "relate", "same_size", "same_shape", "same_material", "same_color")
_SELECTING = ("scene", "filter_color", "filter_material", "filter_shape", "filter_size")


@adapter("clevr")
def clevr(df: DataFrame, scenes: DataFrame, templates: list[str], version: str = "s", source: str = "clevr") -> DataFrame:
    """``image_filename``, ``image_index``, ``question``, ``answer``, ``program`` (``array<struct<function, inputs, value_inputs, ans>>``); scenes: ``image_index``, ``objects`` with ``pixel_coords``.

    Versions: ``s`` answer, ``ss`` program and answer, ``bss`` program with points.
    """
    _one_of(version, ("s", "ss", "bss"))
    joined = df.join(scenes, "image_index", "left")
    refs = version == "bss"

    def names_objects(p: Column, i: Column) -> Column:
        following = F.get("program", i + 1)["function"]
        return p["function"].isin(*_NAMING) | (p["function"].isin(*_SELECTING) & F.coalesce(following.isin("exist", "count"), F.lit(False)))

    def step(p: Column, i: Column) -> Column:
        name = F.when(F.coalesce(F.size(p["value_inputs"]), F.lit(0)) > 0, F.concat(p["function"], F.lit(":"), F.get(p["value_inputs"], F.lit(0)))).otherwise(p["function"])
        inputs = F.when(F.coalesce(F.size(p["inputs"]), F.lit(0)) > 0, F.concat(F.lit("["), F.array_join(F.transform(p["inputs"], lambda x: x.cast("string")), ","), F.lit("]"))).otherwise(F.lit(""))
        found = F.lit("")
        if refs:
            found = F.when(names_objects(p, i), F.when(F.coalesce(F.size(p["ans"]), F.lit(0)) > 0, F.repeat(F.lit(POINTS), F.size(p["ans"]))).otherwise(F.lit(" Found no object."))).otherwise(F.lit(""))
        return F.concat(name, inputs, found)

    text = F.array_join(F.transform("program", step), " -> ")
    named = F.filter(F.transform("program", lambda p, i: F.when(names_objects(p, i) & (F.coalesce(F.size(p["ans"]), F.lit(0)) > 0), p["ans"])), lambda a: a.isNotNull())
    point = lambda k: F.slice(F.get("objects", k)["pixel_coords"], 1, 2).cast("array<double>")
    points = F.array_distinct(F.transform(F.flatten(named), point))
    groups = F.transform(named, lambda a: F.transform(a, lambda k: (F.array_position(points, point(k)) - 1).cast("int")))
    final = F.concat(F.lit(" The answer is "), F.col("answer"), F.lit("."))
    value = F.concat(F.lit("The answer is "), F.col("answer"), F.lit(".")) if version == "s" else F.concat(text, final)
    return record(joined, source, F.col("image_filename"), [turn("human", question(templates, F.col("key"), question=F.col("question"))), turn("gpt", value, points=groups if refs else None)], [task("gcg_detection", "phrase", "sentence", unit="point") if refs else _task(VQA)], target(points=points) if refs else None)


# --- instructions -----------------------------------------------------------------------------------------------


@adapter("instruct", "instruct_mix", "grit_offline")
def instruct(df: DataFrame, prefix: str = "", source: str = "instruct") -> DataFrame:
    """``image``, ``conversations`` (``array<struct<from, value>>``); an odd turn at the end stays for validation."""
    turns = F.transform("conversations", lambda t: F.struct(t["from"].alias("role"), t["value"].alias("value"), *[F.lit(None).cast(_SEQ).alias(n) for n in ("boxes_seq", "masks_seq", "points_seq", "keypoints_seq")]).cast(S.TURN))
    return record(df, source, F.when(F.col("image").isNotNull(), F.concat(F.lit(prefix), F.col("image"))), turns, F.array_repeat(_task(VQA), F.floor(F.size("conversations") / 2).cast("int")))


# --- detection and segmentation ---------------------------------------------------------------------------------


@adapter("coco_rem", "lvis", "ade20k", "part")
def detection(annotations: DataFrame, images: DataFrame, categories: DataFrame, templates: list[str], unit: str = "box", most: int | None = None, source: str = "coco_rem") -> DataFrame:
    """Annotations (``id``, ``image_id``, ``category_id``, ``bbox`` xywh or ``mask``), images (``id``, ``file_name``, ``width``, ``height``), categories (``id``, ``name``).

    One record per picture: its instances by class in order of first appearance. ``most`` keeps so many per picture by hash.
    """
    from ..runtime import salted_rank

    _one_of(unit, ("box", "mask"))
    place, value = (BOXES, G.xywh_to_xyxy(F.col("bbox"))) if unit == "box" else (MASKS, F.col("mask"))
    named = annotations.join((categories.select(F.col("id").alias("category_id"), F.col("name").alias("label"))), "category_id")
    if most:
        named = K.sampled_per_group(named, "image_id", "id", most)
    ranked = salted_rank(named.withColumn("value", value), ["image_id"], [F.col("id")], "pos", salts=1).withColumn("pos", F.col("pos").cast("int"))
    text = J.detection_captions(ranked, "image_id", "label", "pos", place)
    values = ranked.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))
    rows = text.join(values, "image_id").join(images.select(F.col("id").alias("image_id"), "file_name", "width", "height"), "image_id").withColumn("key", F.col("image_id"))
    path = F.coalesce("file_name", F.concat(T.zero_fill(F.col("image_id")), F.lit(".jpg")))
    answer = turn("gpt", F.col("caption"), boxes=F.col("seq")) if unit == "box" else turn("gpt", F.col("caption"), masks=F.col("seq"))
    return record(rows, source, path, [turn("human", question(templates, F.col("key"))), answer], [task("detection" if unit == "box" else "segmentation", "phrase", unit=unit)], target(boxes=F.col("values")) if unit == "box" else target(masks=F.col("values")), F.col("width"), F.col("height"))


@adapter("conditional_detection", "ade20k_cond")
def conditional(annotations: DataFrame, images: DataFrame, categories: DataFrame, templates: list[str], unit: str = "box", source: str = "conditional") -> DataFrame:
    """One record per picture and class; the question names the class."""
    place, value = (BOXES, G.xywh_to_xyxy(F.col("bbox"))) if unit == "box" else (MASKS, F.col("mask"))
    named = annotations.join((categories.select(F.col("id").alias("category_id"), F.col("name").alias("label"))), "category_id")
    rows = named.groupBy("image_id", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", value.alias("v")))), lambda x: x["v"]).alias("values")).join(images.select(F.col("id").alias("image_id"), "file_name", "width", "height"), "image_id").withColumn("key", F.concat_ws("#", "image_id", "label"))
    groups = F.array(F.sequence(F.lit(0), F.size("values") - 1))
    text = F.concat(F.lit(PHRASE_START), "label", F.lit(PHRASE_END), F.repeat(F.lit(place), F.size("values")), F.lit("."))
    answer = turn("gpt", text, boxes=groups) if unit == "box" else turn("gpt", text, masks=groups)
    return record(rows, source, F.col("file_name"), [turn("human", question(templates, F.col("key"), cls=F.col("label"))), answer], [task("grounding_detection" if unit == "box" else "grounding_segmentation", "phrase", unit=unit)], target(boxes=F.col("values")) if unit == "box" else target(masks=F.col("values")), F.col("width"), F.col("height"))


@adapter("lvis_test")
def lvis_test(images: DataFrame, templates: list[str], source: str = "lvis_test") -> DataFrame:
    """Pictures without known targets; the target is a placeholder box of zeros."""
    rows = images.withColumn("key", F.col("id"))
    return record(rows, source, F.col("file_name"), [turn("human", question(templates, F.col("key"))), turn("gpt", F.lit(""))], [task("detection", "phrase", unit="box")], target(boxes=F.array(F.array(*[F.lit(0.0)] * 4))), F.col("width"), F.col("height"))


@adapter("label_images", "pascal", "pascal59", "pascal459", "cityscapes_semantic")
def label_images(labels: DataFrame, classes: DataFrame, templates: list[str], source: str = "label_images") -> DataFrame:
    """Labels (``path``, ``label``, ``mask``), classes (``class_id``, ``names``): one phrase per class present."""
    rows = labels.join((classes.select(F.col("class_id").alias("label"), F.get("names", F.lit(0)).alias("name"))), "label").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("label", "name", "mask"))).alias("l")).withColumn("key", F.col("path"))
    text = F.concat(F.array_join(F.transform("l", lambda x: F.concat(F.lit(PHRASE_START), x["name"], F.lit(PHRASE_END + MASKS))), ","), F.lit("."))
    groups = F.transform(F.sequence(F.lit(0), F.size("l") - 1), lambda i: F.array(i))
    return record(rows, source, F.col("path"), [turn("human", question(templates, F.col("key"))), turn("gpt", text, masks=groups)], [task("segmentation", "phrase", unit="mask")], target(masks=F.transform("l", lambda x: x["mask"])))


@adapter("cityscapes_instance")
def cityscapes_instance(segments: DataFrame, classes: DataFrame, templates: list[str], source: str = "cityscapes") -> DataFrame:
    """Segments (``path``, ``segment``, ``mask``); instances are numbered from 1000, their class is the thousands."""
    rows = segments.where("segment >= 1000").withColumn("class_id", F.floor(F.col("segment") / 1000).cast("int")).join((classes.select("class_id", F.get("names", F.lit(0)).alias("label"))), "class_id")
    named = rows.select(F.col("segment").cast("bigint").alias("id"), F.col("path").alias("image_id"), F.col("class_id").alias("category_id"), "mask")
    images = segments.select(F.col("path").alias("id")).distinct().select("id", F.col("id").alias("file_name"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
    return detection(named, images, classes.select(F.col("class_id").alias("id"), F.get("names", F.lit(0)).alias("name")), templates, "mask", source=source)


@adapter("png")
def narrative(df: DataFrame, templates: list[str], source: str = "png") -> DataFrame:
    """``file_name``, ``segments`` (``array<struct<utterance, masks>>``): utterances with masks are phrases."""
    some = F.filter("segments", lambda s: F.coalesce(F.size(s["masks"]), F.lit(0)) > 0)
    words = F.array_join(F.transform("segments", lambda s: F.when(F.coalesce(F.size(s["masks"]), F.lit(0)) > 0, F.concat(F.lit(PHRASE_START), s["utterance"], F.lit(PHRASE_END), F.repeat(F.lit(MASKS), F.size(s["masks"])))).otherwise(s["utterance"])), " ")
    before = lambda i: F.aggregate(F.slice(some, 1, i), F.lit(0), lambda a, s: a + F.size(s["masks"]))
    groups = F.transform(some, lambda s, i: F.transform(F.sequence(F.lit(0), F.size(s["masks"]) - 1), lambda k: k + before(i)))
    return record(df, source, F.col("file_name"), [turn("human", question(templates, F.col("key"))), turn("gpt", T.fix_punctuation(words), masks=groups)], [_task(GCG_MASK)], target(masks=F.flatten(F.transform(some, lambda s: s["masks"]))))


@adapter("openpsg", "coco_gcg")
def span_caption(df: DataFrame, templates: list[str], unit: str = "mask", source: str = "openpsg") -> DataFrame:
    """``file_name``, ``caption``, ``groundings`` (``array<struct<start, end, values>>``, character offsets)."""
    place = MASKS if unit == "mask" else BOXES
    before = lambda i: F.aggregate(F.slice("groundings", 1, i), F.lit(0), lambda a, g: a + F.size(g["values"]))
    spans = F.transform("groundings", lambda g, i: F.struct(g["start"].alias("start"), g["end"].alias("end"), F.transform(F.sequence(F.lit(0), F.size(g["values"]) - 1), lambda k: k + before(i)).alias("seq")))
    done = df.withColumn("__m", T.insert_phrases(F.col("caption"), spans, place))
    values = F.flatten(F.transform("groundings", lambda g: g["values"]))
    answer = turn("gpt", F.col("__m.text"), masks=F.col("__m.seq")) if unit == "mask" else turn("gpt", F.col("__m.text"), boxes=F.col("__m.seq"))
    return record(done, source, F.col("file_name"), [turn("human", question(templates, F.col("key"))), answer], [_task(GCG_MASK if unit == "mask" else GCG_BOX)], target(masks=values) if unit == "mask" else target(boxes=values))


@adapter("llava_grounding")
def llava_grounding(df: DataFrame, objects: DataFrame, source: str = "llava_g") -> DataFrame:
    """``image``, ``conversations``, ``gd_ls`` (``array<array<bigint>>``, one list per ``<seg>`` mark); objects: ``id``, ``mask``.

    Ids are joined once; a conversation with a mark inside a phrase, or with more
    marks than lists, is left out.
    """
    ids = df.select("key", F.posexplode("gd_ls").alias("g", "ids")).select("key", "g", F.posexplode("ids").alias("k", "id"))
    found = ids.join(objects, "id").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("g", "k", "mask"))).alias("found"))
    rows = df.join(found, "key").where(F.size(F.flatten("gd_ls")) == F.size("found"))
    marks = F.aggregate(F.transform("conversations", lambda t: T.count_of(t["value"], "<seg>")), F.lit(0), lambda a, n: a + n)
    rows = rows.where(marks == F.size("gd_ls"))
    before = lambda i: F.aggregate(F.transform(F.slice("conversations", 1, i), lambda t: T.count_of(t["value"], "<seg>")), F.lit(0), lambda a, n: a + n)
    start = lambda g: F.aggregate(F.slice("gd_ls", 1, g), F.lit(0), lambda a, x: a + F.size(x))
    groups = lambda t, i: F.transform(F.slice("gd_ls", before(i) + 1, T.count_of(t["value"], "<seg>")), lambda x, k: F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda z: z + start(before(i) + k)))
    turns = F.transform("conversations", lambda t, i: F.struct(t["from"].alias("role"), T.splice(t["value"], "<seg>", T.repeated(groups(t, i), MASKS)).alias("value"), F.lit(None).cast(_SEQ).alias("boxes_seq"), F.when(T.count_of(t["value"], "<seg>") > 0, groups(t, i)).cast(_SEQ).alias("masks_seq"), F.lit(None).cast(_SEQ).alias("points_seq"), F.lit(None).cast(_SEQ).alias("keypoints_seq")).cast(S.TURN))
    return record(rows, source, F.col("image"), turns, F.transform(F.sequence(F.lit(1), F.floor(F.size("conversations") / 2).cast("int")), lambda _: _task(GCG_MASK)), target(masks=F.transform("found", lambda x: x["mask"])))


@adapter("osprey", "osprey_part", "osprey_lvis", "osprey_conversations", "osprey_short", "osprey_detail")
def regions(df: DataFrame, suffix: str = "", source: str = "osprey") -> DataFrame:
    """``file_name``, ``height``, ``width``, ``masks``, ``conversations`` with ``<regionN>`` marks (from 1).

    Marks become mask placeholders with the sequence of the regions they name; conversations with fewer than two turns are left out.
    """
    mark = r"<region(\d+)>"
    ids = lambda t: F.transform(F.regexp_extract_all(t["value"], F.lit(mark), F.lit(1)), lambda x: F.array((x.cast("int") - 1)))
    text = lambda t: F.concat(F.regexp_replace(t["value"], mark, MASKS), F.when(t["from"] == "human", F.lit(suffix)).otherwise(F.lit("")))
    turns = F.transform("conversations", lambda t: F.struct(t["from"].alias("role"), text(t).alias("value"), F.lit(None).cast(_SEQ).alias("boxes_seq"), F.when(F.size(ids(t)) > 0, ids(t)).cast(_SEQ).alias("masks_seq"), F.lit(None).cast(_SEQ).alias("points_seq"), F.lit(None).cast(_SEQ).alias("keypoints_seq")).cast(S.TURN))
    rows = df.where("size(conversations) >= 2")
    return record(rows, source, F.col("file_name"), turns, F.array_repeat(_task(VQA), F.floor(F.size("conversations") / 2).cast("int")), target(masks=F.col("masks")), F.col("width"), F.col("height"))


@adapter("coco_interact", "coco_interact_single", "coco_interact_task")
def interact(anns: DataFrame, templates: list[str], prompt: str | None = None, single: bool = True, most: int = 5, source: str = "interact") -> DataFrame:
    """One row per annotation (``image``, ``width``, ``height``, ``ann_id``, ``label``, ``mask``, ``prompts`` map of kind to mask).

    Each annotation and prompt kind (or only ``prompt``) is a round that asks for the masked object; single
    rounds are records of their own, else up to ``most`` rounds of a picture in hash order are joined.
    """
    each = anns.select("*", F.explode("prompts").alias("kind", "prompt_mask"))
    if prompt:
        each = each.where(F.col("kind") == prompt)
    each = each.withColumn("key", F.concat_ws("#", "image", "ann_id", "kind"))
    answer = F.concat(F.lit(PHRASE_START), F.col("label"), F.lit(PHRASE_END + MASKS + "."))
    if single:
        return record(each, source, F.col("image"), [turn("human", question(templates, F.col("key"), region=F.lit(MASKS)), masks=seq((0,))), turn("gpt", answer, masks=seq((1,)))], [task("grounding_segmentation", "phrase", unit="mask")], target(masks=F.array("prompt_mask", "mask")), F.col("width"), F.col("height"))
    rows = K.sampled_per_group(each, "image", "key", most).withColumn("q", question(templates, F.col("key"), region=F.lit(MASKS))).withColumn("a", answer)
    whole = rows.groupBy("image").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.sort_array(F.collect_list(F.struct(K.shuffle_key("key").alias("h"), "key", "q", "a", "prompt_mask", "mask"))).alias("r")).withColumn("key", F.col("image"))
    turns = F.flatten(F.transform("r", lambda r, i: F.array(turn("human", F.when(i == 0, r["q"]).otherwise(F.replace(r["q"], F.lit(IMAGE), F.lit(""))), masks=F.array(F.array(i * 2))), turn("gpt", r["a"], masks=F.array(F.array(i * 2 + 1))))))
    return record(whole, source, F.col("image"), turns, F.transform("r", lambda _: task("grounding_segmentation", "phrase", unit="mask")), target(masks=F.flatten(F.transform("r", lambda r: F.array(r["prompt_mask"], r["mask"])))), F.col("width"), F.col("height"))


@adapter("coco_keypoints", "coco_keypoints_rec")
def keypoints(annotations: DataFrame, images: DataFrame, templates: list[str], region: bool = False, source: str = "keypoints") -> DataFrame:
    """Annotations (``id``, ``image_id``, ``bbox``, ``keypoints`` flat, ``num_keypoints``): people of a picture, or one by its region."""
    rows = annotations.where("num_keypoints > 0").withColumn("box", G.xywh_to_xyxy(F.col("bbox"))).withColumn("k", F.transform(F.sequence(F.lit(0), (F.size("keypoints") / 3).cast("int") - 1), lambda i: F.slice("keypoints", i * 3 + 1, 3)))
    known = images.select(F.col("id").alias("image_id"), "file_name", "width", "height")
    kind = [task("grounding_keypoints", "phrase", unit="keypoint")]
    if region:
        one = rows.join(known, "image_id").withColumn("key", F.col("id"))
        return record(one, source, F.col("file_name"), [turn("human", question(templates, F.col("key"), region=F.lit(BOXES)), boxes=seq((0,))), turn("gpt", F.lit(f"{PHRASE_START}person{PHRASE_END}{KEYPOINTS}."), keypoints=seq((0,)))], kind, target(boxes=F.array("box"), keypoints=F.array("k")), F.col("width"), F.col("height"))
    people = rows.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("id", "box", "k"))).alias("p"))
    all_images = known.join(people, "image_id", "left").withColumn("key", F.col("image_id")).withColumn("p", F.coalesce("p", F.slice(F.array(F.struct(F.lit(0).cast("bigint").alias("id"), F.array().cast("array<double>").alias("box"), F.array().cast("array<array<double>>").alias("k"))), 1, 0)))
    some = F.size("p") > 0
    groups = F.array(F.sequence(F.lit(0), F.size("p") - 1))
    text = F.when(some, F.concat(F.lit(f"{PHRASE_START}person{PHRASE_END}"), F.repeat(F.lit(BOXES), F.size("p")), F.lit("."))).otherwise(F.lit("There is no person in the image."))
    return record(all_images, source, F.col("file_name"), [turn("human", question(templates, F.col("key"))), turn("gpt", text, boxes=F.when(some, groups), keypoints=F.when(some, groups))], F.array(F.when(some, kind[0]).otherwise(_task(VQA))), target(boxes=F.transform("p", lambda x: x["box"]), keypoints=F.transform("p", lambda x: x["k"])), F.col("width"), F.col("height"))


# --- web-scale grounded captions --------------------------------------------------------------------------------

#: Versions of grounded-caption corpora: caption, detection, conditional detection, referring, region description, grounded caption.
GRIT_VERSIONS = ("c", "d", "cond_d", "r", "g", "c_d", "combine")


def _grit_phrases(df: DataFrame, field: str) -> DataFrame:
    """Noun chunks ``[start, end, x1, y1, x2, y2, score]`` as phrases with pixel boxes, in order of their numbers."""
    part = lambda c, i: F.get(c, F.lit(i))
    chunk = lambda c: F.struct(part(c, 0).cast("int").alias("start"), part(c, 1).cast("int").alias("end"), F.substring(F.col("caption"), (part(c, 0) + 1).cast("int"), (part(c, 1) - part(c, 0)).cast("int")).alias("phrase"), F.array(part(c, 2) * F.col("width"), part(c, 3) * F.col("height"), part(c, 4) * F.col("width"), part(c, 5) * F.col("height")).alias("box"))
    return df.withColumn("__c", F.transform(F.array_sort(F.filter(F.coalesce(field, F.array().cast("array<array<double>>")), lambda c: F.size(c) >= 6)), chunk))


@adapter("grit")
def grit(df: DataFrame, templates: dict[str, list[str]], version: str = "c_d", source: str = "grit") -> DataFrame:
    """One picture's records become one with ``joined_rounds``. Fields: ``width``, ``height``, ``caption``, ``noun_chunks``, ``ref_exps`` (normalised); one record per picture, or per phrase for r and g.

    ``templates`` by version. ``combine`` is the union of the others with the version in the source.
    """
    _one_of(version, GRIT_VERSIONS)
    if version == "combine":
        out = None
        for v in ("c", "d", "cond_d", "r", "g", "c_d"):
            one = grit(df.withColumn("key", F.concat_ws("#", F.col("key").cast("string"), F.lit(v))), templates, v, f"{source}_{v}")
            out = one if out is None else out.unionByName(one)
        return out
    path, size = F.concat(F.split_part(F.col("key").cast("string"), F.lit("#"), F.lit(1)), F.lit(".jpg")), (F.col("width"), F.col("height"))
    if version == "c":
        return record(df, source, path, [turn("human", question(templates["c"], F.col("key"))), turn("gpt", F.col("caption"))], [_task(VQA)], None, *size)
    rows = _grit_phrases(df, "ref_exps" if version == "r" else "noun_chunks").where(F.size("__c") > 0)
    boxes = F.transform("__c", lambda c: c["box"])
    if version == "c_d":
        names = F.array_sort(F.array_distinct(F.transform("__c", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))))
        spans = F.transform(names, lambda n: F.struct(n["start"].alias("start"), n["end"].alias("end"), F.filter(F.transform("__c", lambda c, i: F.when((c["start"] == n["start"]) & (c["end"] == n["end"]), i)), lambda i: i.isNotNull()).alias("seq")))
        done = rows.withColumn("__m", T.insert_phrases(F.col("caption"), spans))
        return record(done, source, path, [turn("human", question(templates["c_d"], F.col("key"))), turn("gpt", F.col("__m.text"), boxes=F.col("__m.seq"))], [_task(GCG_BOX)], target(boxes=boxes), *size)
    if version == "d":
        names = F.array_distinct(F.transform("__c", lambda c: c["phrase"]))
        groups = F.transform(names, lambda n: F.filter(F.transform("__c", lambda c, i: F.when(c["phrase"] == n, i)), lambda i: i.isNotNull()))
        text = F.concat(F.array_join(F.zip_with(names, groups, lambda n, g: F.concat(F.lit(PHRASE_START), n, F.lit(PHRASE_END), F.repeat(F.lit(BOXES), F.size(g)))), ","), F.lit("."))
        return record(rows, source, path, [turn("human", question(templates["d"], F.col("key"))), turn("gpt", text, boxes=groups)], [task("detection", "phrase", unit="box")], target(boxes=boxes), *size)
    each = rows.select("key", "width", "height", F.explode("__c").alias("c")).groupBy("key", "width", "height", F.col("c.phrase").alias("phrase")).agg(F.sort_array(F.collect_list("c.box")).alias("bs")).withColumn("key", F.concat_ws("#", F.col("key").cast("string"), "phrase"))
    groups = F.array(F.sequence(F.lit(0), F.size("bs") - 1))
    found = F.concat(F.lit(PHRASE_START), "phrase", F.lit(PHRASE_END), F.repeat(F.lit(BOXES), F.size("bs")), F.lit("."))
    if version == "g":
        return record(each, source, path, [turn("human", question(templates["g"], F.col("key"), objs=F.repeat(F.lit(BOXES), F.size("bs"))), boxes=groups), turn("gpt", F.col("phrase"))], [_task(VQA)], target(boxes=F.col("bs")), *size)
    slot = {"expr": F.col("phrase")} if version == "r" else {"cls": F.col("phrase")}
    return record(each, source, path, [turn("human", question(templates[version], F.col("key"), **slot)), turn("gpt", found, boxes=groups)], [task("grounding_detection", "phrase", unit="box")], target(boxes=F.col("bs")), *size)


#: Versions of densely annotated corpora; ``mix`` is the union of rounds of all kinds.
GRAND_VERSIONS = ("c", "d", "s", "cond_d", "cond_s", "r_det", "r_seg", "re_det", "re_seg", "c_d", "c_s", "mix")


@adapter("grand")
def grand(df: DataFrame, templates: dict[str, list[str]], version: str = "c_d", use_floating: bool = True, largest: int | None = 10, source: str = "grand") -> DataFrame:
    """``name``, ``width``, ``height``, ``objects`` and ``floating`` (``array<struct<id, bbox, mask, label, attributes, area>>``), ``captions`` (``array<struct<caption, details:array<struct<phrase, start, end, ids>>>>``).

    Objects are looked up by id, floating ones after the others; only the ``largest`` by area have targets.
    """
    _one_of(version, GRAND_VERSIONS)
    if version == "mix":
        out = None
        for v in GRAND_VERSIONS[:-1]:
            if v in templates:
                one = grand(df.withColumn("key", F.concat_ws("#", F.col("key").cast("string"), F.lit(v))), templates, v, use_floating, largest, f"{source}_{v}")
                out = one if out is None else out.unionByName(one)
        return out
    unit = "mask" if version in ("s", "cond_s", "r_seg", "re_seg", "c_s") else "box"
    place = MASKS if unit == "mask" else BOXES
    everything = F.concat("objects", F.coalesce("floating", F.slice(F.col("objects"), 1, 0))) if use_floating else F.col("objects")
    rows = df.withColumn("__o", everything)
    if largest:
        rows = rows.withColumn("__o", F.slice(F.array_sort("__o", lambda a, b: F.when(a["area"] > b["area"], -1).when(a["area"] < b["area"], 1).when(a["id"] < b["id"], -1).otherwise(1)), 1, largest))
    values = lambda os: F.transform(os, lambda o: o["mask" if unit == "mask" else "bbox"])
    aim = lambda os: target(masks=values(os)) if unit == "mask" else target(boxes=values(os))
    said = lambda role, text, groups: turn(role, text, masks=groups) if unit == "mask" else turn(role, text, boxes=groups)
    size, path = (F.col("width"), F.col("height")), F.col("name")
    asked = lambda **slots: question(templates[version], F.col("key"), **slots)
    if version == "c":
        each = rows.select("*", F.posexplode("captions").alias("ci", "c")).withColumn("key", F.concat_ws("#", F.col("key").cast("string"), "ci"))
        return record(each, source, path, [turn("human", asked()), turn("gpt", F.col("c.caption"))], [_task(VQA)], None, *size)
    if version in ("d", "s"):
        named = rows.where(F.size("__o") > 0)
        names = F.array_distinct(F.transform("__o", lambda o: o["label"]))
        groups = F.transform(names, lambda n: F.filter(F.transform("__o", lambda o, i: F.when(o["label"] == n, i)), lambda i: i.isNotNull()))
        text = F.concat(F.array_join(F.zip_with(names, groups, lambda n, g: F.concat(F.lit(PHRASE_START), n, F.lit(PHRASE_END), F.repeat(F.lit(place), F.size(g)))), ","), F.lit("."))
        return record(named, source, path, [turn("human", asked()), said("gpt", text, groups)], [task("detection" if unit == "box" else "segmentation", "phrase", unit=unit)], aim(F.col("__o")), *size)
    if version in ("cond_d", "cond_s"):
        each = rows.select("*", F.explode(F.array_distinct(F.transform("__o", lambda o: o["label"]))).alias("label")).withColumn("__m", F.filter("__o", lambda o: o["label"] == F.col("label"))).withColumn("key", F.concat_ws("#", F.col("key").cast("string"), "label"))
        text = F.concat(F.lit(PHRASE_START), "label", F.lit(PHRASE_END), F.repeat(F.lit(place), F.size("__m")), F.lit("."))
        return record(each, source, path, [turn("human", asked(cls=F.col("label"))), said("gpt", text, F.array(F.sequence(F.lit(0), F.size("__m") - 1)))], [task("grounding_detection" if unit == "box" else "grounding_segmentation", "phrase", unit=unit)], aim(F.col("__m")), *size)
    if version in ("re_det", "re_seg"):
        each = rows.select("*", F.explode(F.filter("__o", lambda o: F.coalesce(F.size(o["attributes"]), F.lit(0)) > 0)).alias("o")).withColumn("key", F.concat_ws("#", F.col("key").cast("string"), F.col("o.id").cast("string")))
        return record(each, source, path, [said("human", asked(objs=F.lit(place), region=F.lit(place)), seq((0,))), turn("gpt", F.get("o.attributes", F.lit(0)))], [_task(VQA)], aim(F.array("o")), *size)
    each = rows.select("*", F.posexplode("captions").alias("ci", "c")).withColumn("key", F.concat_ws("#", F.col("key").cast("string"), "ci"))
    owned = lambda d: F.filter("__o", lambda o: F.array_contains(d["ids"], o["id"]))
    details = F.filter(F.transform("c.details", lambda d: F.struct(d["phrase"].alias("phrase"), d["start"].alias("start"), d["end"].alias("end"), owned(d).alias("os"))), lambda d: F.size(d["os"]) > 0)
    each = each.withColumn("__d", details).where(F.size("__d") > 0)
    if version in ("r_det", "r_seg"):
        one = each.select("*", F.posexplode("__d").alias("di", "d")).withColumn("key", F.concat_ws("#", "key", "di"))
        text = F.concat(F.lit(PHRASE_START), F.col("d.phrase"), F.lit(PHRASE_END), F.repeat(F.lit(place), F.size("d.os")), F.lit("."))
        return record(one, source, path, [turn("human", asked(expr=F.col("d.phrase"))), said("gpt", text, F.array(F.sequence(F.lit(0), F.size("d.os") - 1)))], [task("grounding_detection" if unit == "box" else "grounding_segmentation", "phrase", unit=unit)], aim(F.col("d.os")), *size)
    before = lambda i: F.aggregate(F.slice("__d", 1, i), F.lit(0), lambda a, d: a + F.size(d["os"]))
    spans = F.transform("__d", lambda d, i: F.struct(d["start"].alias("start"), d["end"].alias("end"), F.transform(F.sequence(F.lit(0), F.size(d["os"]) - 1), lambda k: k + before(i)).alias("seq")))
    done = each.withColumn("__m", T.insert_phrases(F.col("c.caption"), spans, place)).withColumn("__f", F.flatten(F.transform("__d", lambda d: d["os"])))
    return record(done, source, path, [turn("human", asked()), said("gpt", F.col("__m.text"), F.col("__m.seq"))], [_task(GCG_MASK if unit == "mask" else GCG_BOX)], aim(F.col("__f")), *size)


# --- depth and single records -----------------------------------------------------------------------------------


@adapter("kitti", "nyu", "hrwsi")
def depth(df: DataFrame, templates: list[str], source: str = "depth") -> DataFrame:
    """``rgb_path``, ``depth_path``: the depth map is a target by its path."""
    return record(df, source, F.col("rgb_path"), [turn("human", question(templates, F.col("key"))), turn("gpt", F.lit("<depth>"))], [task("depth", unit="depth")], target(depth=F.array("depth_path")))


@adapter("single")
def single(df: DataFrame, source: str = "single") -> DataFrame:
    """``image``, ``question``, ``task_name``: one open question."""
    return record(df, source, F.col("image"), [turn("human", F.col("question")), turn("gpt", F.lit(""))], [F.struct(F.col("task_name"), F.array().cast("array<string>").alias("element"), F.lit(False).alias("use_unit"), F.lit(None).cast("array<string>").alias("unit")).cast(S.SYSTEM)])


def joined_rounds(sample: DataFrame, key: Column, order: Column, source: str) -> DataFrame:
    """Records of one picture as one record with all their rounds (A65, P21-P23): in the order given, targets one after the other.

    Sequences are counted on by the targets of the rounds before; the picture's mark
    stays in the first question only. Path and size are those of the first record.
    ``key`` names the picture, ``order`` the place of a record within it.
    """
    fields = {"boxes": "boxes_seq", "masks": "masks_seq", "points": "points_seq", "keypoints": "keypoints_seq"}
    rows = sample.groupBy(key.cast("string").alias("key")).agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.struct("image", "target", "system", "turns").alias("r")))).alias("l")).withColumn("l", F.transform("l", lambda x: x["r"]))
    size = lambda a: F.greatest(F.coalesce(F.size(a), F.lit(0)), F.lit(0))
    # how many targets of each kind stand before a record
    start = lambda i, t: F.aggregate(F.slice("l", 1, i), F.lit(0), lambda s, r: s + size(r["target"][t]))

    def moved(turn_: Column, k: Column, i: Column) -> Column:
        shift = lambda t, s: F.transform(turn_[s], lambda g: F.transform(g, lambda x: F.when(x < 0, x).otherwise(x + start(i, t))))
        value = F.when((turn_["role"] == "human") & ((i > 0) | (k > 0)), F.trim(F.replace(turn_["value"], F.lit(IMAGE), F.lit("")))).otherwise(turn_["value"])
        return F.struct(turn_["role"].alias("role"), value.alias("value"), *[shift(t, s).alias(s) for t, s in fields.items()]).cast(S.TURN)

    turns = F.flatten(F.transform("l", lambda r, i: F.transform(r["turns"], lambda t, k: moved(t, k, i))))
    whole = lambda t: F.when(F.exists("l", lambda r: r["target"][t].isNotNull()), F.flatten(F.transform(F.filter("l", lambda r: r["target"][t].isNotNull()), lambda r: r["target"][t])))
    first = F.get("l", F.lit(0))
    return rows.select(
        F.col("key").alias("sample_id"), F.lit(source).alias("source"), first["image"].alias("image"),
        F.struct(*[whole(t).alias(t) for t in ("boxes", "points", "masks", "keypoints", "depth")]).cast(S.TARGET).alias("target"), F.flatten(F.transform("l", lambda r: r["system"])).alias("system"), turns.alias("turns"),
    )


def normalised(sample: DataFrame) -> DataFrame:
    """Targets in the padded square, as parts of its side (G20, lifecycle step ``target_process``); records without a size keep theirs."""
    w, h = F.col("image.width"), F.col("image.height")
    side = F.greatest(w, h)
    known = w.isNotNull() & h.isNotNull()
    boxes = F.when(known, F.transform("target.boxes", lambda b: G.normalize_box(G.expand_box(b, w, h), side, side))).otherwise(F.col("target.boxes"))
    points = F.when(known, F.transform("target.points", lambda p: G.normalize_point(G.expand_point(p, w, h), side, side))).otherwise(F.col("target.points"))
    return sample.withColumn("target", F.struct(boxes.alias("boxes"), points.alias("points"), F.col("target.masks").alias("masks"), F.col("target.keypoints").alias("keypoints"), F.col("target.depth").alias("depth")).cast(S.TARGET))


def compiled_rounds(sample: DataFrame, use_cot: bool = True) -> DataFrame:
    """Rounds of canonical records, ready for a template (lifecycle of 3.5)."""
    return sample.select("sample_id", "source", C.compiled(F.col("turns"), F.col("system"), use_cot).alias("rounds"))
