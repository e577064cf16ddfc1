"""Queries over sources: adapters to canonical records, sinks read back, and picture-level shapes.

Raw records of each kind are made from the tables (labelled boxes of pictures,
captions, questions), go through the registered adapter, and come out as one row
per record: its path, question, answer, sequences, task and number of targets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import masks as M
from ..functions import text as T
from ..operators import inference as I
from ..runtime import checkpoint_dir, table
from ..sources import adapters as A
from ..sources import readers as R
from . import fixtures as X
from .dialogue import samples

ASK = ["What is shown?", "Please describe the picture.", "Tell me about this image."]
FIND = ["Where is <expr>?", "Find <expr>."]
NAME = ["What is <objs>?", "Name <objs>.", "Say what <objs> is."]
CLASS = ["Find all <cls>.", "Where are the <cls>?"]
QA = ["<question>", "Please answer: <question>"]
REGION = ["What is in <region>?", "Segment <region>."]


def _groups(turns: Column) -> Column:
    """Sequences of all turns as text, those of one turn in order of their kind."""
    kinds = ("boxes_seq", "masks_seq", "points_seq", "keypoints_seq")
    one = lambda t: F.concat_ws(";", *[F.transform(F.coalesce(t[k], F.array().cast("array<array<int>>")), lambda g: F.array_join(g.cast("array<string>"), ",")) for k in kinds])
    return F.array_join(F.transform(turns, one), "|")


def _shown(sample: DataFrame) -> DataFrame:
    """What a canonical record says, as plain columns."""
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    n = sum((F.greatest(count(f"target.{k}"), F.lit(0)) for k in ("boxes", "masks", "points", "keypoints", "depth")), F.lit(0))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), F.coalesce(t["value"], F.lit("")))), "\n")
    tasks = F.array_join(F.transform("system", lambda s: s["task_name"]), ",")
    return sample.select("source", "sample_id", F.col("image.path").alias("path"), said.alias("said"), _groups(F.col("turns")).alias("groups"), tasks.alias("tasks"), n.cast("int").alias("n_targets"))


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Boxes with the name of their class: ``ann_id``, ``image_id``, ``category_id``, ``label``, ``w``, ``h``, ``box``, ``bbox``."""
    names = table(spark, d, "categories", "category_id", "cat_name").where("cat_name is not null").select("category_id", F.lower(F.trim("cat_name")).alias("label"))
    return X.boxes(spark, d).join(names, "category_id").withColumn("bbox", G.xyxy_to_xywh(F.col("box")))


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    """Pictures with their labelled boxes in order of key: ``key``, ``w``, ``h``, ``objs``."""
    return _labelled(spark, d).groupBy(F.col("image_id").alias("key")).agg(F.first("w").alias("w"), F.first("h").alias("h"), F.sort_array(F.collect_list(F.struct("ann_id", "label", "box"))).alias("objs"))


def _path(key: str = "key") -> Column:
    return F.concat(F.col(key).cast("string"), F.lit(".jpg"))


def _qa(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items", "item_id", "question", "answer", "passage").dropDuplicates(["item_id"]).where("question is not null and answer is not null").withColumnRenamed("item_id", "key").withColumn("image", _path())


def _coco(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = _labelled(spark, d)
    annotations = b.select(F.col("ann_id").alias("id"), "image_id", "category_id", "bbox")
    pictures = X.images(spark, d).where("w is not null and h is not null").select(F.col("image_id").alias("id"), _path("image_id").alias("file_name"), F.col("w").cast("int").alias("width"), F.col("h").cast("int").alias("height"))
    names = table(spark, d, "categories", "category_id", "cat_name").where("cat_name is not null").select(F.col("category_id").alias("id"), F.lower(F.trim("cat_name")).alias("name"))
    return annotations, pictures, names


def adapt_captions(spark: SparkSession, d: str) -> DataFrame:
    """Documents as captions of their pictures, by path and through the table of pictures; texts by digest."""
    docs = table(spark, d, "documents", "doc_id", "text", "image_id").where("text is not null and image_id is not null")
    direct = A.load("caption", docs.select(F.col("doc_id").alias("key"), F.col("text").alias("caption"), T.zero_fill(F.col("image_id")).alias("img_path")), templates=ASK)
    joined = A.load("nocaps", docs.select(F.col("doc_id").alias("key"), F.col("text").alias("caption"), "image_id"), images=X.images(spark, d).select(F.col("image_id").alias("id"), "file_name"), templates=ASK)
    return _shown(_union(direct, joined)).withColumn("said", F.md5("said"))


def adapt_questions(spark: SparkSession, d: str) -> DataFrame:
    """Answered questions in the layouts of four corpora."""
    q = _qa(spark, d)
    answer = F.col("answer")
    return _shown(_union(
        A.load("vqav2", q.select("key", F.col("image").alias("image_path"), "question", F.struct(answer.alias("multiple_choice_answer")).alias("annotation")), templates=QA),
        A.load("vqae", q.select("key", F.col("image").alias("file_path"), "question", F.array("passage").alias("explanation"), answer.alias("multiple_answers")), templates=QA),
        A.load("okvqa", q.select("key", F.col("image").alias("image_name"), "question", F.array(answer, F.lit("else")).alias("answers")), templates=QA),
        A.load("pope", q.select("key", "image", F.col("question").alias("text"), answer.alias("label")), templates=QA),
    ))


def adapt_flickr(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of marked phrases, one per class of a picture; with placeholders and plain."""
    p = _pictures(spark, d)
    names = F.array_distinct(F.transform("objs", lambda o: o["label"]))
    groups = F.transform(names, lambda n: F.filter(F.transform("objs", lambda o, i: F.when(o["label"] == n, i)), lambda i: i.isNotNull()))
    rows = p.select("key", F.col("key").cast("string").alias("image_id"), F.array_join(F.transform(names, lambda n: F.concat(F.lit("<ph_st>"), n, F.lit("<ph_ed>"))), " , ").alias("sentence"), F.transform("objs", lambda o: o["box"]).alias("boxes"), groups.alias("boxes_seq"))
    return _shown(_union(A.load("flickr", rows, templates=ASK, plain=ASK[:1]), A.load("flickr_caption", rows, templates=ASK)))


def adapt_referring(spark: SparkSession, d: str) -> DataFrame:
    """Every labelled box as an expression to find, and as a region to name."""
    rows = _labelled(spark, d).select(F.col("ann_id").alias("key"), _path("image_id").alias("img_path"), F.col("label").alias("expression"), F.col("box").alias("bbox"))
    return _shown(_union(A.load("rec", rows, templates=FIND), A.load("rec", rows, templates=FIND, stage=1, named_target=True, source="rec1"), A.load("reg", rows, templates=NAME)))


def adapt_detection(spark: SparkSession, d: str) -> DataFrame:
    """All boxes of a picture by class, and pictures to be tested on."""
    annotations, pictures, names = _coco(spark, d)
    return _shown(_union(A.load("coco_rem", annotations, images=pictures, categories=names, templates=ASK), A.load("lvis_test", pictures, templates=ASK)))


def adapt_conditional(spark: SparkSession, d: str) -> DataFrame:
    """The boxes of one class of a picture."""
    annotations, pictures, names = _coco(spark, d)
    return _shown(A.load("conditional_detection", annotations, images=pictures, categories=names, templates=CLASS))


def adapt_point_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions on a box, on its centre, or by a coin on either."""
    b = _labelled(spark, d)
    centre = G.xyxy_to_center(F.col("box"))
    rows = b.select(F.col("ann_id").alias("key"), _path("image_id").alias("file_path"), F.lit("What is this ").alias("question"), F.col("label").alias("answer"), F.col("box").alias("bbox"), F.array(F.get(centre, F.lit(0)), F.get(centre, F.lit(1))).alias("point"))
    return _shown(_union(*[A.load("point_qa_local", rows, templates=QA, version=v, source=f"point_{v}") for v in ("b", "p", "bp")]))


def adapt_pointing(spark: SparkSession, d: str) -> DataFrame:
    """Which of the boxes of a picture is meant; the candidates in order."""
    rows = _pictures(spark, d).where("size(objs) >= 2").select("key", _path().alias("file_path"), F.concat(F.lit("Which is the "), F.get("objs", F.lit(0))["label"], F.lit("?")).alias("question"), F.transform("objs", lambda o: o["box"]).alias("candidates"), F.get("objs", F.lit(0))["box"].alias("answer"), F.lit(None).cast("array<double>").alias("point"))
    return _shown(A.load("v7w_point", rows, templates=QA, shuffle=False))


def adapt_choices(spark: SparkSession, d: str) -> DataFrame:
    """Questions with lettered options, and each with every option forced."""
    word = lambda w, ids=None: F.struct(w.alias("word"), (ids if ids is not None else F.lit(None)).cast("array<int>").alias("ids"))
    label = lambda k: F.get("objs", F.lit(k))["label"]
    rows = _pictures(spark, d).where("size(objs) >= 2").select(
        "key", _path().alias("img_fn"), F.transform("objs", lambda o: o["box"]).alias("boxes"), F.array(word(F.lit("What")), word(F.lit("is")), word(F.lit("at")), word(F.lit(""), F.array(F.lit(0)))).alias("question"),
        F.array(F.array(word(label(0))), F.array(word(label(1)), word(F.lit(""), F.array(F.lit(1)))), F.array(word(F.lit("nothing"))), F.array(word(F.lit("all")))).alias("answer_choices"),
        F.array(F.array(word(F.lit("I"))), F.array(word(F.lit("see"))), F.array(word(F.lit("it"))), F.array(word(F.lit("there")))).alias("rationale_choices"), F.pmod(F.col("key"), F.lit(2)).cast("int").alias("answer_label"), F.lit(3).alias("rationale_label"),
    )
    return _shown(_union(A.load("vcr", rows, templates=QA), A.load("vcr", rows, templates=QA, version="qc-a", source="vcr_qc"), A.load("vcr_predictions", rows, templates=QA)))


def adapt_instructions(spark: SparkSession, d: str) -> DataFrame:
    """Conversations taken over as they are; texts by digest."""
    s = samples(spark, d).where("turns is not null")
    rows = s.select(F.col("sample_id").alias("key"), F.when(F.pmod("sample_id", F.lit(3)) > 0, _path("sample_id")).alias("image"), F.transform("turns", lambda t: F.struct(t["role"].alias("from"), t["value"].alias("value"))).alias("conversations"))
    return _shown(A.load("instruct", rows, prefix="coco/")).withColumn("said", F.md5("said"))


def adapt_label_images(spark: SparkSession, d: str) -> DataFrame:
    """The classes of a picture as masks; pixels of the targets."""
    b = _labelled(spark, d).where(G.valid_box(F.col("box")))
    first = b.groupBy("image_id", "category_id").agg(F.min_by("box", "ann_id").alias("box"), F.first("w").alias("w"), F.first("h").alias("h"))
    labels = first.select(_path("image_id").alias("path"), F.col("category_id").alias("label"), M.box_mask(F.col("box"), F.col("w").cast("int"), F.col("h").cast("int")).alias("mask"))
    classes = table(spark, d, "categories", "category_id", "cat_name").where("cat_name is not null").select(F.col("category_id").alias("class_id"), F.array(F.lower(F.trim("cat_name"))).alias("names"))
    return _shown(A.load("label_images", labels, classes=classes, templates=ASK))


def adapt_instances(spark: SparkSession, d: str) -> DataFrame:
    """Instance numbers whose thousands are the class; smaller ones are no instances."""
    b = _labelled(spark, d)
    segments = b.select(_path("image_id").alias("path"), F.when(F.pmod("ann_id", F.lit(5)) == 0, F.col("category_id")).otherwise(F.col("category_id") * 1000 + F.pmod("ann_id", F.lit(997))).cast("long").alias("segment"), F.lit(None).cast("struct<h:int,w:int,counts:array<int>>").alias("mask")).distinct()
    classes = table(spark, d, "categories", "category_id", "cat_name").where("cat_name is not null").select(F.col("category_id").alias("class_id"), F.array(F.lower(F.trim("cat_name"))).alias("names"))
    return _shown(A.load("cityscapes_instance", segments, classes=classes, templates=ASK))


def _no_mask() -> Column:
    return F.lit(None).cast("struct<h:int,w:int,counts:array<int>>")


def adapt_narratives(spark: SparkSession, d: str) -> DataFrame:
    """Utterances of a picture, every other with its segments."""
    rows = _pictures(spark, d).select("key", _path().alias("file_name"), F.transform("objs", lambda o, i: F.struct(o["label"].alias("utterance"), F.when(i % 2 == 0, F.array_repeat(_no_mask(), i % 3 + 1)).alias("masks"))).alias("segments"))
    return _shown(A.load("png", rows, templates=ASK))


def phrase_insert(spark: SparkSession, d: str) -> DataFrame:
    """Phrases marked in a caption by their offsets."""
    p = _pictures(spark, d).withColumn("objs", F.slice("objs", 1, 3))
    caption = F.array_join(F.transform("objs", lambda o: o["label"]), " and ")
    before = lambda i: F.aggregate(F.slice("objs", 1, i), F.lit(0), lambda s, o: s + F.length(o["label"]) + 5)
    rows = p.select("key", _path().alias("file_name"), caption.alias("caption"), F.transform("objs", lambda o, i: F.struct(before(i).alias("start"), (before(i) + F.length(o["label"])).alias("end"), F.array(o["box"]).alias("values"))).alias("groundings"))
    return _shown(A.load("openpsg", rows, templates=ASK, unit="box"))


def adapt_grounded_dialogues(spark: SparkSession, d: str) -> DataFrame:
    """Marks in conversations replaced by the segments of their id lists; an id without object drops the record."""
    p = _pictures(spark, d)
    said = lambda role, value: F.struct(F.lit(role).alias("from"), value.alias("value"))
    label = lambda k: F.get("objs", F.lit(k))["label"]
    rows = p.where("size(objs) >= 3").select("key", _path().alias("image"), F.array(said("human", F.lit("What is here?")), said("gpt", F.concat(F.lit("A "), label(0), F.lit(" <seg> and a "), label(1), F.lit(" <seg>."))), said("human", F.lit("More?")), said("gpt", F.concat(label(2), F.lit(".")))).alias("conversations"), F.array(F.array(F.get("objs", F.lit(0))["ann_id"]), F.transform(F.slice("objs", 2, 2), lambda o: o["ann_id"])).alias("gd_ls"))
    objects = _labelled(spark, d).where("ann_id % 7 > 0").select(F.col("ann_id").alias("id"), _no_mask().alias("mask"))
    return _shown(A.load("llava_grounding", rows, objects=objects))


def adapt_regions(spark: SparkSession, d: str) -> DataFrame:
    """Conversations about numbered regions."""
    said = lambda role, value: F.struct(F.lit(role).alias("from"), value.alias("value"))
    label = lambda k: F.get("objs", F.lit(k))["label"]
    two = F.size("objs") >= 2
    rows = _pictures(spark, d).select("key", _path().alias("file_name"), F.col("h").cast("int").alias("height"), F.col("w").cast("int").alias("width"), F.transform("objs", lambda _: _no_mask()).alias("masks"), F.when(two, F.array(said("human", F.lit("What are <region1> and <region2>?")), said("gpt", F.concat(F.lit("<region2> is "), label(1), F.lit("."))))).otherwise(F.array(said("human", F.lit("<region1>?")))).alias("conversations"))
    return _shown(A.load("osprey", rows, suffix=" Answer shortly."))


def adapt_interaction(spark: SparkSession, d: str) -> DataFrame:
    """Every object asked for by each kind of prompt."""
    rows = _labelled(spark, d).select(_path("image_id").alias("image"), F.col("w").cast("int").alias("width"), F.col("h").cast("int").alias("height"), "ann_id", "label", _no_mask().alias("mask"), F.map_from_arrays(F.array(F.lit("point"), F.lit("box")), F.array(_no_mask(), _no_mask())).alias("prompts"))
    return _shown(_union(A.load("coco_interact", rows, templates=REGION), A.load("coco_interact_task", rows, templates=REGION, prompt="box", source="interact_box")))


def adapt_keypoints(spark: SparkSession, d: str) -> DataFrame:
    """People of every picture, those without annotated points left out, and each by its region."""
    b = _labelled(spark, d)
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.array(F.get("box", F.lit(0)) + k, F.get("box", F.lit(1)) + k, F.lit(2.0))))
    people = b.select(F.col("ann_id").alias("id"), "image_id", "bbox", flat.alias("keypoints"), F.pmod("ann_id", F.lit(3)).cast("int").alias("num_keypoints"))
    _, pictures, _ = _coco(spark, d)
    return _shown(_union(A.load("coco_keypoints", people, images=pictures, templates=ASK), A.load("coco_keypoints_rec", people, images=pictures, templates=REGION, region=True, source="keypoints_rec")))


def adapt_web_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions with noun chunks and normalised boxes, in the versions of their corpus."""
    p = _pictures(spark, d).withColumn("objs", F.slice("objs", 1, 2))
    at = lambda o, i, n: F.get(o["box"], F.lit(i)) / F.col(n)
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.length(F.get("objs", F.lit(0))["label"]) + 6)
    chunks = F.transform("objs", lambda o, i: F.array(start(i).cast("double"), (start(i) + F.length(o["label"])).cast("double"), at(o, 0, "w"), at(o, 1, "h"), at(o, 2, "w"), at(o, 3, "h"), F.lit(0.9)))
    rows = p.select("key", F.col("w").cast("int").alias("width"), F.col("h").cast("int").alias("height"), F.array_join(F.transform("objs", lambda o: o["label"]), " near ").alias("caption"), chunks.alias("noun_chunks"), chunks.alias("ref_exps"))
    return _shown(A.load("grit", rows, version="combine", templates={"c": ASK, "d": ASK, "c_d": ASK, "cond_d": CLASS, "r": FIND, "g": NAME}))


def adapt_dense_captions(spark: SparkSession, d: str) -> DataFrame:
    """Densely annotated pictures in every version; the largest objects have targets."""
    p = _pictures(spark, d)
    objects = F.transform("objs", lambda o, i: F.struct(i.cast("long").alias("id"), o["box"].alias("bbox"), _no_mask().alias("mask"), o["label"].alias("label"), F.when(o["ann_id"] % 2 == 0, F.array(F.concat(F.lit("a "), o["label"]))).otherwise(F.array().cast("array<string>")).alias("attributes"), (-i).cast("double").alias("area")))
    first = F.get("objs", F.lit(0))["label"]
    captions = F.array(F.struct(F.concat(F.lit("Here: "), first, F.lit(".")).alias("caption"), F.array(F.struct(first.alias("phrase"), F.lit(6).alias("start"), (F.length(first) + 6).alias("end"), F.array(F.lit(0).cast("long"), F.lit(99_999).cast("long")).alias("ids"))).alias("details")))
    rows = p.select(F.col("key"), _path().alias("name"), F.col("w").cast("int").alias("width"), F.col("h").cast("int").alias("height"), objects.alias("objects"), F.slice(objects, 1, 0).alias("floating"), captions.alias("captions"))
    asked = {"c": ASK, "d": ASK, "s": ASK, "c_d": ASK, "c_s": ASK, "cond_d": CLASS, "cond_s": CLASS, "r_det": FIND, "r_seg": FIND, "re_det": NAME, "re_seg": NAME}
    return _shown(A.load("grand", rows, version="mix", templates=asked, largest=4))


def adapt_joined(spark: SparkSession, d: str) -> DataFrame:
    """Caption, detection, referring and grounded caption of a picture as the rounds of one record, sequences counted on."""
    p = _pictures(spark, d)
    objects = F.transform("objs", lambda o, i: F.struct(i.cast("long").alias("id"), o["box"].alias("bbox"), _no_mask().alias("mask"), o["label"].alias("label"), F.array().cast("array<string>").alias("attributes"), (-i).cast("double").alias("area")))
    first = F.get("objs", F.lit(0))["label"]
    captions = F.array(F.struct(F.concat(F.lit("Here: "), first, F.lit(".")).alias("caption"), F.array(F.struct(first.alias("phrase"), F.lit(6).alias("start"), (F.length(first) + 6).alias("end"), F.array(F.lit(0).cast("long")).alias("ids"))).alias("details")))
    rows = p.select(F.col("key"), _path().alias("name"), F.col("w").cast("int").alias("width"), F.col("h").cast("int").alias("height"), objects.alias("objects"), F.slice(objects, 1, 0).alias("floating"), captions.alias("captions"))
    each = A.load("grand", rows, version="mix", templates={"c": ["<image> What?"], "d": ["<image> Find all."], "r_det": FIND[1:], "c_d": ASK[:1]}, largest=4)
    order = F.array_position(F.array(*[F.lit(f"grand_{v}") for v in ("c", "d", "r_det", "c_d")]), F.col("source"))
    return _shown(A.joined_rounds(each, F.split_part("sample_id", F.lit("#"), F.lit(1)), order, "grand_mix"))


def adapt_depth(spark: SparkSession, d: str) -> DataFrame:
    """Pictures paired with their depth maps by name, and single open questions."""
    names = X.images(spark, d).select(F.concat(F.lit("rgb/"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("path"), "image_id")
    maps = names.where("image_id % 4 > 0").select(F.concat(F.lit("depth/"), F.col("image_id").cast("string"), F.lit(".png")).alias("path"))
    pairs = R.paired_depth(names.select("path"), maps, R.same_stem).withColumn("key", T.stem(F.col("rgb_path")))
    single = X.images(spark, d).select(F.col("image_id").alias("key"), _path("image_id").alias("image"), F.lit(ASK[0]).alias("question"), F.lit("vqa").alias("task_name"))
    return _shown(_union(A.load("kitti", pairs, templates=ASK), A.load("single", single)))


def target_process(spark: SparkSession, d: str) -> DataFrame:
    """Targets of a record in its padded square, as parts of the side; sums per record."""
    rows = _labelled(spark, d).select(F.col("ann_id").alias("key"), _path("image_id").alias("img_path"), F.col("label").alias("expression"), F.col("box").alias("bbox"), "w", "h")
    sample = A.load("rec", rows.drop("w", "h"), templates=FIND).join(rows.select(F.col("key").cast("string").alias("sample_id"), "w", "h"), "sample_id")
    sized = sample.withColumn("image", F.struct(F.col("image.path").alias("path"), F.col("w").cast("int").alias("width"), F.col("h").cast("int").alias("height")))
    box = F.get("target.boxes", F.lit(0))
    return A.normalised(sized).select("sample_id", *[F.get(box, F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def sink_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Answers as lines of JSON and detections as arrays per picture, written, and read back."""
    folder = f"{checkpoint_dir(spark)}/sinks-{uuid.uuid4().hex}"
    rows = samples(spark, d).select(F.explode("turns").alias("t")).where("t.value is not null").select(F.col("t.value").alias("pred"), F.col("t.role").alias("target"))
    R.write_pairs(rows, f"{folder}/pairs")
    back = R.json_lines(spark, f"{folder}/pairs", "pred string, target string").where("_corrupt_record is null")
    found = X.annotations(spark, d).where("image_id is not null and score is not null and size(bbox) = 4 and category_id is not null").select("image_id", "category_id", "bbox", "score")
    R.write_results(found, f"{folder}/results")
    read = R.read_results(spark, f"{folder}/results")
    pairs = back.groupBy(F.col("target").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("pred")).cast("double").alias("total"))
    return pairs.unionByName(read.agg(F.lit("detections").alias("part"), F.count(F.lit(1)).alias("n"), G.rounded(F.sum("score"), 3).alias("total")))


#: Size of the grid on which the stand-in model of ``panoptic_merge`` scores a picture.
GRID = (6, 8)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Raw scores as of a model, a query per box: 5 for its class (of 6, the last for none), 3 in the cells whose centre it holds."""
    h, w = GRID
    p = X.boxes(spark, d).where("category_id is not null").groupBy("image_id").agg(F.first("w").alias("pw"), F.first("h").alias("ph"), F.sort_array(F.collect_list(F.struct("ann_id", "category_id", "box"))).alias("objs"))
    side = lambda o, i: F.get(o["box"], F.lit(i))
    inside = lambda o, k: (((k % w) + 0.5) * F.col("pw") / w).between(side(o, 0), side(o, 2)) & ((F.floor(k / w) + 0.5) * F.col("ph") / h).between(side(o, 1), side(o, 3))
    classes = F.transform("objs", lambda o: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda c: F.when(c == o["category_id"] % 6, 5.0 - F.pmod(o["ann_id"], F.lit(101)) / 50).otherwise(-5.0)))
    masks = F.transform("objs", lambda o: F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda k: F.when(inside(o, k), 3.0).otherwise(-3.0)))
    return p.select("image_id", F.lit(h).alias("h"), F.lit(w).alias("w"), classes.alias("classes"), masks.alias("masks"))


def panoptic_merge(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the pictures that share no pixel."""
    s = I.panoptic_segments(_scored(spark, d), [0, 1, 2], 0.5)
    return s.select("image_id", F.col("segment").cast("int").alias("segment"), F.col("category_id").cast("int").alias("category_id"), "thing", F.array_join(F.col("pixels").cast("array<string>"), ",").alias("pixels"))


def instance_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best instances of every picture."""
    r = I.instance_rows(_scored(spark, d), [0, 1, 2], 10)
    return r.select("image_id", F.col("query").cast("int").alias("query"), F.col("category_id").cast("int").alias("category_id"), G.rounded(F.col("score"), 6).alias("score"), F.aggregate(F.transform("counts", lambda n, i: F.when(i % 2 == 1, n).otherwise(0)), F.lit(0), lambda a, n: a + n).alias("n_pixels"))


def semantic_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest class of every cell; cells per class and picture."""
    s = I.semantic_labels(_scored(spark, d))
    return s.groupBy("image_id", F.col("category_id").cast("int").alias("category_id")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        adapt_captions, adapt_questions, adapt_flickr, adapt_referring, adapt_detection, adapt_conditional, adapt_point_questions, adapt_pointing, adapt_choices, adapt_instructions, adapt_label_images, adapt_instances, adapt_narratives, phrase_insert,
        adapt_grounded_dialogues, adapt_regions, adapt_interaction, adapt_keypoints, adapt_web_captions, adapt_dense_captions, adapt_joined, adapt_depth, target_process, sink_roundtrip, panoptic_merge, instance_topk, semantic_argmax,
    )
}

from .boxes import _norm  # noqa: E402
from .dialogue import _TURNS  # noqa: E402

_LAB = f"""{X.BOXES}, lab_ as (select b.*, lower(trim(c.cat_name)) as label, b.image_id || '.jpg' as path from boxes_ b join categories c on b.category_id = c.category_id where c.cat_name is not null),
  num_ as (select *, row_number() over (partition by image_id order by ann_id) - 1 as pos from lab_), pic_ as (select image_id as key, image_id || '.jpg' as path, count(*) as n, list(label order by ann_id) as ls, list(ann_id order by ann_id) as ids from lab_ group by image_id)"""
_COLS = "source, sample_id, path, said, groups, tasks, n_targets"


def _ask(templates: list[str], key: str, **slots: str) -> str:
    """SQL of a question template chosen by the hash of its key."""
    text = f"([{', '.join(repr(t) for t in templates)}])[cast('0x' || substring(md5('42:' || {key}), 1, 8) as bigint) % {len(templates)} + 1]"
    for name, value in slots.items():
        text = f"replace({text}, '<{name}>', {value})"
    return text


def _row(source: str, key: str, path: str, human: str, gpt: str, groups: str, tasks: str, n: str, rest: str) -> str:
    """SQL of a record with one round."""
    return f"select {source} as source, cast({key} as varchar) as sample_id, {path} as path, 'human: ' || {human} || chr(10) || 'gpt: ' || coalesce({gpt}, '') as said, {groups} as groups, {tasks} as tasks, cast({n} as int) as n_targets from {rest}"


_UPTO = "array_to_string(range(0, {0}), ',')"
_VQA, _DET, _GDET, _GSEG = "'vqa'", "'detection'", "'grounding_detection'", "'grounding_segmentation'"
_DOCS = "documents where text is not null and image_id is not null"
_FILL = "case when len(cast(image_id as varchar)) >= 12 then cast(image_id as varchar) else lpad(cast(image_id as varchar), 12, '0') end"
_ITEMS = "q_ as (select item_id, any_value(question) as question, any_value(answer) as answer, any_value(passage) as passage from eval_items group by 1 having any_value(question) is not null and any_value(answer) is not null)"
_CLS = "g_ as (select image_id, label, min(pos) as f, count(*) as n, list(pos order by pos) as ps from num_ group by image_id, label), s_ as (select image_id, string_agg('<Phrase>' || label || '</Phrase>' || repeat('<boxes>', n), '{0}' order by f) as t, string_agg(label, ', ' order by f) as bare, string_agg(array_to_string(ps, ','), ';' order by f) as gs, cast(sum(n) as bigint) as n from g_ group by image_id)"
_ask_item = _ask(QA, "item_id", question="question")

SQL = {
    "adapt_captions": f"""with {X.IMAGES}, u_ as ({_row("'caption'", "doc_id", _FILL, _ask(ASK, "doc_id"), "text", "'|'", _VQA, "0", _DOCS)} union all {_row("'nocaps'", "doc_id", "file_name", _ask(ASK, "doc_id"), "text", "'|'", _VQA, "0", "(select d.*, i.file_name from documents d join images_ i on d.image_id = i.image_id where d.text is not null)")})
        select source, sample_id, path, md5(said) as said, groups, tasks, n_targets from u_""",
    "adapt_questions": f"with {_ITEMS} " + " union all ".join(_row(f"'{s}'", "item_id", "item_id || '.jpg'", _ask_item, a, "'|'", _VQA, "0", "q_") for s, a in (("vqav2", "'The answer is ' || answer || '.'"), ("vqae", "passage || ' So the answer is ' || answer || '.'"), ("okvqa", "'The answer is ' || answer || '.'"), ("pope", "'The answer is ' || lower(answer) || ' .'"))),
    "adapt_flickr": f"""with {_LAB}, {_CLS.format(" , ")} {_row("'flickr'", "image_id", "image_id || '.jpg'", _ask(ASK, "image_id"), "t", "'|' || gs", "'gcg_detection'", "n", "s_")} union all {_row("'flickr_caption'", "image_id", "image_id || '.jpg'", _ask(ASK, "image_id"), "bare", "'|'", _VQA, "0", "s_")}""",
    "adapt_referring": f"""with {_LAB} {_row("'rec'", "ann_id", "path", _ask(FIND, "ann_id", expr="label"), "'<Phrase>' || label || '</Phrase><boxes>'", "'|0'", _GDET, "1", "lab_")} union all {_row("'rec1'", "ann_id", "path", _ask(FIND, "ann_id", expr="label"), "'Answer: <boxes>.'", "'|0'", _GDET, "1", "lab_")}
        union all {_row("'reg'", "ann_id", "path", _ask(NAME, "ann_id", objs="'<boxes>'"), "label", "'0|'", _VQA, "1", "lab_")}""",
    "adapt_detection": f"""with {_LAB}, {_CLS.format(",")} {_row("'coco_rem'", "image_id", "image_id || '.jpg'", _ask(ASK, "image_id"), "t || '.'", "'|' || gs", _DET, "n", "s_")} union all {_row("'lvis_test'", "image_id", "image_id || '.jpg'", _ask(ASK, "image_id"), "''", "'|'", _DET, "1", "images_ where w is not null and h is not null")}""",
    "adapt_conditional": f"""with {_LAB}, {_CLS.format(",")} {_row("'conditional'", "image_id || '#' || label", "image_id || '.jpg'", _ask(CLASS, "(image_id || '#' || label)", cls="label"), "'<Phrase>' || label || '</Phrase>' || repeat('<boxes>', n) || '.'", f"'|' || {_UPTO.format('n')}", _GDET, "n", "g_")}""",
    "adapt_point_questions": f"""with {_LAB}, v_ as (select *, unnest(['b', 'p', 'bp']) as v from lab_), k_ as (select *, case v when 'p' then true when 'b' then false else cast('0x' || substring(md5('42:' || ann_id), 1, 8) as bigint) % 10000 < 5000 end as by_point from v_)
        {_row("'point_' || v", "ann_id", "path", _ask(QA, "ann_id", question="('What is this ' || case when by_point then '<points>' else '<boxes>' end)"), "'The answer is ' || label || ' .'", "'0|'", _VQA, "2", "k_")}""",
    "adapt_pointing": f"""with {_LAB} {_row("'v7w'", "key", "path", _ask(QA, "key", question="('Which is the ' || ls[1] || '? Candidates: ' || array_to_string(list_transform(ls, lambda x: '<boxes>'), ' ') || ' answer in box format.')"), "'The answer is <Phrase>target</Phrase><boxes> .'", "array_to_string(range(0, n), ';') || '|0'", "'gcg_detection'", "n", "pic_ where n >= 2")}""",
    "adapt_instructions": f"""with {_TURNS}, t_ as (select sample_id, len(any_value(conversations_n)) as n, string_agg(role || ': ' || coalesce(value, ''), chr(10) order by turn_idx) as said, count(*) as k from (select *, [] as conversations_n from turns_) group by sample_id)
        select 'instruct' as source, cast(s.sample_id as varchar) as sample_id, case when s.sample_id % 3 > 0 then 'coco/' || s.sample_id || '.jpg' end as path, md5(coalesce(said, '')) as said, repeat('|', greatest(len(s.conversations) - 1, 0)) as groups, array_to_string(list_transform(range(0, len(s.conversations) // 2), lambda x: 'vqa'), ',') as tasks, 0 as n_targets
        from s_ s left join t_ on t_.sample_id = s.sample_id where s.conversations is not null""",
    "adapt_label_images": f"""with {_LAB}, d_ as (select distinct image_id, category_id, label from lab_ where x2 >= x1 and y2 >= y1), s_ as (select image_id, string_agg('<Phrase>' || label || '</Phrase><masks>', ',' order by category_id) || '.' as t, count(*) as n from d_ group by 1)
        {_row("'label_images'", "image_id || '.jpg'", "image_id || '.jpg'", _ask(ASK, "(image_id || '.jpg')"), "t", "'|' || array_to_string(range(0, n), ';')", "'segmentation'", "n", "s_")}""",
    "adapt_instances": f"""with {_LAB}, e_ as (select distinct path, case when ann_id % 5 = 0 then category_id else category_id * 1000 + ann_id % 997 end as segment, category_id from lab_), v_ as (select distinct e.path, e.segment, cast(e.segment // 1000 as int) as cid from e_ e where segment >= 1000),
        num2_ as (select v.path, lower(trim(c.cat_name)) as label, row_number() over (partition by path order by segment) - 1 as pos from v_ v join categories c on c.category_id = v.cid where c.cat_name is not null), g_ as (select path, label, min(pos) as f, count(*) as n, list(pos order by pos) as ps from num2_ group by 1, 2),
        s_ as (select path, string_agg('<Phrase>' || label || '</Phrase>' || repeat('<masks>', n), ',' order by f) || '.' as t, string_agg(array_to_string(ps, ','), ';' order by f) as gs, sum(n) as n from g_ group by 1)
        {_row("'cityscapes'", "path", "path", _ask(ASK, "path"), "t", "'|' || gs", "'segmentation'", "n", "s_")}""",
    "adapt_narratives": f"""with {_LAB}, m_ as (select *, case when pos % 2 = 0 then pos % 3 + 1 else 0 end as k from num_), c_ as (select *, coalesce(sum(k) over (partition by image_id order by pos rows between unbounded preceding and 1 preceding), 0) as b from m_),
        s_ as (select image_id, string_agg(case when k > 0 then '<Phrase>' || label || '</Phrase>' || repeat('<masks>', k) else label end, ' ' order by pos) as t, string_agg(case when k > 0 then array_to_string(range(cast(b as bigint), cast(b + k as bigint)), ',') end, ';' order by pos) as gs, sum(k) as n from c_ group by 1)
        {_row("'png'", "image_id", "image_id || '.jpg'", _ask(ASK, "image_id"), "t", "'|' || gs", "'gcg_segmentation'", "n", "s_")}""",
    "phrase_insert": f"""with {_LAB}, s_ as (select key, path, list_slice(ls, 1, 3) as ls from pic_)
        {_row("'openpsg'", "key", "path", _ask(ASK, "key"), "array_to_string(list_transform(ls, lambda x: '<Phrase>' || x || '</Phrase><boxes>'), ' and ')", "'|' || array_to_string(range(0, len(ls)), ';')", "'gcg_detection'", "len(ls)", "s_")}""",
    "adapt_grounded_dialogues": f"""with {_LAB} select 'llava_g' as source, cast(key as varchar) as sample_id, path, 'human: What is here?' || chr(10) || 'gpt: A ' || ls[1] || ' <masks> and a ' || ls[2] || ' <masks><masks>.' || chr(10) || 'human: More?' || chr(10) || 'gpt: ' || ls[3] || '.' as said, '|0;1,2||' as groups, 'gcg_segmentation,gcg_segmentation' as tasks, 3 as n_targets
        from pic_ where n >= 3 and ids[1] % 7 > 0 and ids[2] % 7 > 0 and ids[3] % 7 > 0""",
    "adapt_regions": f"""with {_LAB} {_row("'osprey'", "key", "path", "'What are <masks> and <masks>? Answer shortly.'", "'<masks> is ' || ls[2] || '.'", "'0;1|1'", _VQA, "n", "pic_ where n >= 2")}""",
    "adapt_interaction": f"""with {_LAB}, k_ as (select *, unnest(['point', 'box']) as kind from lab_), r_ as (select *, path || '#' || ann_id || '#' || kind as k from k_), b_ as (select * from r_ where kind = 'box')
        {_row("'interact'", "k", "path", _ask(REGION, "k", region="'<masks>'"), "'<Phrase>' || label || '</Phrase><masks>.'", "'0|1'", _GSEG, "2", "r_")} union all {_row("'interact_box'", "k", "path", _ask(REGION, "k", region="'<masks>'"), "'<Phrase>' || label || '</Phrase><masks>.'", "'0|1'", _GSEG, "2", "b_")}""",
    "adapt_keypoints": f"""with {_LAB}, p_ as (select * from lab_ where ann_id % 3 > 0), c_ as (select image_id, count(*) as n from p_ group by 1), i_ as (select i.image_id, coalesce(c_.n, 0) as n from images_ i left join c_ on c_.image_id = i.image_id where i.w is not null and i.h is not null)
        {_row("'keypoints'", "image_id", "image_id || '.jpg'", _ask(ASK, "image_id"), "case when n > 0 then '<Phrase>person</Phrase>' || repeat('<boxes>', n) || '.' else 'There is no person in the image.' end", f"case when n > 0 then '|' || {_UPTO.format('n')} || ';' || {_UPTO.format('n')} else '|' end", "case when n > 0 then 'grounding_keypoints' else 'vqa' end", "2 * n", "i_")}
        union all {_row("'keypoints_rec'", "ann_id", "path", _ask(REGION, "ann_id", region="'<boxes>'"), "'<Phrase>person</Phrase><keypoints>.'", "'0|0'", "'grounding_keypoints'", "2", "p_")}""",
    "adapt_depth": f"""with {X.IMAGES} {_row("'depth'", "image_id", "'rgb/' || image_id || '.jpg'", _ask(ASK, "image_id"), "'<depth>'", "'|'", "'depth'", "1", "images_ where image_id % 4 > 0")} union all {_row("'single'", "image_id", "image_id || '.jpg'", f"'{ASK[0]}'", "''", "'|'", _VQA, "0", "images_")}""",
    "target_process": f"""with {_LAB}, e_ as (select ann_id, greatest(w, h) as s, x1 + floor(greatest(h - w, 0) / 2) as x1, y1 + floor(greatest(w - h, 0) / 2) as y1, x2 + floor(greatest(h - w, 0) / 2) as x2, y2 + floor(greatest(w - h, 0) / 2) as y2 from lab_)
        select cast(ann_id as varchar) as sample_id, {", ".join(f"{_norm(c, 's')} as {c}" for c in ("x1", "y1", "x2", "y2"))} from e_""",
    "sink_roundtrip": f"""with {_TURNS}, {X.ANNOTATIONS} select role as part, count(*) as n, cast(sum(len(value)) as double) as total from turns_ where value is not null group by 1
        union all select 'detections', count(*), {X.sql_rounded("sum(score)", 3)} from annotations_ where image_id is not null and score is not null and len(bbox) = 4 and category_id is not null""",
}
_H, _W = GRID
_SCORES = f"""{X.BOXES}, q_ as (select *, row_number() over (partition by image_id order by ann_id) - 1 as q, category_id % 6 as cls, 1 / (1 + exp(-(5.0 - (ann_id % 101) / 50))) as s from boxes_ where category_id is not null),
  c_ as (select q_.*, k, case when ((k % {_W}) + 0.5) * w / {_W} between x1 and x2 and (k // {_W} + 0.5) * h / {_H} between y1 and y2 then 1 else 0 end as inside from q_ cross join (select unnest(range(0, {_H * _W})) as k))"""
SQL["panoptic_merge"] = f"""with {_SCORES}, l_ as (select *, s * case when inside = 1 then 1 / (1 + exp(cast(-3 as double))) else 1 / (1 + exp(cast(3 as double))) end as v from c_ where cls < 5),
  w_ as (select * from (select *, row_number() over (partition by image_id, k order by v desc, q) as r from l_) where r = 1), f_ as (select image_id, q, sum(inside) as n from l_ group by 1, 2), o_ as (select image_id, q, count(*) as n, sum(inside) as m from w_ group by 1, 2),
  k_ as (select o_.image_id, o_.q from o_ join f_ on o_.image_id = f_.image_id and o_.q = f_.q where o_.m > 0 and o_.n / f_.n >= 0.5)
  select w_.image_id, cast(min(w_.q) as int) as segment, cast(cls as int) as category_id, cls < 3 as thing, string_agg(k, ',' order by k) as pixels from w_ join k_ on w_.image_id = k_.image_id and w_.q = k_.q where inside = 1 group by w_.image_id, cls, case when cls < 3 then w_.q end"""
SQL["instance_topk"] = f"""with {_SCORES}, n_ as (select image_id, q, any_value(s) as s, any_value(cls) as cls, sum(inside) as n from c_ group by 1, 2), x_ as (select *, unnest(range(0, 6)) as c from n_), y_ as (select *, case when c = cls then s else 1 / (1 + exp(cast(5 as double))) end as p from x_),
  r_ as (select *, row_number() over (partition by image_id order by p desc, q, c) as r from y_) select image_id, cast(q as int) as query, cast(c as int) as category_id, {X.sql_rounded("p * (n * (1 / (1 + exp(cast(-3 as double)))) / (n + 1e-6))", 6)} as score, cast(n as int) as n_pixels from r_ where r <= 10 and c < 3"""
_DECIDE = "You should decide on the best choice and output the corresponding letter."
_OPTIONS = f"'QUESTION: What is at <boxes> ' || chr(10) || 'OPTIONS: (A) ' || ls[1] || ' (B) ' || ls[2] || ' <boxes> (C) nothing (D) all {_DECIDE}'"
_LETTER = "'The answer is (' || chr(cast(65 + {0} as int)) || ').'"
SQL["adapt_choices"] = f"""with {_LAB}, two_ as (select *, key % 2 as a from pic_ where n >= 2), four_ as (select *, unnest(range(0, 4)) as f from two_), k_ as (select *, key || '#' || f as fk from four_)
  {_row("'vcr'", "key", "path", _ask(QA, "key", question="'QUESTION: What is at <boxes>'"), "case when a = 0 then ls[1] else ls[2] || ' <Phrase>target</Phrase><boxes>' end", "'0|' || case when a = 0 then '' else '1' end", "case when a = 0 then 'vqa' else 'gcg_detection' end", "n", "two_")}
  union all {_row("'vcr_qc'", "key", "path", _ask(QA, "key", question=f"({_OPTIONS})"), _LETTER.format("a"), "'0;1|'", _VQA, "n", "two_")}
  union all {_row("'vcr_pred'", "fk", "path", _ask(QA, "fk", question=f"({_OPTIONS})"), _LETTER.format("f"), "'0;1|'", _VQA, "n", "k_")}"""


_DIST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_PHR = "array_to_string(list_transform(" + _DIST + ", lambda x: '<Phrase>' || x || '</Phrase>' || repeat('{1}', len(list_filter({0}, lambda y: y = x)))), ',') || '.'"
_AT = "array_to_string(list_transform(" + _DIST + ", lambda x: array_to_string(list_filter(range(0, len({0})), lambda i: {0}[i + 1] = x), ',')), ';')"
_ONE = "'<Phrase>' || p || '</Phrase>' || repeat('{0}', k) || '.'"
SQL["adapt_web_captions"] = f"""with {_LAB}, s_ as (select key, path, list_slice(ls, 1, 2) as ls from pic_), e_ as (select key, path, ls, unnest({_DIST.format('ls')}) as p from s_), b_ as (select *, len(list_filter(ls, lambda y: y = p)) as k from e_)
  {_row("'grit_c'", "key || '#c'", "path", _ask(ASK, "(key || '#c')"), "array_to_string(ls, ' near ')", "'|'", _VQA, "0", "s_")}
  union all {_row("'grit_d'", "key || '#d'", "path", _ask(ASK, "(key || '#d')"), _PHR.format("ls", "<boxes>"), f"'|' || {_AT.format('ls')}", _DET, "len(ls)", "s_")}
  union all {_row("'grit_c_d'", "key || '#c_d'", "path", _ask(ASK, "(key || '#c_d')"), "array_to_string(list_transform(ls, lambda x: '<Phrase>' || x || '</Phrase><boxes>'), ' near ')", "'|' || array_to_string(range(0, len(ls)), ';')", "'gcg_detection'", "len(ls)", "s_")}
  union all {_row("'grit_cond_d'", "key || '#cond_d#' || p", "path", _ask(CLASS, "(key || '#cond_d#' || p)", cls="p"), _ONE.format("<boxes>"), f"'|' || {_UPTO.format('k')}", _GDET, "k", "b_")}
  union all {_row("'grit_r'", "key || '#r#' || p", "path", _ask(FIND, "(key || '#r#' || p)", expr="p"), _ONE.format("<boxes>"), f"'|' || {_UPTO.format('k')}", _GDET, "k", "b_")}
  union all {_row("'grit_g'", "key || '#g#' || p", "path", _ask(NAME, "(key || '#g#' || p)", objs="repeat('<boxes>', k)"), "p", f"{_UPTO.format('k')} || '|'", _VQA, "k", "b_")}"""


def _dense(place: str) -> str:
    """SQL of the versions of a densely annotated picture with one kind of target."""
    seg = place == "<masks>"
    det, cond = ("'segmentation'", _GSEG) if seg else (_DET, _GDET)
    names = {"d": "s", "cond_d": "cond_s", "r_det": "r_seg", "re_det": "re_seg", "c_d": "c_s"} if seg else {}
    n = lambda x: names.get(x, x)
    key = lambda x, rest="": f"(key || '#{n(x)}'{rest})"
    return " union all ".join((
        _row(f"'grand_{n('d')}'", key("d"), "path", _ask(ASK, key("d")), _PHR.format("ls", place), f"'|' || {_AT.format('ls')}", det, "len(ls)", "s_"),
        _row(f"'grand_{n('cond_d')}'", key("cond_d", " || '#' || p"), "path", _ask(CLASS, key("cond_d", " || '#' || p"), cls="p"), _ONE.format(place), f"'|' || {_UPTO.format('k')}", cond, "k", "b_"),
        _row(f"'grand_{n('r_det')}'", key("r_det", " || '#0#0'"), "path", _ask(FIND, key("r_det", " || '#0#0'"), expr="ls[1]"), f"'<Phrase>' || ls[1] || '</Phrase>{place}.'", "'|0'", cond, "1", "s_"),
        _row(f"'grand_{n('re_det')}'", key("re_det", " || '#' || o"), "path", _ask(NAME, key("re_det", " || '#' || o"), objs=f"'{place}'"), "'a ' || ls[o + 1]", "'0|'", _VQA, "1", "o_"),
        _row(f"'grand_{n('c_d')}'", key("c_d", " || '#0'"), "path", _ask(ASK, key("c_d", " || '#0'")), f"'Here: <Phrase>' || ls[1] || '</Phrase>{place}.'", "'|0'", "'gcg_segmentation'" if seg else "'gcg_detection'", "1", "s_"),
    ))


SQL["adapt_dense_captions"] = f"""with {_LAB}, s_ as (select key, path, list_slice(ls, 1, 4) as ls, list_slice(ids, 1, 4) as ids from pic_), e_ as (select key, path, ls, unnest({_DIST.format('ls')}) as p from s_), b_ as (select *, len(list_filter(ls, lambda y: y = p)) as k from e_),
  o_ as (select key, path, ls, unnest(list_filter(range(0, len(ids)), lambda i: ids[i + 1] % 2 = 0)) as o from s_)
  {_row("'grand_c'", "key || '#c#0'", "path", _ask(ASK, "(key || '#c#0')"), "'Here: ' || ls[1] || '.'", "'|'", _VQA, "0", "s_")} union all {_dense("<boxes>")} union all {_dense("<masks>")}"""
SQL["semantic_argmax"] = f"""with {_SCORES}, x_ as (select *, unnest(range(0, 5)) as c, 5.0 - (ann_id % 101) / 50 as top from c_), p_ as (select image_id, k, c, exp((case when c = cls then top else -5.0 end) - greatest(top, -5.0)) / (exp(top - greatest(top, -5.0)) + 5 * exp(-5.0 - greatest(top, -5.0))) as prob, case when inside = 1 then 1 / (1 + exp(cast(-3 as double))) else 1 / (1 + exp(cast(3 as double))) end as m from x_),
  s_ as (select image_id, k, c, sum(prob * m) as score from p_ group by 1, 2, 3), r_ as (select *, row_number() over (partition by image_id, k order by round(score, 9) desc, c) as r from s_) select image_id, cast(c as int) as category_id, count(*) as n from r_ where r = 1 group by 1, 2"""
SQL["adapt_joined"] = f"""with {_LAB}, s_ as (select key, path, list_slice(ls, 1, 4) as ls from pic_)
  select 'grand_mix' as source, cast(key as varchar) as sample_id, path, 'human: <image> What?' || chr(10) || 'gpt: Here: ' || ls[1] || '.' || chr(10) || 'human: Find all.' || chr(10) || 'gpt: ' || {_PHR.format("ls", "<boxes>")} || chr(10) || 'human: Find ' || ls[1] || '.' || chr(10) || 'gpt: <Phrase>' || ls[1] || '</Phrase><boxes>.' || chr(10) || 'human: {ASK[0]}' || chr(10) || 'gpt: Here: <Phrase>' || ls[1] || '</Phrase><boxes>.' as said,
  '|||' || {_AT.format("ls")} || '||' || len(ls) || '||' || (len(ls) + 1) as groups, 'vqa,detection,grounding_detection,gcg_detection' as tasks, cast(len(ls) + 2 as int) as n_targets from s_"""
