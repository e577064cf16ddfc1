"""Queries of composed evaluations and the steps around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import evaluators as V
from ..operators import metrics as A
from ..runtime import table
from . import fixtures as X
from .dialogue import _rounds, samples
from .evaluation import _answers

DETAIL = ["Answer in detail.", "Be precise.", "Say all you see."]


def _matched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = X.with_prediction(X.boxes(spark, d)).withColumn("g", F.concat_ws("#", "image_id", "category_id"))
    return b, V.segmentation_matches(b, "g", "ann_id", "pred", "box", "w", "h")


def seg_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AG17, Z37, J13: segmentation: masks matched per picture and class, mean overlap and recall."""
    b, found = _matched(spark, d)
    r = V.match_report(b, found, "image_id", "ann_id")
    return r.select("n_images", "n_truth", G.rounded(F.col("miou"), 5).alias("miou"), G.rounded(F.col("recall"), 6).alias("recall"))


def gcg_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AG18, Z30, AG26: grounded captions: overlap and recall of the masks, BLEU of the captions."""
    bleu = A.bleu(_answers(spark, d).where("pred is not null"), "pred", "target")
    scores = bleu.select(F.struct(*[G.rounded(F.col(f"bleu{k}"), 6).alias(f"bleu{k}") for k in (1, 2, 3, 4)])).scalar()
    return seg_metrics(spark, d).withColumn("b", scores).select("miou", "recall", "b.bleu1", "b.bleu4")


def pose_results(spark: SparkSession, d: str) -> DataFrame:
    """AG25, Z33, G30: pose result rows of points along the predicted box, in the original image."""
    b = X.with_prediction(X.boxes(spark, d)).where("score is not null")
    side = F.greatest("w", "h")
    box = G.normalize_box(G.expand_box(F.col("pred"), F.col("w"), F.col("h")), side, side)
    point = lambda k: F.array(F.get("nb", F.lit(0)) + (F.get("nb", F.lit(2)) - F.get("nb", F.lit(0))) * k / 16, F.get("nb", F.lit(1)) + (F.get("nb", F.lit(3)) - F.get("nb", F.lit(1))) * k / 16, F.lit(2.0))
    rows = b.withColumn("nb", box)
    out = V.pose_rows(rows, "ann_id", F.transform(F.sequence(F.lit(0), F.lit(16)), point), F.col("nb"), F.col("w"), F.col("h"), F.col("score"))
    return out.select("ann_id", F.size("keypoints").alias("n"), *[G.rounded(F.get("bbox", F.lit(i)), 3).alias(c) for i, c in enumerate(("x", "y", "bw", "bh"))], "score")


def class_id_map(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous class ids, and detections under them per class, with the way back."""
    names = table(spark, d, "categories", "category_id", "cat_name").where("cat_name is not null").select("category_id", F.lower(F.trim("cat_name")).alias("name"))
    ids = V.class_ids(names, "name", "category_id")
    return X.annotations(spark, d).join(ids, "category_id").groupBy("class_id", "category_id", "name").agg(F.count(F.lit(1)).alias("n"))


def detailed_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions with a request for detail, from the first two requests."""
    q = table(spark, d, "eval_items", "item_id", "question").dropDuplicates(["item_id"])
    return q.select("item_id", V.dense_question(F.col("question"), F.col("item_id"), DETAIL[:2]).alias("question"))


def task_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """System entries of the task names of the sources; unknown names give none."""
    s = table(spark, d, "sources", "source", "task_name")
    t = s.withColumn("t", V.task_descriptor(F.initcap(F.replace("task_name", F.lit("_"), F.lit(" ")))))
    return t.select("source", F.col("t.task_name").alias("task_name"), F.array_join("t.element", ",").alias("element"), F.array_join("t.unit", ",").alias("unit"))


def entity_paths(spark: SparkSession, d: str) -> DataFrame:
    """Places of the files of an entity annotation."""
    return X.images(spark, d).select("image_id", V.flickr_paths(F.col("image_id"), "root").alias("p")).select("image_id", "p.annotation", "p.sentences", "p.image")


def decode_targets(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a sample by unit, and the index lists of its turns."""
    s = samples(spark, d)
    own = lambda t: F.transform(F.flatten(t["boxes_seq"]), lambda i: F.struct(F.when(i % 2 == 0, "box").otherwise("point").alias("type"), F.when(i % 2 == 0, F.get("boxes", i)).otherwise(F.slice(F.get("boxes", i), 1, 2)).alias("value")))
    rows = s.select("sample_id", V.decode_labels(F.transform("turns", own)).alias("l"), V.decode_sequences(F.transform("turns", lambda t: t["boxes_seq"])).alias("q"))
    total = lambda v: G.rounded(F.aggregate(F.flatten(F.filter(v, lambda x: x.isNotNull())), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 3)
    n = lambda v: F.coalesce(F.size(v), F.lit(0))
    box, point = F.try_element_at("l", F.lit("box")), F.try_element_at("l", F.lit("point"))
    return rows.select("sample_id", F.greatest(n(box), F.lit(0)).alias("n_box"), F.greatest(n(point), F.lit(0)).alias("n_point"), F.coalesce(total(box), F.lit(0.0)).alias("sum_box"), F.coalesce(total(point), F.lit(0.0)).alias("sum_point"), F.greatest(n("q"), F.lit(0)).alias("n_seq"))


def after_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The text behind each phrase of an answer, up to the next one."""
    r = _rounds(spark, d).where(F.contains("output", F.lit("</Phrase>")))
    return r.select("sample_id", "round_idx", F.array_join(V.between_marks(F.col("output"), "<Phrase>", "</Phrase>"), "|").alias("between"))


def picture_padding(spark: SparkSession, d: str) -> DataFrame:
    """Scaled size and room of every picture, and the filling of its regions and of its batch."""
    i = X.images(spark, d).where("w is not null and h is not null").select("image_id", "source", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"))
    n = X.boxes(spark, d).groupBy("image_id").agg(F.collect_list("ann_id").alias("regions"))
    rows = V.batch_extent(i, "source", "w", "h").join(n, "image_id", "left").withColumn("s", V.longest_side(F.col("w"), F.col("h"))).withColumn("r", V.padded_regions(F.col("regions"), F.lit(8), F.lit(-1).cast("long")))
    return rows.select("image_id", F.col("s.w").alias("w"), F.col("s.h").alias("h"), F.col("s.right").alias("right"), F.col("s.below").alias("below"), "pad_w", "pad_h", F.size("r.items").alias("n_items"), F.col("r.n").alias("n_regions"))


QUERIES = {f.__name__: f for f in (seg_metrics, gcg_metrics, pose_results, class_id_map, detailed_questions, task_descriptors, entity_paths, decode_targets, after_phrases, picture_padding)}

from ..constants import TASKS  # noqa: E402
from .boxes import _norm  # noqa: E402
from .dialogue import _ROUNDS, _TURNS  # noqa: E402
from .evaluation import _ANSWERS, _GRAMS, _MASKS, _WORDS  # noqa: E402

_R = X.sql_rounded
_MATCH = f"""{_MASKS}, z_ as (select c.*, b.image_id, b.image_id || '#' || coalesce(cast(b.category_id as varchar), '') as g from c_ c join boxes_ b on b.ann_id = c.ann_id),
  p_ as (select p.g, p.ann_id as i, t.ann_id as j, greatest(least(p.px2, t.x2) - greatest(p.px1, t.x1), 0) * greatest(least(p.py2, t.y2) - greatest(p.py1, t.y1), 0) as both_, greatest(p.px2 - p.px1, 0) * greatest(p.py2 - p.py1, 0) as a, greatest(t.x2 - t.x1, 0) * greatest(t.y2 - t.y1, 0) as b from z_ p join z_ t on p.g = t.g),
  n_ as (select g, i, j, iou, row_number() over (partition by g order by iou desc, i, j) as k from (select *, both_ / nullif(a + b - both_, 0) as iou from p_) where iou >= 0.5),
  m_ as (select g, cast(0 as bigint) as k, []::bigint[] as ui, []::bigint[] as uj, cast(null as bigint) as j, cast(null as double) as iou from (select distinct g from n_)
    union all select g, k, case when ok then list_append(ui, i) else ui end, case when ok then list_append(uj, j) else uj end, case when ok then j end, case when ok then iou end from (select m_.g, n_.k, m_.ui, m_.uj, n_.i, n_.j, n_.iou, not list_contains(m_.ui, n_.i) and not list_contains(m_.uj, n_.j) as ok from m_ join n_ on n_.g = m_.g and n_.k = m_.k + 1)),
  e_ as (select z_.image_id, count(*) as n, count(m_.j) as m, avg(m_.iou) as iou from z_ left join m_ on m_.j = z_.ann_id group by 1),
  s_eg as (select count(*) as n_images, cast(sum(n) as bigint) as n_truth, {_R("avg(coalesce(iou, 0))", 5)} as miou, {_R("sum(m) / sum(n)", 6)} as recall from e_)"""
_KNOWN = ", ".join(f"('{k}', '{','.join(e)}', '{u or ''}')" for k, (e, u) in TASKS.items())

SQL = {
    "seg_metrics": f"with recursive {_MATCH} select * from s_eg",
    "gcg_metrics": f"""{_ANSWERS.replace('with ', 'with recursive ', 1)}, w_ as (select row_number() over () as k, {_WORDS.format('pred')} as p, {_WORDS.format('target')} as t from a_ where pred is not null), {_GRAMS},
        gc_ as (select k, n, g, count_if(s = 'p') as cp, count_if(s = 't') as ct from g_ group by 1, 2, 3), gh_ as (select n, sum(least(cp, ct)) as hit, sum(cp) as tot from gc_ group by n), gl_ as (select sum(len(p)) as lp, sum(len(t)) as lt from w_),
        gx_ as (select case when lp >= lt then 1 else exp(1 - lt / lp) end as b, {", ".join(f"(select ln(hit / tot) from gh_ where n = {n}) as q{n}" for n in (1, 2, 3, 4))} from gl_), {_MATCH}
        select miou, recall, {_R("coalesce(b * exp(q1), 0)", 6)} as bleu1, {_R("coalesce(b * exp((q1 + q2 + q3 + q4) / 4), 0)", 6)} as bleu4 from s_eg cross join gx_""",
    "pose_results": f"""with {X.PREDS}, e_ as (select ann_id, score, w, h, greatest(w, h) as s, floor(greatest(h - w, 0) / 2) as dx, floor(greatest(w - h, 0) / 2) as dy, px1, py1, px2, py2 from preds_ where score is not null),
        q_ as (select ann_id, score, w, h, s, dx, dy, {_norm('(px1 + dx)', 's')} as a, {_norm('(py1 + dy)', 's')} as b, {_norm('(px2 + dx)', 's')} as c, {_norm('(py2 + dy)', 's')} as d from e_),
        o_ as (select ann_id, score, greatest(0, least(a * s - dx, w)) as x1, greatest(0, least(b * s - dy, h)) as y1, greatest(0, least(c * s - dx, w)) as x2, greatest(0, least(d * s - dy, h)) as y2 from q_)
        select ann_id, 51 as n, {_R("x1", 3)} as x, {_R("y1", 3)} as y, {_R("x2 - x1", 3)} as bw, {_R("y2 - y1", 3)} as bh, score from o_""",
    "class_id_map": f"""with {X.ANNOTATIONS}, n_ as (select category_id, lower(trim(cat_name)) as name, cast(row_number() over (order by category_id) - 1 as int) as class_id from categories where cat_name is not null)
        select class_id, n_.category_id, name, count(*) as n from annotations_ a join n_ on a.category_id = n_.category_id group by 1, 2, 3""",
    "detailed_questions": f"with q_ as (select item_id, any_value(question) as question from eval_items group by 1) select item_id, question || ' ' || ([{', '.join(repr(x) for x in DETAIL[:2])}])[cast('0x' || substring(md5('42:' || item_id), 1, 8) as bigint) % 2 + 1] as question from q_",
    "task_descriptors": f"""with k_ as (select * from (values {_KNOWN}) v(task_name, element, unit)) select s.source, k_.task_name, k_.element, case when k_.unit <> '' then k_.unit end as unit from sources s left join k_ on k_.task_name = regexp_replace(lower(trim(replace(s.task_name, '_', ' '))), '\\s+', '_', 'g')""",
    "entity_paths": f"with {X.IMAGES} select image_id, 'root/Annotations/' || image_id || '.xml' as annotation, 'root/Sentences/' || image_id || '.txt' as sentences, 'root/' || image_id || '.jpg' as image from images_",
    "decode_targets": f"""with {_TURNS}, i_ as (select sample_id, boxes, unnest(flatten(seq)) as i from turns_ where seq is not null), v_ as (select sample_id, i, case when i >= 0 then boxes[i + 1] end as b from i_),
        l_ as (select sample_id, count(*) filter (where i % 2 = 0) as n_box, count(*) filter (where i % 2 <> 0) as n_point, sum(case when i % 2 = 0 and len(b) >= 4 and b[3] >= b[1] and b[4] >= b[2] then b[1] + b[2] + (b[3] - b[1]) + (b[4] - b[2]) end) as sb, sum(case when i % 2 <> 0 then b[1] + b[2] end) as sp from v_ group by 1),
        q_ as (select sample_id, sum(len(seq)) as n from turns_ where seq is not null group by 1)
        select s_.sample_id, cast(coalesce(n_box, 0) as int) as n_box, cast(coalesce(n_point, 0) as int) as n_point, {_R("coalesce(sb, 0)", 3)} as sum_box, {_R("coalesce(sp, 0)", 3)} as sum_point, cast(coalesce(q_.n, 0) as int) as n_seq from s_ left join l_ on l_.sample_id = s_.sample_id left join q_ on q_.sample_id = s_.sample_id""",
    "after_phrases": f"with {_ROUNDS} select sample_id, round_idx, array_to_string(list_transform(regexp_extract_all(output, '(?s)</Phrase>((?:[^<]|<[^/P]|</[^P]|<P[^h])*)', 1), lambda x: x), '|') as between from rounds_ where contains(output, '</Phrase>')",
    "picture_padding": f"""with {X.BOXES}, i_ as (select image_id, source, w, h, max(w) over (partition by source) - w as pad_w, max(h) over (partition by source) - h as pad_h, cast(1024 as double) / greatest(w, h) as f from images_ where w is not null and h is not null), n_ as (select image_id, count(*) as n from boxes_ group by 1)
        select i_.image_id, cast(floor(w * f + 0.5) as int) as w, cast(floor(h * f + 0.5) as int) as h, cast(1024 - floor(w * f + 0.5) as int) as right, cast(1024 - floor(h * f + 0.5) as int) as below, pad_w, pad_h, cast(greatest(8, coalesce(n, 0)) as int) as n_items, cast(coalesce(n, 0) as int) as n_regions from i_ left join n_ on n_.image_id = i_.image_id""",
}
