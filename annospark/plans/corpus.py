"""Queries over corpora: subsets, mixtures, templates, joins, groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import corpora as K
from ..operators import grouping as J
from ..operators import validation as V
from ..runtime import salted_rank, table
from . import fixtures as X


def _categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "categories", "category_id", "cat_name", "supercategory", "synonyms")


def subset_portion(spark: SparkSession, d: str) -> DataFrame:
    """L1: three tenths of the images in hash order."""
    return K.subset(X.images(spark, d).select("image_id", "split"), "image_id", 0.3)


def concat_shuffle_portion(spark: SparkSession, d: str) -> DataFrame:
    """Images and documents together, one and a half times."""
    both = K.concatenated({"images": X.images(spark, d).select(F.col("image_id").alias("key"), "source"), "documents": table(spark, d, "documents", "doc_id", "source").select(F.col("doc_id").alias("key"), "source")})
    return K.shuffled_portion(both, "key", 1.5).groupBy("corpus", "copy").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last_rank"))


def _corpora(spark: SparkSession, d: str) -> DataFrame:
    """Images of each split in order of their key."""
    known = X.images(spark, d).where("split is not null").select("image_id", "split")
    return salted_rank(known, ["split"], [F.col("image_id")], "pos")


def interleave_under(spark: SparkSession, d: str) -> DataFrame:
    """Round robin over the splits until the smallest is used up."""
    known = X.images(spark, d).where("split is not null").select("image_id", "split")
    ranked = K.hash_rank(known, "image_id", by=["split"], name="pos")
    return K.interleaved(ranked, "split", "pos").select("out_pos", "split", "image_id")


def interleave_over(spark: SparkSession, d: str) -> DataFrame:
    """Round robin over the splits until the largest is used up; smaller ones begin again."""
    known = X.images(spark, d).where("split is not null").select("image_id", "split")
    ranked = K.hash_rank(known, "image_id", by=["split"], name="pos")
    return K.interleaved(ranked, "split", "pos", all_exhausted=True).select("out_pos", "split", "image_id")


#: Probabilities of the splits in ``interleave_probability``.
MIXTURE = {"train": 0.5, "val": 0.2, "test": 0.1, "testa": 0.1, "testb": 0.1}


def interleave_probability(spark: SparkSession, d: str) -> DataFrame:
    """Draws of a split by probability until the first is used up."""
    known = X.images(spark, d).where("split is not null").select("image_id", "split")
    ranked = K.hash_rank(known, "image_id", by=["split"], name="pos")
    return K.interleaved_by_probability(ranked, "split", "pos", MIXTURE).select("turn", "split", "image_id")


def template_assign(spark: SparkSession, d: str) -> DataFrame:
    """A question template and a coin for every image."""
    return X.images(spark, d).select("image_id", K.chosen(F.col("image_id"), 7).cast("int").alias("template"), K.coin(F.col("image_id"), 0.25).alias("coin"))


def sample_per_image(spark: SparkSession, d: str) -> DataFrame:
    """At most three boxes of every image in hash order."""
    return K.sampled_per_group(X.boxes(spark, d).select("image_id", "ann_id"), "image_id", "ann_id", 3)


def topn_area(spark: SparkSession, d: str) -> DataFrame:
    """The two largest boxes of every image."""
    b = X.boxes(spark, d).select("image_id", "ann_id", G.area(F.col("box")).alias("box_area"))
    return K.top_per_group(b, "image_id", F.col("box_area"), "ann_id", 2).select("image_id", "ann_id", "rank")


def coco_index_join(spark: SparkSession, d: str) -> DataFrame:
    """Annotations with image and category; counts per supercategory and split."""
    joined = J.indexed(X.images(spark, d).select("image_id", "split"), X.annotations(spark, d).select("image_id", "category_id", "ann_id"), _categories(spark, d).select("category_id", "supercategory"))
    return joined.groupBy("supercategory", "split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("image_id").alias("n_images"))


def detection_caption(spark: SparkSession, d: str) -> DataFrame:
    """AG27, P7, Z8: caption of each image's boxes grouped by category."""
    b = X.boxes(spark, d).join((_categories(spark, d).where("cat_name is not null").select("category_id", F.lower(F.trim("cat_name")).alias("label"))), "category_id")
    numbered = salted_rank(b.select("image_id", "ann_id", "label"), ["image_id"], [F.col("ann_id")], "r", salts=1)
    return J.detection_captions(numbered.select("image_id", "label", F.col("r").cast("int").alias("pos")), "image_id", "label", "pos").select("image_id", "caption", F.size("seq").alias("n_classes"))


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    """AG28: instances per image and category."""
    return J.class_counts(X.annotations(spark, d).where("category_id is not null"), "image_id", "category_id")


def scene_graph_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of an image by category through a map per image."""
    b = X.boxes(spark, d).where("category_id is not null").groupBy("image_id", "category_id").agg(F.min("ann_id").alias("first_ann"))
    scenes = b.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("category_id"), F.col("first_ann")))).alias("objects"))
    asked = X.images(spark, d).select("image_id", F.array(*[(F.pmod(F.col("image_id"), F.lit(40)) + k).cast("int") for k in (1, 2, 3)]).alias("ids"))
    found = J.scene_lookup(asked, scenes, "image_id", "ids", "objects")
    return found.select("image_id", F.size(F.filter("found", lambda x: x.isNotNull())).alias("n_found"), F.aggregate(F.transform("found", lambda x: F.coalesce(x, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x).alias("sum_ann"))


def substring_theta_join(spark: SparkSession, d: str) -> DataFrame:
    """The first category whose name occurs in an evaluation question; the names are one small row."""
    names = _categories(spark, d).where("cat_name is not null").agg(F.transform(F.sort_array(F.collect_list(F.struct("category_id", F.lower(F.trim("cat_name")).alias("n")))), lambda x: x["n"]).alias("names"))
    items = table(spark, d, "eval_items", "item_id", "question").dropDuplicates(["item_id"])
    return items.withColumn("names", names.scalar()).select("item_id", J.first_contained(F.lower("question"), F.col("names")).alias("cat_name"))


def key_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Images with annotations and annotations with images."""
    kept = V.common_keys((X.images(spark, d), "image_id"), (X.annotations(spark, d), "image_id"), (table(spark, d, "documents", "doc_id", "image_id"), "image_id"))
    out = None
    for name, df in zip(("images", "annotations", "documents"), kept, strict=True):
        one = df.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"), F.countDistinct("image_id").alias("n_keys"))
        out = one if out is None else out.unionByName(one)
    return out


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    """keys delivered more than once."""
    return V.duplicate_keys(table(spark, d, "annotations", "ann_id"), "ann_id")


def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Stems and zero-filled keys."""
    return X.images(spark, d).where("file_name is not null").select("image_id", T.stem(F.col("file_name")).alias("stem"), T.zero_fill(F.col("image_id")).alias("filled"))


def class_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """One row per category and synonym."""
    c = _categories(spark, d)
    written = F.array_join(F.array_compact(F.concat(F.array("cat_name"), F.coalesce("synonyms", F.array().cast("array<string>")))), ", ")
    return c.select("category_id", F.explode(T.synonyms(written)).alias("name")).groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))


def round_order(spark: SparkSession, d: str) -> DataFrame:
    """Turns of each sample in hash order, a hash-chosen number kept."""
    s = table(spark, d, "samples", "sample_id", "conversations").dropDuplicates(["sample_id"])
    values = F.transform("conversations", lambda c: c["value"])
    return s.select("sample_id", F.size("conversations").alias("n_turns"), F.size(K.shuffled_rounds(values, F.col("sample_id"), 3)).alias("n_kept"))


QUERIES = {
    f.__name__: f
    for f in (subset_portion, concat_shuffle_portion, interleave_under, interleave_over, interleave_probability, template_assign, sample_per_image, topn_area, coco_index_join, detection_caption, class_counts, scene_graph_lookup, substring_theta_join, key_intersection, duplicate_ids, file_names, class_synonyms, round_order)
}

_EDGES = list(zip(sorted(MIXTURE), np.cumsum([MIXTURE[n] / sum(MIXTURE.values()) for n in sorted(MIXTURE)]).tolist(), strict=True))
_INTER = f"""with {X.IMAGES}, p_ as (select split, image_id, row_number() over (partition by split order by md5('42:' || image_id), image_id) - 1 as pos, count(*) over (partition by split) as n from images_ where split is not null),
  c_ as (select split, n, dense_rank() over (order by split) - 1 as i from (select distinct split, n from p_)), l_ as (select min(n) as lo, max(n) as hi, count(*) as k from c_)"""
_HEX = "cast('0x' || substring(md5('42:' || {0}), 1, 8) as bigint)"

SQL = {
    "subset_portion": f"with {X.IMAGES}, r_ as (select image_id, split, row_number() over (order by md5('42:' || image_id), image_id) - 1 as r, count(*) over () as n from images_) select image_id, split from r_ where r < floor(n * cast(0.3 as double))",
    "concat_shuffle_portion": f"""with {X.IMAGES}, b_ as (select 'images' as corpus, image_id as key from images_ union all select 'documents', doc_id from documents), n_ as (select count(*) as n from b_),
        m_ as (select corpus, copy, row_number() over (order by md5('42:' || key || '#' || copy), key || '#' || copy) - 1 as r from b_ cross join (select unnest([0, 1]) as copy))
        select corpus, copy, count(*) as n, max(r) as last_rank from m_ cross join n_ where r < floor(n_.n * cast(1.5 as double)) group by corpus, copy""",
    "interleave_under": f"{_INTER} select p_.pos * l_.k + c_.i as out_pos, p_.split, p_.image_id from p_ join c_ on p_.split = c_.split cross join l_ where p_.pos < l_.lo",
    "interleave_over": f"{_INTER} select t.t * l_.k + c_.i as out_pos, p_.split, p_.image_id from l_ cross join c_ cross join (select unnest(range((select hi from l_))) as t) t join p_ on p_.split = c_.split and p_.pos = t.t % c_.n",
    "template_assign": f"with {X.IMAGES} select image_id, cast({_HEX.format('image_id')} % 7 as int) as template, {_HEX.format('image_id')} % 10000 < 2500 as coin from images_",
    "sample_per_image": f"with {X.BOXES} select image_id, ann_id from (select image_id, ann_id, row_number() over (partition by image_id order by md5('42:' || ann_id), ann_id) as r from boxes_) where r <= 3",
    "topn_area": f"with {X.BOXES} select image_id, ann_id, r as rank from (select image_id, ann_id, row_number() over (partition by image_id order by greatest(x2 - x1, 0) * greatest(y2 - y1, 0) desc, ann_id) as r from boxes_) where r <= 2",
    "coco_index_join": f"with {X.IMAGES}, {X.ANNOTATIONS} select c.supercategory, i.split, count(*) as n, count(distinct a.image_id) as n_images from annotations_ a join images_ i on a.image_id = i.image_id left join categories c on a.category_id = c.category_id group by 1, 2",
    "detection_caption": f"""with {X.BOXES}, l_ as (select b.image_id, lower(trim(c.cat_name)) as label, row_number() over (partition by b.image_id order by b.ann_id) - 1 as pos from boxes_ b join categories c on b.category_id = c.category_id where c.cat_name is not null),
        g_ as (select image_id, label, min(pos) as f, count(*) as n from l_ group by image_id, label)
        select image_id, string_agg('<Phrase>' || label || '</Phrase>' || repeat('<boxes>', n), ',' order by f) || '.' as caption, cast(count(*) as int) as n_classes from g_ group by image_id""",
    "class_counts": f"with {X.ANNOTATIONS} select image_id, category_id, count(*) as n from annotations_ where category_id is not null group by 1, 2",
    "scene_graph_lookup": f"""with {X.BOXES}, f_ as (select image_id, category_id, min(ann_id) as a from boxes_ where category_id is not null group by 1, 2), q_ as (select image_id, image_id % 40 + unnest([1, 2, 3]) as c from images_)
        select q_.image_id, cast(count(f_.a) as int) as n_found, cast(coalesce(sum(f_.a), 0) as bigint) as sum_ann from q_ left join f_ on q_.image_id = f_.image_id and q_.c = f_.category_id group by 1""",
    "substring_theta_join": """with n_ as (select category_id, lower(trim(cat_name)) as n from categories where cat_name is not null), e_ as (select item_id, any_value(question) as question from eval_items group by 1)
        select item_id, (select n from n_ where contains(lower(question), n) order by category_id limit 1) as cat_name from e_""",
    "key_intersection": f"""with {X.IMAGES}, {X.ANNOTATIONS}, k_ as (select image_id from images_ intersect select image_id from annotations_ intersect select image_id from documents)
        select 'images' as side, count(*) as n, count(distinct image_id) as n_keys from images_ where image_id in (select image_id from k_) union all select 'annotations', count(*), count(distinct image_id) from annotations_ where image_id in (select image_id from k_)
        union all select 'documents', count(*), count(distinct image_id) from documents where image_id in (select image_id from k_)""",
    "duplicate_ids": "select ann_id, count(*) as n from annotations group by 1 having count(*) > 1",
    "file_names": f"with {X.IMAGES} select image_id, string_split(string_split(file_name, '/')[-1], '.')[1] as stem, case when len(cast(image_id as varchar)) >= 12 then cast(image_id as varchar) else lpad(cast(image_id as varchar), 12, '0') end as filled from images_ where file_name is not null",
    "class_synonyms": "with w_ as (select category_id, array_to_string(list_filter(list_concat([cat_name], coalesce(synonyms, [])), lambda x: x is not null), ', ') as w from categories), n_ as (select category_id, regexp_replace(unnest(string_split(w, ',')), '^ +| +$', '', 'g') as name from w_) select category_id, count(*) as n, min(name) as first_name from n_ where name <> '' group by 1",
    "round_order": """with s_ as (select sample_id, any_value(conversations) as c from samples group by 1)
        select sample_id, len(c) as n_turns, least(len(c), cast('0x' || substring(md5('43:' || sample_id), 1, 8) as bigint) % 3 + 1) as n_kept from s_""",
    "interleave_probability": f"""with {X.IMAGES}, p_ as (select split, image_id, row_number() over (partition by split order by md5('42:' || image_id), image_id) - 1 as pos, count(*) over (partition by split) as n from images_ where split is not null),
        t_ as (select turn, cast(cast('0x' || substring(md5('42:' || turn), 1, 12) as bigint) as double) / cast(281474976710656 as double) as u from (select unnest(range(0, (select 100 * count(*) + 10000 from images_))) as turn)),
        d_ as (select turn, case {" ".join(f"when u < cast({e!r} as double) then '{n}'" for n, e in _EDGES[:-1])} else '{_EDGES[-1][0]}' end as split from t_), r_ as (select turn, split, row_number() over (partition by split order by turn) - 1 as r from d_),
        e_ as (select min(turn) as last_turn from r_ join (select split, max(n) as n from p_ group by 1) s_ on r_.split = s_.split and r_.r = s_.n - 1)
        select r_.turn, p_.split, p_.image_id from r_ join p_ on r_.split = p_.split and p_.pos = r_.r % p_.n where r_.turn <= (select last_turn from e_)""",
}
