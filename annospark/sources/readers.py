"""Readers and sinks (S1-S43). Schemas are declared; what cannot be read goes to a column of its own, not away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masks import segment_ids

COCO = (
    "images array<struct<id:bigint,width:int,height:int,file_name:string>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double,iscrowd:int,segmentation:string,keypoints:array<double>,num_keypoints:int,caption:string,labels:array<string>>>, "
    "categories array<struct<id:int,name:string,supercategory:string,skeleton:array<array<int>>>>"
)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line (S1, S2, Z6); broken lines keep their text in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole files that hold an object or an array of objects (S1, S23, Z5, Z7); ``path`` may be a folder."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def keyed_documents(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """Files whose one top-level key names the picture (S24): ``name`` and the value's fields."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"map<string,struct<{value_schema}>>")).alias("name", "v")).select("name", "v.*")


def coco_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of a combined file (S16-S22, S37); null lists give no rows."""
    doc = json_documents(spark, path, COCO)
    return tuple(doc.select(F.inline(part)) for part in ("images", "annotations", "categories"))


def third_part(file_name: Column) -> Column:
    """Key of a picture in the third part of its name."""
    return F.regexp_replace(F.split_part(file_name, F.lit("_"), F.lit(3)), r"\.[^.]*$", "")


def offline(spark: SparkSession, name: str, parquet: str | None, build) -> DataFrame:
    """The materialised table where there is one, else the built one."""
    del name
    if parquet:
        try:
            return spark.read.parquet(parquet)
        except Exception as error:  # a missing path is the usual case
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return build()


def pictures(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Bytes of pictures below a folder (S7, S8, S25): ``path``, ``length``, ``content``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length", "content")


def base64_bytes(text: Column) -> Column:
    """Bytes of a base64 text (S10); null where it is none."""
    return F.try_to_binary(F.regexp_replace(text, r"^data:[^,]*,", ""), F.lit("base64"))


def image_path(folder: str | None, name: Column) -> Column:
    """Folder and name of a picture (S6); names with a root of their own stay."""
    if not folder:
        return name
    return F.when(name.rlike(r"^(/|[a-z0-9]+://)"), name).otherwise(F.concat_ws("/", F.lit(folder.rstrip("/")), name))


def paired_depth(rgb: DataFrame, depth: DataFrame, key) -> DataFrame:
    """RGB and depth files of the same derived key."""
    a = rgb.select(key(F.col("path")).alias("key"), F.col("path").alias("rgb_path"))
    b = depth.select(key(F.col("path")).alias("key"), F.col("path").alias("depth_path"))
    return a.join(b, "key")


def same_stem(path: Column) -> Column:
    """Key for files of one stem."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def first_digits(path: Column) -> Column:
    """Key from the first digits of the file name."""
    return F.regexp_extract(F.regexp_extract(path, r"([^/]+)$", 1), r"\d+", 0)


# File endings of the kinds of street-scene targets.
CITY_SUFFIX = {"instance": "{0}_instanceIds.png", "semantic": "{0}_labelIds.png", "color": "{0}_color.png", "polygon": "{0}_polygons.json", "depth": "_disparity.png"}


def city_suffix(mode: str, kind: str) -> str:
    """Ending of a target file (S26); ``mode`` is ``gtFine`` or ``gtCoarse``."""
    return CITY_SUFFIX[kind].format(mode)


def class_list(spark: SparkSession, path: str) -> DataFrame:
    """``id:name,synonym`` lines (S30, S36, Z47): ``class_id``, ``names``."""
    lines = spark.read.text(path).where(F.contains("value", F.lit(":")))
    return lines.select(F.trim(F.split_part("value", F.lit(":"), F.lit(1))).try_cast("int").alias("class_id"), F.filter(F.transform(F.split(F.regexp_extract("value", r"^[^:]*:(.*)$", 1), ","), lambda x: F.trim(x)), lambda x: x != "").alias("names")).where("class_id is not null")


def label_values(pixels: DataFrame, ignored: tuple[int, ...] = (0, 255)) -> DataFrame:
    """One row per picture and label value (S31, A32, F14): ``pixels`` has ``path`` and ``values``."""
    return pixels.select("path", F.explode(F.array_distinct("values")).alias("label")).where(~F.col("label").isin(*ignored))


def panoptic_ids(pixels: DataFrame) -> DataFrame:
    """Segments of colour pixels and their size (S32): ``path``, ``segment``, ``n``."""
    return pixels.select("path", F.explode("rgb").alias("p")).groupBy("path", segment_ids(F.get("p", F.lit(0)), F.get("p", F.lit(1)), F.get("p", F.lit(2))).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


def entity_sentences(lines: DataFrame) -> DataFrame:
    """Sentences with ``[/EN#id/type words]`` marks (S11): the plain sentence and its phrases.

    ``lines``: ``image_id``, ``sentence_id``, ``line``. Adds ``sentence`` and ``phrases``
    (``array<struct<id, type, phrase, at>>``, ``at`` the number of words before it).
    """
    mark = r"\[/EN#(\d+)/([^ ]*) ([^\]]*)\]"
    ids, kinds, words = (F.regexp_extract_all("line", F.lit(mark), F.lit(g)) for g in (1, 2, 3))
    before = F.split("line", r"\[/EN#\d+/[^ ]* ")
    counted = F.transform(before, lambda s: F.size(F.filter(F.split(F.regexp_replace(s, r"\]", " "), r"\s+"), lambda w: w != "")))
    at = lambda i: F.aggregate(F.slice(counted, 1, i + 1), F.lit(0), lambda a, b: a + b)
    zipped = F.arrays_zip(ids.alias("a"), kinds.alias("b"), words.alias("c"))
    return lines.withColumn("sentence", F.regexp_replace("line", mark, "$3")).withColumn("phrases", F.transform(zipped, lambda z, i: F.struct(z["a"].alias("id"), F.split(z["b"], "/").alias("type"), z["c"].alias("phrase"), at(i).alias("at"))))


def entity_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of an XML annotation file (S12): ``file``, ``id``, ``box``; coordinates count from 0."""
    schema = "filename string, object array<struct<name:array<string>,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>,nobndbox:int,scene:int>>"
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path)
    each = rows.select("filename", F.explode("object").alias("o")).where("o.bndbox is not null").select("filename", F.explode("o.name").alias("id"), F.col("o.bndbox").alias("b"))
    return each.select(F.col("filename").alias("file"), "id", F.array(*[F.col(f"b.{c}") - 1 for c in ("xmin", "ymin", "xmax", "ymax")]).alias("box"))


def grounded_sentences(sentences: DataFrame, boxes: DataFrame) -> DataFrame:
    """Sentences joined with their boxes (S13, J5): phrases without a box keep their words and lose their mark.

    Result: ``image_id``, ``sentence_id``, ``sentence`` with ``<ph_st>…<ph_ed>``, ``boxes``, ``boxes_seq``.
    """
    each = sentences.select("image_id", "sentence_id", "sentence", F.posexplode_outer("phrases").alias("pos", "p")).select("*", F.col("p.id").alias("id"), F.col("p.phrase").alias("phrase"), F.col("p.at").alias("at"))
    with_box = each.join(boxes.select(F.col("file").alias("image_id"), "id", "box"), ["image_id", "id"], "left")
    phrases = with_box.groupBy("image_id", "sentence_id", "sentence", "pos", "phrase", "at").agg(F.sort_array(F.collect_list("box")).alias("bs"))
    whole = phrases.groupBy("image_id", "sentence_id", "sentence").agg(F.sort_array(F.collect_list(F.struct("pos", "phrase", "at", "bs"))).alias("ps"))
    kept = F.filter("ps", lambda p: F.size(p["bs"]) > 0)
    all_boxes = F.array_distinct(F.flatten(F.transform(kept, lambda p: p["bs"])))
    words = F.split("sentence", r"\s+")
    length = lambda p: F.size(F.split(p["phrase"], r"\s+"))
    marked = F.array_join(F.transform(words, lambda w, i: F.concat(F.when(F.exists(kept, lambda p: p["at"] == i), F.lit("<ph_st>")).otherwise(F.lit("")), w, F.when(F.exists(kept, lambda p: p["at"] + length(p) - 1 == i), F.lit("<ph_ed>")).otherwise(F.lit("")))), " ")
    return whole.select("image_id", "sentence_id", marked.alias("sentence"), all_boxes.alias("boxes"), F.transform(kept, lambda p: F.transform(p["bs"], lambda b: (F.array_position(all_boxes, b) - 1).cast("int"))).alias("boxes_seq"))


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """Question templates of a folder of JSON lists (S35, Z1-Z3): ``name``, ``idx``, ``text``."""
    rows = spark.read.option("wholetext", True).text(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^./]*$", 1).alias("name"), "value")
    return rows.select("name", F.posexplode(F.from_json("value", "array<string>")).alias("idx", "text"))


def write_pairs(df: DataFrame, path: str) -> None:
    """Predictions and targets as lines of JSON (S14, S39, Z24); Spark commits whole tasks only."""
    df.write.mode("append").json(path)


def write_results(df: DataFrame, path: str) -> None:
    """Detection results, one array per picture and line."""
    rows = df.groupBy("image_id").agg(F.to_json(F.collect_list(F.struct("image_id", "category_id", "bbox", "score"))).alias("value"))
    rows.select("value").write.mode("append").text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Detection results written as arrays per line."""
    kind = "array<struct<image_id:bigint,category_id:int,bbox:array<double>,score:double>>"
    return spark.read.text(path).select(F.inline(F.from_json("value", kind)))


def write_quarantine(bad: DataFrame, path: str) -> None:
    """Rows set aside, with their reason."""
    bad.write.mode("append").partitionBy("reason").parquet(path)
