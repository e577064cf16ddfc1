"""Queries over raw scores, losses, mask codes and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import losses as L
from ..functions import masks as M
from ..functions import text as T
from ..operators import corpora as K
from ..operators import encoding as E
from ..operators import inference as I
from ..operators import matching as H
from ..operators import metrics as A
from ..runtime import checkpoint_dir, table
from ..streaming import dialogue as S
from . import fixtures as X
from .dialogue import _encoded


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def mask_losses(spark: SparkSession, d: str) -> DataFrame:
    """Dice, focal and their sum; embeddings as logits of a mask of alternating pixels, every eighth invalid."""
    e = _vectors(spark, d)
    logits = F.transform("v", lambda x: x * 5)
    labels = F.transform("v", lambda x, i: F.pmod(F.col("id") + i, F.lit(2)).cast("double"))
    valid = F.transform("v", lambda x, i: F.when(i % 8 > 0, 1.0).otherwise(0.0))
    rows = e.select("id", logits.alias("z"), labels.alias("y"), valid.alias("m"))
    return rows.select("id", *[G.rounded(f(F.col("z"), F.col("y"), F.col("m")), 6).alias(n) for n, f in (("dice", L.dice), ("focal", L.focal), ("both", L.mask_loss))])


def keypoint_losses(spark: SparkSession, d: str) -> DataFrame:
    """Distance, absolute difference over visible points, and visibility; points along a box against those of the moved box."""
    b = X.with_prediction(X.boxes(spark, d))
    at = lambda c, i, k: F.get(c, F.lit(i)) + (F.get(c, F.lit(i + 2)) - F.get(c, F.lit(i))) * k / 16
    points = lambda c: F.transform(F.sequence(F.lit(0), F.lit(16)), lambda k: F.array(at(c, 0, k), at(c, 1, k), F.pmod(k + F.col("ann_id"), F.lit(3)).cast("double")))
    seen = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda k: F.array(F.pmod(k, F.lit(5)) / 2 - 1, F.pmod(k, F.lit(4)) / 2 - 1))
    rows = b.select("ann_id", points("pred").alias("p"), points("box").alias("t"), seen.alias("s"))
    return rows.select("ann_id", G.rounded(L.keypoint_distance(F.col("p"), F.col("t")), 5).alias("distance"), G.rounded(L.keypoint_l1(F.col("p"), F.col("t")), 5).alias("l1"), G.rounded(L.visibility_focal(F.col("s"), F.col("t")), 5).alias("visibility"))


def language_losses(spark: SparkSession, d: str) -> DataFrame:
    """Mean negative log probability of the learned tokens of a sample; the log probability is a function of the place."""
    e = _encoded(spark, d)
    logprobs = F.transform("labels", lambda y, i: -(i % 7 + 1) / 8)
    return e.select("sample_id", G.rounded(L.language_loss(logprobs, F.col("labels")), 6).alias("loss"))


def label_similarity_topk(spark: SparkSession, d: str) -> DataFrame:
    """L11, H5, T28, AG33: the three class centres closest to each embedding; the few centres are one small table."""
    rows = _vectors(spark, d)
    centres = rows.where("label is not null").select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    whole = centres.agg(F.sort_array(F.collect_list(F.struct("label", "c"))).alias("cs"))
    scored = rows.withColumn("cs", whole.scalar()).select("id", F.col("label").alias("truth"), F.transform("cs", lambda s: F.struct(G.rounded(T.cosine(F.col("v"), s["c"]), 6).alias("score"), s["label"].alias("label"))).alias("s"))
    each = scored.select("id", F.inline("s"))
    hit = scored.select("id", I.top_k_correct(F.col("s"), F.col("truth"), 3).alias("hit"))
    return H.top_class(each, "id", "label", "score", 3).join(hit, "id")


def mask_iou_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps of a box and its prediction with both of them, as masks of the whole image."""
    b = X.with_prediction(X.boxes(spark, d))
    both = F.array(*[M.box_mask(F.col(c), F.col("w").cast("int"), F.col("h").cast("int")) for c in ("box", "pred")])
    m = b.select("ann_id", both.alias("m")).select("ann_id", M.iou_matrix(F.col("m"), F.col("m")).alias("x"))
    return m.select("ann_id", *[G.rounded(F.get(F.get("x", F.lit(i)), F.lit(j)), 6).alias(f"iou{i}{j}") for i in (0, 1) for j in (0, 1)])


def mask_codec(spark: SparkSession, d: str) -> DataFrame:
    """M8, M9: masks as compact text and back."""
    b = X.boxes(spark, d).select("ann_id", M.box_mask(F.col("box"), F.col("w").cast("int"), F.col("h").cast("int")).alias("m"))
    back = b.select("ann_id", "m", M.decompressed(M.compressed(F.col("m.counts"))).alias("c"))
    return back.select("ann_id", (F.col("c") == F.col("m.counts")).alias("same"), F.aggregate("c", F.lit(0), lambda s, n: s + n).alias("n_pixels"))


def cardinality(spark: SparkSession, d: str) -> DataFrame:
    """AG34: confident predictions of a picture against its boxes."""
    g = X.boxes(spark, d).groupBy("image_id").agg(F.collect_list("score").alias("s"), F.count(F.lit(1)).cast("int").alias("n"))
    return g.select("image_id", I.cardinality_error(F.col("s"), F.col("n")).cast("int").alias("error"))


def token_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of the tokens of a sample by their ids, and ids without marks below zero."""
    e = _encoded(spark, d)
    kinds = E.token_kinds(F.col("ids"), {"ref": 1, "bou": 2})
    return e.select("sample_id", F.size(F.filter(kinds, lambda x: x > 0)).alias("n_special"), F.size(F.filter(E.non_negative(F.col("ids")), lambda x: x == 0)).alias("n_padded"))


def version_choice(spark: SparkSession, d: str) -> DataFrame:
    """A question layout for every sample, chosen by hash; samples per layout."""
    s = table(spark, d, "samples", "sample_id").dropDuplicates(["sample_id"])
    return s.select(K.chosen(F.col("sample_id"), 9, 7).cast("int").alias("layout")).groupBy("layout").agg(F.count(F.lit(1)).alias("n"))


def any_answer(spark: SparkSession, d: str) -> DataFrame:
    """AG8, A12: answers that are one of several accepted ones, per benchmark."""
    q = table(spark, d, "eval_items", "item_id", "benchmark", "answer").dropDuplicates(["item_id"])
    return q.groupBy("benchmark").agg(F.count_if(A.any_of_correct(F.lower("answer"), F.array(F.col("answer"), F.lit("yes"), F.lit("two")))).alias("n_right"), F.count(F.lit(1)).alias("n"))


def _streamed(spark: SparkSession, source: DataFrame, mode: str) -> DataFrame:
    """What a stream has sent when all that is available is done, with the number of the batch that sent it."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces what it wrote before
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    running = source.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    running.awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in source.schema)}, batch int").parquet(f"{folder}/out")


def _events(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # a stream reads folders: a table that is one file is the only one of its name in its folder
    return reader.parquet(path) if whole else reader.option("pathGlobFilter", "events.parquet").parquet(d)


def stream_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """ST2: accuracy so far per kind of event; the last state each group sent."""
    out = _streamed(spark, S.running_accuracy(_events(spark, d), ["event_type"], F.col("value") > 10), "update")
    last = out.groupBy("event_type").agg(F.max_by(F.struct("n", "n_correct", "accuracy"), "batch").alias("s"))
    return last.select("event_type", F.col("s.n").alias("n"), F.col("s.n_correct").alias("n_correct"), G.rounded(F.col("s.accuracy"), 6).alias("accuracy"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """ST3: events per hour and kind, as a stream that waits for late ones."""
    out = _streamed(spark, S.windowed_counts(_events(spark, d), "ts", ["event_type"], "1 hour", late="36500 days"), "update")
    last = out.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def stream_dialogue(spark: SparkSession, d: str) -> DataFrame:
    """ST1: history of each user with resets beyond 300 characters, as a stream with state."""
    turns = _events(spark, d).select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), F.col("props").alias("value"))
    return _streamed(spark, S.dialogue_state(turns, 300, idle=None), "append").select("session", "pos", "used", "resets")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """ST3: sessions of each user, ended by half an hour without an event."""
    s = S.session_counts(table(spark, d, "events", "ts", "user_id"), "ts", ["user_id"], "30 minutes")
    return s.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "user_id", "n")


QUERIES = {f.__name__: f for f in (mask_losses, keypoint_losses, language_losses, label_similarity_topk, mask_iou_matrix, mask_codec, cardinality, token_kinds, version_choice, any_answer, stream_accuracy, stream_windows, stream_dialogue, event_sessions)}

from .dialogue import _ENCODED  # noqa: E402
from .evaluation import _MASKS  # noqa: E402

_R = X.sql_rounded
_CE = "(greatest({0}, 0) - {0} * {1} + ln(1 + exp(-abs({0}))))"
_FOCAL = "(" + _CE + " * pow(1 - ((1 / (1 + exp(-{0}))) * {1} + (1 - 1 / (1 + exp(-{0}))) * (1 - {1})), 2) * (0.25 * {1} + 0.75 * (1 - {1})))"
_focal = _FOCAL.format

SQL = {
    "mask_losses": f"""with u_ as (select vec_id as id, cast(unnest(embedding) as double) * 5 as z, unnest(range(0, len(embedding))) as i from embeddings), x_ as (select id, z, cast((id + i) % 2 as double) as y, case when i % 8 > 0 then 1.0 else 0.0 end as m, 1 / (1 + exp(-z)) as p from u_),
        l_ as (select id, 1 - (2 * sum(p * m * y) + 1) / (sum(p * m) + sum(y * m) + 1) as dice, sum({_focal('z', 'y')} * m) / sum(m) as focal from x_ group by id)
        select id, {_R("dice", 6)} as dice, {_R("focal", 6)} as focal, {_R("focal + dice", 6)} as both from l_""",
    "keypoint_losses": f"""with {X.PREDS}, k_ as (select *, unnest(range(0, 17)) as k from preds_), p_ as (select ann_id, k, (k + ann_id) % 3 as v, (px1 + (px2 - px1) * k / 16) - (x1 + (x2 - x1) * k / 16) as dx, (py1 + (py2 - py1) * k / 16) - (y1 + (y2 - y1) * k / 16) as dy, (k % 5) / 2 - 1 as a, (k % 4) / 2 - 1 as b from k_)
        select ann_id, {_R("avg(sqrt(dx * dx + dy * dy))", 5)} as distance, {_R("sum(case when v > 0 then abs(dx) + abs(dy) else 0 end)", 5)} as l1, {_R(f"sum({_focal('a', '(case when v = 0 then 1.0 else 0.0 end)')} + {_focal('b', '(case when v = 0 then 0.0 else 1.0 end)')})", 5)} as visibility from p_ group by ann_id""",
    "language_losses": f"""{_ENCODED}, u_ as (select sample_id, unnest(labels) as y, unnest(range(0, len(labels))) as i from all_), l_ as (select sample_id, avg(((i - 1) % 7 + 1) / 8) as loss from u_ where i > 0 and y <> -100 group by 1)
        select all_.sample_id, {_R("loss", 6)} as loss from all_ left join l_ on all_.sample_id = l_.sample_id union all select sample_id, null from s_ where conversations is null""",
    "label_similarity_topk": f"""with c_ as (select label, i, avg(cast(x as double)) as x from (select label, unnest(embedding) as x, unnest(range(0, len(embedding))) as i from embeddings where label is not null) group by 1, 2), v_ as (select label, list(x order by i) as c from c_ group by 1),
        s_ as (select e.vec_id as id, e.label as truth, v_.label, {_R("list_cosine_similarity(cast(e.embedding as double[]), v_.c)", 6)} as score from embeddings e cross join v_), r_ as (select *, row_number() over (partition by id order by score desc, label) as r, bool_or(false) over () from s_),
        h_ as (select id, bool_or(label = truth) as hit from r_ where r <= 3 group by 1)
        select r_.id, cast(r - 1 as int) as place, label, score, hit from r_ join h_ on r_.id = h_.id where r <= 3""",
    "mask_iou_matrix": f"""with {_MASKS}, a_ as (select *, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) as b, greatest(px2 - px1, 0) * greatest(py2 - py1, 0) as p, greatest(least(x2, px2) - greatest(x1, px1), 0) * greatest(least(y2, py2) - greatest(y1, py1), 0) as i from c_)
        select ann_id, case when b > 0 then 1.0 end as iou00, {_R("i / nullif(b + p - i, 0)", 6)} as iou01, {_R("i / nullif(b + p - i, 0)", 6)} as iou10, case when p > 0 then 1.0 end as iou11 from a_""",
    "mask_codec": f"with {X.BOXES} select ann_id, true as same, cast(w * h as int) as n_pixels from boxes_",
    "cardinality": f"with {X.BOXES} select image_id, cast(abs(count(*) filter (where score > 0.5) - count(*)) as int) as error from boxes_ group by 1",
    "token_kinds": f"{_ENCODED} select sample_id, cast(len(list_filter(ids, lambda z: z = 1 or z = 2)) as int) as n_special, cast(len(list_filter(ids, lambda z: z <= 0)) as int) as n_padded from all_ union all select sample_id, -1, -1 from s_ where conversations is null",
    "version_choice": "select cast(cast('0x' || substring(md5('7:' || sample_id), 1, 8) as bigint) % 9 as int) as layout, count(*) as n from (select distinct sample_id from samples) group by 1",
    "any_answer": "select benchmark, count_if(coalesce(lower(answer) = answer or lower(answer) in ('yes', 'two'), false)) as n_right, count(*) as n from (select item_id, any_value(benchmark) as benchmark, any_value(answer) as answer from eval_items group by 1) group by 1",
    "stream_accuracy": f"select event_type, count(*) as n, count_if(value > 10) as n_correct, {_R('count_if(value > 10) / count(*)', 6)} as accuracy from events group by 1",
    "stream_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n from events group by 1, 2",
    "stream_dialogue": """with recursive l_ as (select cast(user_id as varchar) as session, event_id as pos, len(coalesce(props, '')) as n, row_number() over (partition by user_id order by event_id) as k from events),
        h_ as (select session, pos, k, n as used, 0 as resets from l_ where k = 1 union all select l_.session, l_.pos, l_.k, case when h_.used + l_.n > 300 then l_.n else h_.used + l_.n end, case when h_.used + l_.n > 300 and h_.used > 0 then h_.resets + 1 else h_.resets end from h_ join l_ on l_.session = h_.session and l_.k = h_.k + 1)
        select session, pos, cast(used as bigint) as used, cast(resets as int) as resets from h_""",
    "event_sessions": """with g_ as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new_ from events where ts is not null and user_id is not null), s_ as (select user_id, ts, sum(new_) over (partition by user_id order by ts rows unbounded preceding) as s from g_)
        select strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as start, user_id, count(*) as n from s_ group by user_id, s""",
}
