"""Metrics as aggregations of a predictions table joined to a targets table (AG1-AG35).

Ratios over nothing are null (``try_divide``), counts are 0. A prediction that is
missing counts as wrong. All reductions are partial and final aggregates; captions
are scored from n-gram counts, never from collected texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def ratio(a: Column, b: Column) -> Column:
    """Quotient, null over zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def words(text: Column) -> Column:
    """Lower-cased words without punctuation (AG3)."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def ngrams(tokens: Column, n: int) -> Column:
    """All ``n``-grams of an array of words, as text."""
    return F.when(F.size(tokens) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.array_join(F.slice(tokens, i + 1, n), " ")))


def vqa_correct(pred: Column, target: Column) -> Column:
    """A one-word target must be among the words of the prediction, a longer one be it (AG8)."""
    return F.coalesce(F.when(F.size(F.split(target, " ")) == 1, F.array_contains(F.split(pred, " "), target)).otherwise(pred == target), F.lit(False))


def any_of_correct(pred: Column, targets: Column) -> Column:
    """The prediction is one of several accepted answers (AG8)."""
    return F.coalesce(F.array_contains(targets, pred), F.lit(False))


def accuracy(correct: Column) -> Column:
    """Share of true values."""
    return ratio(F.sum(correct.cast("int")), F.count(F.lit(1)))


def binary_metrics(pred: Column, target: Column) -> list[Column]:
    """Accuracy, precision, recall, F1, share of yes, and missing values (AG10, AG11); anything but ``no`` is yes."""
    p, t = F.coalesce(pred != "no", F.lit(True)), F.coalesce(target != "no", F.lit(True))
    tp, fp, fn, tn = (F.count_if(c) for c in (p & t, p & ~t, ~p & t, ~p & ~t))
    return [
        ratio(tp + tn, F.count(F.lit(1))).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + fp, F.count(F.lit(1))).alias("yes_ratio"), F.count_if(pred.isNull()).alias("failed"), F.count_if(target.isNull()).alias("target_failed"),
    ]


def set_metrics(pred: Column, target: Column) -> dict[str, Column]:
    """Jaccard, precision and recall of two sets of a sample (AG22, AG24); two empty sets agree."""
    p, t = F.array_distinct(F.coalesce(pred, F.array())), F.array_distinct(F.coalesce(target, F.array()))
    both = F.size(F.array_intersect(p, t))
    one = lambda a, b: F.coalesce(ratio(a, b), F.when((F.size(p) == 0) & (F.size(t) == 0), 1.0).otherwise(0.0))
    return {"jaccard": one(both, F.size(F.array_union(p, t))), "precision": one(both, F.size(p)), "recall": one(both, F.size(t))}


def bleu(df: DataFrame, pred: str, target: str, by: list[str] | None = None, n: int = 4) -> DataFrame:
    """Corpus BLEU-1 to -n with one reference per row (AG4): clipped counts within each row, summed over the corpus."""
    by = by or []
    rows = df.select(*by, words(F.col(pred)).alias("p"), words(F.col(target)).alias("t"))
    columns = [F.sum(F.size("p")).alias("lp"), F.sum(F.size("t")).alias("lt"), F.count(F.lit(1)).alias("n_rows")]
    for k in range(1, n + 1):
        gp, gt = ngrams(F.col("p"), k), ngrams(F.col("t"), k)
        rows = rows.withColumn(f"gp{k}", gp).withColumn(f"gt{k}", gt)
        clipped = F.aggregate(F.transform(F.array_distinct(f"gp{k}"), lambda g: F.least(F.size(F.filter(F.col(f"gp{k}"), lambda x: x == g)), F.size(F.filter(F.col(f"gt{k}"), lambda x: x == g)))), F.lit(0), lambda s, x: s + x)  # noqa: B023
        columns += [F.sum(clipped).alias(f"hit{k}"), F.sum(F.size(f"gp{k}")).alias(f"all{k}")]
    total = rows.groupBy(*by).agg(*columns)
    brevity = F.when(F.col("lp") >= F.col("lt"), F.lit(1.0)).otherwise(F.exp(1 - ratio(F.col("lt"), F.col("lp"))))
    out, logs = [], F.lit(0.0)
    for k in range(1, n + 1):
        logs = logs + F.when(F.col(f"hit{k}") > 0, F.log(ratio(F.col(f"hit{k}"), F.col(f"all{k}"))))
        out.append(F.coalesce(brevity * F.exp(logs / k), F.lit(0.0)).alias(f"bleu{k}"))
    return total.select(*by, "n_rows", *out)


def cider(df: DataFrame, key: str, pred: str, target: str, n: int = 4) -> DataFrame:
    """CIDEr of each row (AG5): tf-idf cosine of n-grams, averaged over 1..n, times 10; document counts over all targets.

    N-grams are exploded once, counted per row and joined on the row and gram, so
    a gram in every caption costs one row per caption and no pairs.
    """
    base = df.select(F.col(key).alias("k"), words(F.col(pred)).alias("p"), words(F.col(target)).alias("t"))
    # n-grams of both sides and all sizes are exploded from one row
    of = lambda side, i: F.transform(ngrams(F.col(side), i), lambda g: F.struct(F.lit(side).alias("side"), F.lit(i).alias("n"), g.alias("g")))
    grams = base.select("k", F.inline(F.flatten(F.array(*[of(side, i) for side in ("p", "t") for i in range(1, n + 1)]))))
    tf = grams.groupBy("k", "n", "g").agg(F.count_if(F.col("side") == "p").alias("cp"), F.count_if(F.col("side") == "t").alias("ct"))
    df_counts = tf.where("ct > 0").groupBy("n", "g").agg(F.count(F.lit(1)).alias("df"))
    total = base.agg(F.count(F.lit(1))).scalar()
    weighted = tf.join(df_counts, ["n", "g"], "left").withColumn("idf", F.log(total.cast("double") / F.greatest(F.coalesce("df", F.lit(0)), F.lit(1))))
    per = weighted.groupBy("k", "n").agg(F.sum(F.least("cp", "ct") * F.col("ct") * F.col("idf") * F.col("idf")).alias("dot"), F.sqrt(F.sum(F.pow(F.col("cp") * F.col("idf"), 2))).alias("np"), F.sqrt(F.sum(F.pow(F.col("ct") * F.col("idf"), 2))).alias("nt"))
    scored = per.groupBy("k").agg((F.sum(F.coalesce(F.try_divide(F.col("dot"), F.col("np") * F.col("nt")), F.lit(0.0))) / n * 10).alias("s"))
    lengths = base.select("k", F.exp(-F.pow((F.size("p") - F.size("t")).cast("double"), 2) / 72.0).alias("pen"))
    return lengths.join(scored, "k", "left").select(F.col("k").alias(key), (F.coalesce("s", F.lit(0.0)) * F.col("pen")).alias("cider"))


def meteor(pred: Column, target: Column) -> Column:
    """METEOR by exact matches (AG6): harmonic mean weighted to recall, with the penalty of broken chunks."""
    p, t = words(pred), words(target)
    kind = "struct<rest:array<string>,at:array<int>>"
    positions = F.aggregate(p, F.struct(t.alias("rest"), F.array().cast("array<int>").alias("at")).cast(kind), lambda s, w: F.struct(F.transform(s["rest"], lambda x, i: F.when(i == F.array_position(s["rest"], w) - 1, F.lit("")).otherwise(x)).alias("rest"), F.concat(s["at"], F.array(F.array_position(s["rest"], w).cast("int"))).alias("at")).cast(kind), lambda s: s["at"])
    hit = F.filter(positions, lambda x: x > 0)
    m = F.size(hit)
    chunks = F.size(F.filter(F.transform(positions, lambda x, i: F.when((x > 0) & ((i == 0) | (F.get(positions, i - 1) != x - 1) | (F.get(positions, i - 1) == 0)), 1)), lambda x: x.isNotNull()))
    precision, recall = ratio(m, F.size(p)), ratio(m, F.size(t))
    mean = F.try_divide(10 * precision * recall, recall + 9 * precision)
    return F.coalesce(mean * (1 - 0.5 * F.pow(ratio(chunks, m), 3)), F.lit(0.0))


#: Values that are added in one node of a tree of sums, and the rows of one task, a power of it.
FANOUT, SPAN = 16, 16**4


def tree_sums(values: np.ndarray, first: int, base: float = 0.0) -> np.ndarray:
    """Running sums of values that are the leaves ``first``, … of a tree of sums, from ``base``; the last bits are those of a window in DuckDB.

    Up to each value the ragged front is added first, then whole nodes, the largest in the middle, then the ragged end.
    """
    front = min(len(values), -first % FANOUT)
    head = np.cumsum(np.r_[base, values[:front]])
    rest, nodes = values[front:], (len(values) - front) // FANOUT
    if not len(rest):
        return head[1:]
    whole = rest[: nodes * FANOUT].reshape(nodes, FANOUT)
    above = tree_sums(whole.cumsum(1)[:, -1], (first + front) // FANOUT, head[-1]) if nodes else head[:0]
    starts = np.r_[head[-1], above]
    inside = np.concatenate([starts[:-1, None], whole], axis=1).cumsum(1)[:, 1:]
    inside[:, -1] = above
    return np.concatenate([head[1:], inside.ravel(), np.cumsum(np.r_[starts[-1], rest[nodes * FANOUT :]])[1:]])


def _with_tree_sums(placed: DataFrame, by: list[str], total: int, span: int) -> DataFrame:
    """``placed`` with ``__s``, the sum by ``tree_sums`` of ``__v`` from row ``__first`` to row ``__p`` of the tree, ``span`` rows at a time.

    The spans' own sums, one row each, are added by group first where there are several.
    """
    spans = placed.withColumn("__c", F.expr(f"__p div {span}"))
    numbers = lambda t, name: t[name].fill_null(0.0).to_numpy().astype(float)
    keys = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in by)

    def node(t: pa.Table) -> pa.Table:
        t = t.sort_by("__p")
        at = t["__p"][0].as_py() % span
        return t.slice(0, 1).select([*by, "__c", "__first"]).append_column("__whole", pa.array([t.num_rows == span])).append_column("__sum", pa.array([tree_sums(numbers(t, "__v"), at)[-1]], pa.float64()))

    def over(t: pa.Table) -> pa.Table:
        t = t.sort_by("__c")
        first, sums, whole = t["__first"][0].as_py(), numbers(t, "__sum"), t["__whole"].to_numpy()
        ragged = int(first % span > 0)
        base = sums[0] if ragged else 0.0
        upto = tree_sums(sums[ragged:][whole[ragged:]], -(-first // span), base)
        starts = np.r_[np.zeros(ragged), base, upto][: len(sums)]
        ends = [upto[i - ragged] if w else None for i, w in enumerate(whole)]
        return t.select([*by, "__c"]).append_column("__start", pa.array(starts, pa.float64())).append_column("__end", pa.array(ends, pa.float64()))

    def rows(t: pa.Table) -> pa.Table:
        t = t.sort_by("__p")
        sums = tree_sums(numbers(t, "__v"), t["__p"][0].as_py() % span, t["__start"][0].as_py())
        if t["__end"][0].is_valid:
            sums[-1] = t["__end"][0].as_py()
        return t.append_column("__s", pa.array(sums, pa.float64()))

    if total > span:
        nodes = spans.select(*by, "__c", "__p", "__first", "__v").groupBy(*by, "__c").applyInArrow(node, f"{keys}, __c long, __first long, __whole boolean, __sum double")
        tops = nodes.groupBy(*by).applyInArrow(over, f"{keys}, __c long, __start double, __end double")
        tops = tops.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__c").alias("__kc"), "__start", "__end")
        spans = spans.join(tops, [*[F.col(f"__k_{c}").eqNullSafe(F.col(c)) for c in by], F.col("__c") == F.col("__kc")]).select(*spans.columns, "__start", "__end")
    else:
        spans = spans.select("*", F.lit(0.0).alias("__start"), F.lit(None).cast("double").alias("__end"))
    return spans.groupBy(*by, "__c").applyInArrow(rows, StructType([*spans.schema.fields, StructField("__s", DoubleType())]))


def smoothed_rows(df: DataFrame, by: list[str], order: str, value: str, size: int = 20, block_rows: int = 200_000, tree: Column | None = None, span: int = SPAN) -> DataFrame:
    """The rows with ``median``, ``avg`` (of the last ``size`` values of their group) and ``global_avg`` (AG32, W4), however large a group is.

    Rows are cut into blocks of about ``block_rows`` by the range of ``order``, a number. The last
    ``size`` - 1 values of the blocks before, at most as many blocks, are carried into each block of
    a group, as are the counts of all before; every window then lies within one block. Ties of
    ``order`` must not occur within a group; null values take no part in median and means.

    The sums of ``global_avg`` are added in a fixed order, that of ``tree_sums``, so no bit depends on blocks or
    partitions. Each group has a tree of its own, or groups of equal ``tree``, in the order of ``by``, share one.
    """
    total = df.count()
    blocks = max(1, -(-total // block_rows))
    if blocks > 1:
        edges = df.agg(F.percentile_approx(order, [k / blocks for k in range(1, blocks)], 10_000)).scalar()
        cut_ = df.withColumn("__e", edges).withColumn("__b", F.size(F.filter("__e", lambda e: e < F.col(order)))).drop("__e")
    else:
        cut_ = df.withColumn("__b", F.lit(0))
    keep = size - 1
    last = Window.partitionBy(*by, "__b").orderBy(F.col(order).desc())
    tails = cut_.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= keep).groupBy(*by, "__b").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("__t"))
    sums = cut_.groupBy(*by, "__b").agg(F.count(value).alias("__n"), F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*by).orderBy("__b")
    some, all_ = before.rowsBetween(-keep, -1), before.rowsBetween(Window.unboundedPreceding, -1)
    shared = all_ if tree is None else Window.partitionBy(tree).orderBy(*by, "__b").rowsBetween(Window.unboundedPreceding, -1)
    null_safe = [F.col(f"__k_{c}").eqNullSafe(F.col(c)) for c in by]
    one = tails.join(sums.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__b").alias("__kb"), "__n", "__rows"), [*null_safe, F.col("__b") == F.col("__kb")]).select(*by, "__b", "__t", "__n", "__rows")
    upto = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    carried = one.select(*by, "__b", F.flatten(F.collect_list("__t").over(some)).alias("__c"), upto("__n", all_).alias("__pn"), upto("__rows", all_).alias("__pr"), upto("__rows", shared).alias("__pt"))
    head = carried.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__b").alias("__kb"), F.when(F.size("__c") > keep, F.slice("__c", -keep, keep)).otherwise(F.col("__c")).alias("__c"), "__pn", "__pt", (F.col("__pt") - F.col("__pr")).alias("__first"))
    own = cut_.select("*", F.lit(True).alias("__own"), F.col(value).alias("__v"), F.col(order).alias("__o"))
    earlier = head.select(*[F.col(f"__k_{c}").alias(c) for c in by], F.col("__kb").alias("__b"), F.explode("__c").alias("x")).select(*by, "__b", F.lit(False).alias("__own"), F.col("x.v").alias("__v"), F.col("x.o").alias("__o"))
    frame = Window.partitionBy(*by, "__b").orderBy("__o")
    window = frame.rowsBetween(-keep, 0)
    inside = frame.rowsBetween(Window.unboundedPreceding, 0)
    done = own.unionByName(earlier, allowMissingColumns=True).select("*", F.percentile("__v", F.lit(0.5)).over(window).alias("median"), F.avg("__v").over(window).alias("avg"), F.count(F.when(F.col("__own"), F.col("__v"))).over(inside).alias("__cn"), F.count_if("__own").over(inside).alias("__cr")).where("__own")
    joined = done.join(head.drop("__c"), [*null_safe, F.col("__b") == F.col("__kb")])
    placed = joined.select(*df.columns, "median", "avg", F.col("__v").cast("double").alias("__v"), (F.col("__cn") + F.col("__pn")).alias("__n"), (F.col("__pt") + F.col("__cr") - 1).alias("__p"), "__first")
    return _with_tree_sums(placed, by, total, span).withColumn("global_avg", ratio(F.col("__s"), F.col("__n"))).select(*df.columns, "median", "avg", "global_avg")


def average_precision(matches: DataFrame, truths: DataFrame, by: list[str], score: str, hit: str) -> DataFrame:
    """Interpolated average precision at 101 recalls (AG29, AG30).

    ``matches``: one row per detection with its score and whether it hit a target,
    with a unique ``det_id``; ``truths``: ``by`` and ``n_truth``. Detections are
    ranked per group with ties by ``det_id``; the cumulative counts of a group run
    over pre-aggregated score buckets first, so no group is one sort of all rows.
    """
    bucketed = matches.withColumn("__b", F.floor((1 - F.col(score)) * 1000).cast("int"))
    sizes = bucketed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(hit).cast("int")).alias("__h"))
    earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select(*by, "__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__on"), F.coalesce(F.sum("__h").over(earlier), F.lit(0)).alias("__oh"))
    inside = Window.partitionBy(*by, "__b").orderBy(F.col(score).desc(), "det_id").rowsBetween(Window.unboundedPreceding, 0)
    curve = bucketed.withColumn("__rn", F.count(F.lit(1)).over(inside)).withColumn("__tp", F.sum(F.col(hit).cast("int")).over(inside)).join(offset, [*by, "__b"]).select(*by, (F.col("__rn") + F.col("__on")).alias("n"), (F.col("__tp") + F.col("__oh")).alias("tp"))
    points = curve.join(truths, by).select(*by, ratio(F.col("tp"), F.col("n")).alias("precision"), F.floor(F.col("tp") * 100 / F.col("n_truth")).cast("int").alias("step")).groupBy(*by, "step").agg(F.max("precision").alias("precision"))
    # precision at a recall is the best at that recall or any higher one: at most 101 rows per group
    steps = points.groupBy(*by).agg(F.collect_list(F.struct("step", "precision")).alias("__c"))
    at = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda r: F.coalesce(F.array_max(F.transform(F.filter(F.col("__c"), lambda x: x["step"] >= r), lambda x: x["precision"])), F.lit(0.0)))
    scored = steps.select(*by, (F.aggregate(at, F.lit(0.0), lambda s, x: s + x) / 101).alias("ap"))
    return truths.select(*by, "n_truth").join(scored, by, "left").select(*by, "n_truth", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def coco_scores(matches: DataFrame, truths: DataFrame, by: list[str], score: str, at: str, thresholds: list[float]) -> DataFrame:
    """``average_precision`` of each threshold, and their mean recall (AG29): ``by``, ``n_truth``, ``aps`` (array), ``ar``.

    ``matches``: one row per detection with its score, a unique ``det_id`` and in ``at`` the thresholds at
    which it hit (null: none). The order of detections is that of all thresholds, so it is made once.
    """
    hits = [f"__h{k}" for k in range(len(thresholds))]
    hit = lambda t: F.coalesce(F.array_contains(at, F.lit(float(t))), F.lit(False)).cast("int")
    bucketed = matches.select(*by, F.col(score).alias("__s"), "det_id", F.floor((1 - F.col(score)) * 1000).cast("int").alias("__b"), *[hit(t).alias(h) for h, t in zip(hits, thresholds, strict=True)])
    sizes = bucketed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(h).alias(h) for h in hits])
    earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select(*by, "__b", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_o") for c in ("__n", *hits)])
    inside = Window.partitionBy(*by, "__b").orderBy(F.col("__s").desc(), "det_id").rowsBetween(Window.unboundedPreceding, 0)
    curve = bucketed.select(*by, "__b", F.count(F.lit(1)).over(inside).alias("__n"), *[F.sum(h).over(inside).alias(h) for h in hits]).join(offset, [*by, "__b"])
    each = curve.select(*by, (F.col("__n") + F.col("__n_o")).alias("n"), F.posexplode(F.array(*[F.col(h) + F.col(f"{h}_o") for h in hits])).alias("k", "tp"))
    points = each.join(truths, by).select(*by, "k", "tp", ratio(F.col("tp"), F.col("n")).alias("precision"), F.floor(F.col("tp") * 100 / F.col("n_truth")).cast("int").alias("step"))
    best = points.groupBy(*by, "k", "step").agg(F.max("precision").alias("precision"), F.max("tp").alias("tp")).groupBy(*by, "k").agg(F.collect_list(F.struct("step", "precision")).alias("__c"), F.max("tp").alias("tp"))
    reached = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda r: F.coalesce(F.array_max(F.transform(F.filter(F.col("__c"), lambda x: x["step"] >= r), lambda x: x["precision"])), F.lit(0.0)))
    one = best.select(*by, "k", "tp", (F.aggregate(reached, F.lit(0.0), lambda s, x: s + x) / 101).alias("ap"))
    all_ = one.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ap"))), lambda x: x["ap"]).alias("aps"), F.sum("tp").alias("__tp"))
    none = F.array(*[F.lit(0.0) for _ in hits])
    return truths.select(*by, "n_truth").join(all_, by, "left").select(*by, "n_truth", F.coalesce("aps", none).alias("aps"), ratio(F.coalesce("__tp", F.lit(0)), F.col("n_truth") * len(hits)).alias("ar"))
