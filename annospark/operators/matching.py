"""Assignment of predictions to targets (H1-H8).

Candidate pairs come from a join on size and place, not from all pairs of a
picture. The greedy matcher folds small groups inside one row and works through
large ones in rounds. The Hungarian matcher runs in Python per phrase group (one
class of one picture); such a group has to fit one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..runtime import cut

PAIR = "struct<score:double,i:bigint,j:bigint>"


def greedy_pairs(pairs: Column, least: float = 0.0) -> Column:
    """One-to-one pairs by falling score (H3): ``pairs`` is ``array<struct<score, i, j>>``; ties by ``i``, then ``j``.

    Pairs with a score at or below ``least`` are left out.
    """
    ordered = F.transform(F.array_sort(F.transform(F.filter(pairs, lambda p: p["score"] > least), lambda p: F.struct((-p["score"]).alias("s"), p["i"].alias("i"), p["j"].alias("j")))), lambda p: F.struct((-p["s"]).alias("score"), p["i"].alias("i"), p["j"].alias("j")))
    kind = f"struct<out:array<{PAIR}>,i:array<bigint>,j:array<bigint>>"
    start = F.struct(F.array().cast(f"array<{PAIR}>").alias("out"), F.array().cast("array<bigint>").alias("i"), F.array().cast("array<bigint>").alias("j")).cast(kind)

    def step(s: Column, p: Column) -> Column:
        taken = F.array_contains(s["i"], p["i"]) | F.array_contains(s["j"], p["j"])
        return F.when(taken, s).otherwise(F.struct(F.concat(s["out"], F.array(p.cast(PAIR))).alias("out"), F.concat(s["i"], F.array(p["i"])).alias("i"), F.concat(s["j"], F.array(p["j"])).alias("j")).cast(kind))

    return F.aggregate(ordered, start, step, lambda s: s["out"])


def overlapping_pairs(preds: DataFrame, truths: DataFrame, group: str, least: float = 0.5) -> DataFrame:
    """Pairs of boxes of one group with an overlap of at least ``least`` (> 0): ``group``, ``i``, ``j``, ``iou``.

    ``preds``: ``group``, ``i``, ``pred``; ``truths``: ``group``, ``j``, ``box`` (xyxy). Not all pairs
    of a group are made: such boxes differ by a bounded factor in each side, and
    their centres by a bounded part of it. A prediction gets the cell of its size
    level, a target the few cells where a partner can lie, so the join meets true
    neighbours only, however many boxes one picture holds.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be in (0, 1]")
    side = lambda c, i: F.greatest(F.get(c, F.lit(i + 2)) - F.get(c, F.lit(i)), F.lit(0.0))
    middle = lambda c, i: (F.get(c, F.lit(i)) + F.get(c, F.lit(i + 2))) / 2
    level = lambda n: F.floor(F.log2(n))
    p = preds.where((side("pred", 0) > 0) & (side("pred", 1) > 0)).select(group, "i", "pred", *[level(side("pred", k)).alias(f"l{k}") for k in (0, 1)])
    p = p.select("*", *[F.floor(middle("pred", k) / F.pow(F.lit(2.0), F.col(f"l{k}") + 1)).alias(f"c{k}") for k in (0, 1)])
    t = truths.where((side("box", 0) > 0) & (side("box", 1) > 0)).select(group, "j", "box")
    for k in (0, 1):
        # with overlap at least t: sides within a factor t, centres within half of what the two sides together exceed the common one
        n = side("box", k)
        t = t.withColumn(f"l{k}", F.explode(F.sequence(level(n * least), level(n / least))))
        far = n * (1 - least) / 2 / least
        cell = F.pow(F.lit(2.0), F.col(f"l{k}") + 1)
        t = t.withColumn(f"c{k}", F.explode(F.sequence(F.floor((middle("box", k) - far) / cell), F.floor((middle("box", k) + far) / cell))))
    found = p.join(t, [group, "l0", "l1", "c0", "c1"]).select(group, "i", "j", G.iou(F.col("pred"), F.col("box")).alias("iou"))
    return found.where(F.col("iou") >= least)


#: Most targets of a group whose pairs are all made.
FULL = 64


def group_pairs(preds: DataFrame, truths: DataFrame, group: str, least: float = 0.5) -> DataFrame:
    """The pairs of ``overlapping_pairs``; groups of few targets are joined directly, without cells."""
    positive = lambda c: (F.get(c, F.lit(2)) > F.get(c, F.lit(0))) & (F.get(c, F.lit(3)) > F.get(c, F.lit(1)))
    t = truths.where(positive("box")).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    few = preds.where(positive("pred")).join(t.where(F.col("__n") <= FULL), group).select(group, "i", "j", G.iou(F.col("pred"), F.col("box")).alias("iou"))
    many = t.where(F.col("__n") > FULL).drop("__n")
    return few.where(F.col("iou") >= least).unionByName(overlapping_pairs(preds.join(many.select(group).distinct(), group, "left_semi"), many, group, least))


#: Most candidate pairs of a group that are matched inside one row.
FOLD = 2_000


def greedy_match(scored: DataFrame, group: str, i: str, j: str, score: str, least: float = 0.0) -> DataFrame:
    """Greedy one-to-one pairs per group (H3, H4): ``group``, ``score``, ``i``, ``j``.

    Groups with few candidate pairs are folded within a row. In larger ones the
    pairs that are best for both their sides are taken, their sides leave, and so
    on until none are left: the same pairs, since ties are broken alike, without a
    group ever being in one task.
    """
    rows = scored.where(F.col(score) > least).select(F.col(group).alias("g"), F.col(score).cast("double").alias("score"), F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"))
    rows = cut(rows)  # read for the sizes and by either way
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    small = rows.join(sizes.where(F.col("n") <= FOLD), "g").groupBy("g").agg(F.collect_list(F.struct("score", "i", "j")).alias("p")).select("g", F.inline(greedy_pairs(F.col("p"), least)))
    left = cut(rows.join(sizes.where(F.col("n") > FOLD), "g", "left_semi"))
    out = small
    while not left.isEmpty():
        order = F.struct(F.col("score"), (-F.col("i")).alias("a"), (-F.col("j")).alias("b"))
        by_i = left.groupBy("g", "i").agg(F.max(order).alias("m")).select("g", "i", (-F.col("m.b")).alias("j"))
        by_j = left.groupBy("g", "j").agg(F.max(order).alias("m")).select("g", "j", (-F.col("m.a")).alias("i"))
        taken = cut(left.join(by_i, ["g", "i", "j"], "left_semi").join(by_j, ["g", "i", "j"], "left_semi").select("g", "score", "i", "j"))
        out = out.unionByName(taken)
        left = cut(left.join(taken.select("g", "i"), ["g", "i"], "left_anti").join(taken.select("g", "j"), ["g", "j"], "left_anti"))
    return out.select(F.col("g").alias(group), "score", "i", "j")


def detection_matches(pairs: DataFrame, group: str, i: str, j: str, score: str, iou: str, thresholds: list[float]) -> DataFrame:
    """Detections that hit a target at each overlap (AG29): ``group``, ``threshold``, ``i``, ``j``.

    ``pairs``: all pairs that overlap by at least the lowest of ``thresholds``, with the score of ``i``. As in
    COCO each detection, by falling score (ties by ``i``), takes the free target it overlaps most (ties by the
    larger ``j``). This is the greedy order of the pairs by score, ``i`` and overlap, so ``greedy_match`` finds it.
    """
    rows = pairs.select(F.col(group).alias("g"), F.col(i).alias("i"), F.col(j).alias("j"), F.col(score).alias("s"), F.col(iou).alias("o"))
    degree = lambda side: F.count(F.lit(1)).over(Window.partitionBy("g", side))
    place = F.row_number().over(Window.partitionBy("g").orderBy("s", F.col("i").desc(), "o", "j"))
    marked = cut(rows.withColumn("di", degree("i")).withColumn("dj", degree("j")).withColumn("place", place).drop("s"))
    at = F.explode(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col("o"))).alias("threshold")
    # a pair without rivals on either side is taken at every threshold it reaches
    alone = marked.where("di = 1 and dj = 1").select("g", at, "i", "j")
    rest = marked.where("di > 1 or dj > 1").select("g", at, "i", "j", "place").withColumn("g", F.struct("g", "threshold"))
    found = greedy_match(rest, "g", "i", "j", "place").select("g.g", "g.threshold", "i", "j")
    return alone.unionByName(found).withColumnRenamed("g", group).withColumnRenamed("i", i).withColumnRenamed("j", j)


def best_matches(pairs: Column, iou_least: float = 0.5, sim_least: float = 0.5, strict: bool = False) -> Column:
    """Pairs that satisfy both thresholds (H4): ``array<struct<score, sim, i, j>>``.

    By default pairs that fail are left out first; ``strict`` stops at the best
    remaining pair that fails, as some evaluators do.
    """
    good = lambda p: (p["score"] >= iou_least) & (p["sim"] >= sim_least)
    if not strict:
        return greedy_pairs(F.filter(pairs, good))
    picked = greedy_pairs(pairs)
    ok = lambda p: F.exists(pairs, lambda q: (q["i"] == p["i"]) & (q["j"] == p["j"]) & good(q))
    first_bad = F.array_position(F.transform(picked, lambda p: ~ok(p)), True)
    return F.when(first_bad > 0, F.slice(picked, 1, (first_bad - 1).cast("int"))).otherwise(picked)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Cheapest one-to-one assignment of rows to columns, by shortest augmenting paths; the shorter side is used up."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0] = i
        j0 = 0
        least = np.full(m + 1, np.inf)
        used = np.zeros(m + 1, bool)
        way = np.zeros(m + 1, int)
        while True:
            used[j0] = True
            i0 = row_of[j0]
            free = ~used[1:]
            reduced = c[i0 - 1] - u[i0] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            j1 = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[j1]
            u[row_of[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    found = [(int(row_of[j]) - 1, j - 1) for j in range(1, m + 1) if row_of[j]]
    return sorted((b, a) for a, b in found) if turned else sorted(found)


def hungarian(scored: DataFrame, group: str, i: str, j: str, cost: str) -> DataFrame:
    """Cheapest one-to-one pairs per group (H1, H2, H7) from the costs of its pairs; a missing pair is never chosen."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, rows = np.unique(pdf[i].to_numpy(), return_inverse=True)
        b, cols = np.unique(pdf[j].to_numpy(), return_inverse=True)
        c = np.full((len(a), len(b)), 1e9)
        c[rows, cols] = pdf[cost].to_numpy(float)
        pairs = [(x, y) for x, y in assign(c) if c[x, y] < 1e9]
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(pairs), i: [a[x] for x, _ in pairs], j: [b[y] for _, y in pairs], cost: [c[x, y] for x, y in pairs]})

    kinds = dict(scored.dtypes)
    rows = scored.select(group, i, j, F.col(cost).cast("double").alias(cost))
    degree = lambda side: F.count(F.lit(1)).over(Window.partitionBy(group, side))
    marked = rows.withColumn("__di", degree(i)).withColumn("__dj", degree(j))
    # a pair without rivals on either side is in every assignment; Python sees the others only
    alone = marked.where("__di = 1 and __dj = 1").drop("__di", "__dj")
    rest = marked.where("__di > 1 or __dj > 1").drop("__di", "__dj").groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {i} {kinds[i]}, {j} {kinds[j]}, {cost} double")
    return alone.unionByName(rest)


def cheapest_per_target(scored: DataFrame, group: str, i: str, j: str, cost: str) -> DataFrame:
    """The cheapest prediction of each target, not one to one (H8); ties by ``i``."""
    return scored.groupBy(group, j).agg(F.min(F.struct(F.col(cost).alias("c"), F.col(i).alias("i"))).alias("m")).select(group, j, F.col("m.i").alias(i), F.col("m.c").alias(cost))


def top_class(scores: DataFrame, item: str, label: str, score: str, k: int = 1) -> DataFrame:
    """The ``k`` classes with the highest score of each item (L11, L13); ties by the class."""
    best = scores.groupBy(item).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(label).alias("l")))), 1, k).alias("t"))
    return best.select(item, F.posexplode("t").alias("place", "x")).select(item, "place", F.col("x.l").alias(label), (-F.col("x.s")).alias(score))
