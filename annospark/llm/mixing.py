"""Problem 3: sources mixed to target weights.

Every distinct sample belongs softly to the domains of a mix (its sources, or
the tasks of the first system entry):

1. A classifier fitted on a bounded sample of labelled rows gives the posterior
   of the task where ``task_name`` is missing; where it is there, however
   spelled, and for sources, the posterior is all on one domain.
2. Rates are fitted by distributed projected-gradient least squares: minimise
   the squared distance of the expected domain totals to the targets, each in
   units of its domain's supply, over rates between 0 and the domain's
   ``max_repeats``. A step is one aggregation: the workers replay the gradients so
   far on each cell, projecting after every one, and add up the expected totals,
   so the only state is one number per domain and step. In these units the
   objective's curvature is at most 1, so steps of length 1 always descend. Samples
   that belong to one domain are a cell per domain, added up once; only the
   others are gone over in every step.
3. Rates become whole repeats along their running sum in the order of a hash: a
   sample is taken as often as the sum passes a whole number, so a domain gets
   its total to within one record, and no sample more than its rate rounded up.
   Sums are of integers (billionths), counted in salted buckets, so a source with
   a third of all rows is no single task and the result depends on no order.

The size of a mix is its number of records, or the sum of a ``size`` column
(tokens). Unless ``total`` is given it is the largest at which every listed domain
that has records reaches its share without being repeated too often; with a larger
``total`` scarce domains stop at their cap and the report says what came of it.
Listed domains without records are reported with share 0, and the shares of the
others are scaled to 1. Samples without a label count where they likeliest belong:
when rates become repeats those of a domain are scaled, within the caps, so that
its records by that count reach the target, which the posteriors hit in expectation.

Defined results: a repeated sample counts once; null sources are a domain no mix
lists; an empty table gives no plan and zeros in the report; null or
non-positive targets and repeats count as 0, null or negative sizes too; ties of
the hash go by sample_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, hash_sample

#: Most labelled rows the classifier is fitted on.
SAMPLE = 20_000
BITS = 1 << 14
EPOCHS, RATE = 6, 0.5
#: Most steps of the least-squares fit, and the distance, relative to the mix, at which it ends; the report gives the distance reached.
ROUNDS, CLOSE = 200, 1e-4
#: A step that leaves more than this part of the distance is the last: what then remains lies at the caps.
STALLED = 0.95
#: Rates and sums of them are counted in this part of a repeat.
UNIT = 1_000_000_000
#: Times the rates of a domain are scaled towards its target while samples stop at their caps.
SCALINGS = 12


def normal_task(task: Column) -> Column:
    """Task names without case, blanks and hyphens: ``Gcg Segmentation`` and `` gcg-segmentation`` are one."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(task), r"[\s_\-]+", " ")), F.lit(""))


def labelled_samples(samples: DataFrame, size: str | None = None) -> DataFrame:
    """``sample_id``, ``source``, ``task`` (of the first system entry, null if missing), ``size`` and ``hint``: the words the classifier sees."""
    measure = F.greatest(F.coalesce(F.col(size).cast("double"), F.lit(0.0)), F.lit(0.0)) if size else F.lit(1.0)
    first = F.get(F.col("system_tasks"), F.lit(0))
    turn = F.concat_ws(" ", F.transform("conversations", lambda t: t["value"]))
    hint = F.concat_ws(
        " ",
        F.concat(F.lit("family:"), F.regexp_extract(F.coalesce("source", F.lit("")), r"^([a-z]+)_", 1)),
        F.concat(F.lit("source:"), F.col("source")),
        F.transform(F.coalesce(first["task"]["element"], F.array().cast("array<string>")), lambda e: F.concat(F.lit("element:"), e)),
        F.transform(F.coalesce(first["unit"], F.array().cast("array<string>")), lambda u: F.concat(F.lit("unit:"), u)),
        F.concat(F.lit("use:"), F.coalesce(first["task"]["use_unit"].cast("string"), F.lit("none"))),
        turn,
    )
    return samples.where("sample_id is not null").select(F.col("sample_id").cast("long").alias("sample_id"), "source", normal_task(first["task"]["task_name"]).alias("task"), measure.alias("size"), hint.alias("hint")).dropDuplicates(["sample_id"])


def _grams(hint: str) -> np.ndarray:
    words = hint.lower().split()
    keys = {w if ":" in w else f"w:{w}" for w in words}
    return np.array(sorted({zlib.crc32(k.encode()) % BITS for k in keys}), np.int64)


class TaskModel:
    """Softmax regression on hashed words."""

    def __init__(self, rows: list[tuple[str, str]], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.tasks = sorted({t for t, _ in rows})
        at = {t: k for k, t in enumerate(self.tasks)}
        self.w = np.zeros((BITS, max(1, len(self.tasks))), np.float32)
        x = [_grams(h) for _, h in rows]
        y = np.array([at[t] for t, _ in rows], np.int64)
        h = np.full_like(self.w, 1e-6)
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)) if rows else []:
                g = np.zeros((len(part), len(self.tasks)), np.float32)
                for i, r in enumerate(part):
                    g[i] = self._posterior(x[r])
                g[np.arange(len(part)), y[part]] -= 1
                size = [len(x[r]) for r in part]
                index = np.concatenate([x[r] for r in part])
                some, back = np.unique(index, return_inverse=True)
                grad = np.zeros((len(some), len(self.tasks)), np.float32)
                np.add.at(grad, back, np.repeat(g / len(part), size, axis=0))
                h[some] += grad * grad
                self.w[some] -= RATE * grad / np.sqrt(h[some])

    def _posterior(self, grams: np.ndarray) -> np.ndarray:
        z = self.w[grams].sum(0) / np.sqrt(max(1, len(grams)))
        z = np.exp(z - z.max())
        return z / z.sum()

    def posteriors(self, hints: list[str]) -> np.ndarray:
        """Probabilities of the tasks, a row for each hint."""
        grams = [_grams(h) for h in hints]
        n = np.array([len(g) for g in grams])
        z = np.zeros((len(hints), max(1, len(self.tasks))))
        if n.sum():
            np.add.at(z, np.repeat(np.arange(len(hints)), n), self.w[np.concatenate(grams)])
        z /= np.sqrt(np.maximum(1, n))[:, None]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit_tasks(labelled: DataFrame, sample: int = SAMPLE) -> TaskModel:
    """Fit on at most ``sample`` labelled rows, those with the smallest hash of their key."""
    rows = hash_sample(labelled.where("task is not null"), ["sample_id"], sample).select("task", "hint").collect()
    return TaskModel([(r["task"], r["hint"] or "") for r in rows])


_MEMBER = "sample_id long, size double, kind string, domain string, p array<double>"


def memberships(labelled: DataFrame, model: TaskModel) -> DataFrame:
    """``sample_id``, ``size``, ``kind`` (source or task), ``domain`` and ``p``: null where the sample belongs to ``domain`` alone, else its posteriors in the order of ``model.tasks``."""

    def soft(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) and model.tasks:
                p = model.posteriors(list(pdf["hint"]))
                yield pd.DataFrame({"sample_id": pdf["sample_id"], "size": pdf["size"], "kind": "task", "domain": [model.tasks[k] for k in p.argmax(1)], "p": list(p)})

    none = F.lit(None).cast("array<double>").alias("p")
    by_source = labelled.where("source is not null").select("sample_id", "size", F.lit("source").alias("kind"), F.col("source").alias("domain"), none)
    by_task = labelled.where("task is not null").select("sample_id", "size", F.lit("task").alias("kind"), F.col("task").alias("domain"), none)
    guessed = labelled.where("task is null").select("sample_id", "size", F.coalesce("hint", F.lit("")).alias("hint")).mapInPandas(soft, _MEMBER)
    return by_source.unionByName(by_task).unionByName(guessed)


class Mix:
    """Targets of one mix, and the state of its fit: the steps so far, a number per domain each."""

    def __init__(self, name: str, kind: str, domains: list[str], listed: list[str], shares: list[float], repeats: list[int]):
        self.name, self.kind, self.domains, self.listed = name, kind, domains, listed
        self.share, self.cap = np.array(shares), np.array(repeats, float)
        self.steps: list[np.ndarray] = []
        self.goal, self.distance = np.zeros(len(domains)), 0.0

    def rate(self, p: np.ndarray, cap: np.ndarray) -> np.ndarray:
        """Rates of cells with posteriors ``p`` (cells x domains): every step, each followed by its projection."""
        r = np.zeros(len(p))
        for step in self.steps:
            r = np.clip(r + p @ step, 0, cap)
        return r

    def columns(self, tasks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the mix's domains are among ``tasks``: places there, places here."""
        both = [(tasks.index(d), k) for k, d in enumerate(self.domains) if d in tasks]
        return np.array([a for a, _ in both], int), np.array([b for _, b in both], int)

    def soft(self, posteriors: np.ndarray, tasks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors over the mix's domains, caps, and the likeliest domain, under which a sample counts: -1, with a cap of 0, where that is none of the mix's."""
        there, here = self.columns(tasks)
        p = np.zeros((len(posteriors), len(self.domains)))
        p[:, here] = posteriors[:, there]
        of = np.full(len(tasks), -1)
        of[there] = here
        likely = of[posteriors.argmax(1)]
        return p, np.where(likely >= 0, self.cap[likely], 0.0), likely


def read_mixes(targets: DataFrame) -> list[Mix]:
    """Mixes of the target table, which has a fixed, small number of rows."""
    tidy = targets.select("mix_name", F.col("source"), normal_task(F.col("task_name")).alias("task"), F.coalesce("source", "task_name").alias("listed"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("repeats"))
    by: dict[str, list] = {}
    for r in tidy.where("mix_name is not null and (source is not null or task is not null)").toLocalIterator():
        by.setdefault(r["mix_name"], []).append(r)
    out = []
    for name in sorted(by):
        kind = "source" if any(r["source"] is not None for r in by[name]) else "task"
        of: dict[str, list] = {}
        for r in by[name]:
            if r[kind] is not None:
                of.setdefault(r[kind], []).append(r)
        names = sorted(of)
        out.append(Mix(name, kind, names, [min(r["listed"] for r in of[d]) for d in names], [sum(r["share"] for r in of[d]) for d in names], [max(int(r["repeats"]) for r in of[d]) for d in names]))
    return out


def _soft_totals(member: DataFrame, mixes: list[Mix], tasks: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per mix, expected totals and row sums of the curvature over the samples of several domains, in one distributed pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals, curve = [np.zeros(len(m.domains)) for m in mixes], [np.zeros(len(m.domains)) for m in mixes]
        for pdf in batches:
            if not len(pdf):
                continue
            posteriors, size = np.stack(pdf["p"].to_list()), pdf["size"].to_numpy(float)
            for k, m in enumerate(mixes):
                p, cap, _ = m.soft(posteriors, tasks)
                totals[k] += (size * m.rate(p, cap)) @ p
                curve[k] += (size * (cap > 0) * p.sum(1)) @ p
        rows = [(k, d, totals[k][d], curve[k][d]) for k, m in enumerate(mixes) for d in range(len(m.domains))]
        yield pd.DataFrame(rows, columns=["mix", "domain", "total", "curve"])

    out = {m.name: (np.zeros(len(m.domains)), np.zeros(len(m.domains))) for m in mixes}
    got = member.select("p", "size").mapInPandas(run, "mix int, domain int, total double, curve double").groupBy("mix", "domain").agg(F.sum("total").alias("total"), F.sum("curve").alias("curve"))
    for r in got.collect():
        for side in (0, 1):
            out[mixes[r["mix"]].name][side][r["domain"]] = (r["total"], r["curve"])[side]
    return out


def fit_rates(member: DataFrame, mixes: list[Mix], tasks: list[str], total: dict[str, float] | None = None) -> None:
    """Fit every mix: its steps, its goal per domain, and the distance reached."""
    # one row per source or task that a mix lists, for samples that are sure and for others
    listed = sorted({d for m in mixes for d in m.domains})
    known = {(r["kind"], r["domain"], r["sure"]): r["size"] for r in member.where(F.col("domain").isin(listed)).groupBy("kind", "domain", F.col("p").isNull().alias("sure")).agg(F.sum("size").alias("size")).collect()} if listed else {}
    supply = {m.name: np.array([known.get((m.kind, d, True), 0.0) for d in m.domains]) for m in mixes}
    unsure = member.where(F.col("p").isNotNull())
    soft = [m for m in mixes if m.kind == "task" and m.domains] if tasks else []

    def expected() -> dict[str, tuple[np.ndarray, np.ndarray]]:
        some = [m for m in soft if m in active]
        extra = _soft_totals(unsure, some, tasks) if some else {}
        out = {}
        for m in active:
            more = extra.get(m.name, (0.0, 0.0))
            own = supply[m.name] * m.rate(np.eye(len(m.domains)), m.cap)
            out[m.name] = own + more[0], supply[m.name] + more[1]
        return out

    for m in mixes:
        full = m.cap * (supply[m.name] + np.array([known.get((m.kind, d, False), 0.0) for d in m.domains]))  # every sample as often as its cap allows
        share = np.where(full > 0, m.share, 0)
        share = share / share.sum() if share.sum() > 0 else share
        able = share > 0
        largest = float(np.min(full[able] / share[able])) if able.any() else 0.0
        m.goal, m.steps = share * float((total or {}).get(m.name, largest)), []
    active = list(mixes)
    for _ in range(ROUNDS):
        now = expected()
        for m in list(active):
            got, curve = now[m.name]
            gap = m.goal - got
            before, m.distance = m.distance, float(np.abs(gap).sum() / max(1.0, m.goal.sum()))
            if m.distance < CLOSE or m.steps and m.distance > STALLED * before:
                active.remove(m)
            else:
                m.steps.append(np.where(curve > 0, gap / np.maximum(curve, 1e-9), 0.0))
        if not active:
            break


def running_repeats(rates: DataFrame, by: list[str], key: str, units: str, name: str = "repeats", bits: int = 6) -> DataFrame:
    """Whole repeats of integer rates (in ``UNIT``): how many whole numbers the running sum, in hash order within ``by``, passes at each row.

    Rows of a group are put into buckets by the first ``bits`` of their hash; the sums
    of the buckets before are added to the sum within.
    """
    order = F.xxhash64(F.lit("mix"), F.col(key))
    keyed = rates.withColumn("__h", order).withColumn("__b", F.shiftright("__h", 64 - bits))
    sums = keyed.groupBy(*by, "__b").agg(F.sum(units).alias("__s"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select(*by, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(*by, "__b").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, 0)
    upto = keyed.withColumn("__u", F.sum(units).over(inside)).join(offset, [*by, "__b"]).withColumn("__u", F.col("__u") + F.col("__o") + UNIT // 2)
    whole = lambda c: F.floor(c / F.lit(UNIT))
    return upto.withColumn(name, (whole(F.col("__u")) - whole(F.col("__u") - F.col(units))).cast("int")).drop("__h", "__b", "__u", "__o")


def mix_sources(samples: DataFrame, targets: DataFrame, total: dict[str, float] | None = None, sample: int = SAMPLE, size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The plan (how often each sample is taken, zero left out) and the report per mix and domain.

    Plan: ``mix_name``, ``sample_id``, ``domain`` (the likeliest listed one, as the
    target table writes it),
    ``rate``, ``repeats``. Report: target and actual shares, records available,
    records taken, the most repeats of one sample, the size of the mix and the
    distance at which the fit ended. ``size`` names a column to mix by; without it each record counts 1.
    """
    spark = samples.sparkSession
    labelled = labelled_samples(samples, size)
    mixes = read_mixes(targets)
    model = fit_tasks(labelled, sample) if any(m.kind == "task" for m in mixes) else TaskModel([])
    member = cut(memberships(labelled, model))
    tasks = model.tasks
    fit_rates(member, mixes, tasks, total)

    def rated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sure = pdf["p"].isna().to_numpy()
            for k, m in enumerate(mixes):
                mine = (pdf["kind"] == m.kind).to_numpy()
                at = {d: i for i, d in enumerate(m.domains)}
                hard = pdf[mine & sure]
                domain = np.array([at.get(d, -1) for d in hard["domain"]], int)
                one = m.rate(np.eye(len(m.domains)), m.cap)
                some = domain >= 0
                yield pd.DataFrame({"mix": k, "place": domain[some], "sample_id": hard["sample_id"].to_numpy()[some], "size": hard["size"].to_numpy(float)[some], "rate": one[domain[some]]})
                soft = pdf[mine & ~sure]
                if len(soft) and m.domains:
                    p, cap, likely = m.soft(np.stack(soft["p"].to_list()), tasks)
                    some = likely >= 0
                    yield pd.DataFrame({"mix": k, "place": likely[some], "sample_id": soft["sample_id"].to_numpy()[some], "size": soft["size"].to_numpy(float)[some], "rate": m.rate(p, cap)[some]})

    rates = cut(member.mapInPandas(rated, "mix int, place int, sample_id long, size double, rate double"))
    scale = _scaled(rates, mixes)
    names = spark.createDataFrame([(k, d, m.name, m.listed[d], float(m.cap[d]), float(scale[k][d])) for k, m in enumerate(mixes) for d in range(len(m.domains))], "mix int, place int, mix_name string, domain string, cap double, scale double")
    scaled = rates.join(names, ["mix", "place"]).withColumn("rate", F.round(F.least(F.col("rate") * F.col("scale"), "cap"), 9)).withColumn("units", F.round(F.col("rate") * UNIT).cast("long"))
    drawn = cut(running_repeats(scaled, ["mix_name", "domain"], "sample_id", "units").select("mix_name", "sample_id", "domain", "rate", "repeats", "size"))
    plan = drawn.where("repeats > 0").drop("size")
    listed = spark.createDataFrame([(m.name, m.kind, d, float(s), int(c), m.distance) for m in mixes for d, s, c in zip(m.listed, m.share, m.cap, strict=True)], "mix_name string, kind string, domain string, target_share double, max_repeats int, fit_distance double")
    taken = drawn.groupBy("mix_name", "domain").agg(F.sum("repeats").cast("long").alias("taken"), F.sum(F.col("repeats") * F.col("size")).alias("taken_size"), F.count(F.lit(1)).alias("available"), F.max("repeats").alias("most_repeats"))
    whole = drawn.groupBy("mix_name").agg(F.sum(F.col("repeats") * F.col("size")).alias("mix_size"))
    share = F.coalesce(F.round(F.try_divide(F.coalesce("taken_size", F.lit(0.0)), F.col("mix_size")), 6), F.lit(0.0))
    report = (
        listed.join(taken, ["mix_name", "domain"], "left")
        .join(whole, "mix_name", "left")
        .select("mix_name", "kind", "domain", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), share.alias("actual_share"), F.coalesce("mix_size", F.lit(0.0)).alias("mix_size"), F.round("fit_distance", 6).alias("fit_distance"))
    )
    return plan, report


def _scaled(rates: DataFrame, mixes: list[Mix]) -> list[np.ndarray]:
    """Factors per mix and domain by which rates are multiplied, within the caps, so that records by their likeliest domain reach the goal; one aggregation for each pass."""
    spark = rates.sparkSession
    scale = [np.ones(len(m.domains)) for m in mixes]
    for _ in range(SCALINGS):
        rows = [(k, d, float(m.cap[d]), float(scale[k][d])) for k, m in enumerate(mixes) for d in range(len(m.domains))]
        if not rows:
            break
        now = spark.createDataFrame(rows, "mix int, place int, cap double, scale double")
        sums = rates.join(now, ["mix", "place"]).groupBy("mix", "place").agg(F.sum(F.least(F.col("rate") * F.col("scale"), "cap") * F.col("size")).alias("got"))
        worst = 0.0
        for r in sums.collect():
            m, d = mixes[r["mix"]], r["place"]
            if r["got"] > 0:
                factor = m.goal[d] / r["got"]
                worst = max(worst, abs(m.goal[d] - r["got"]))
                scale[r["mix"]][d] *= factor
        if worst < 0.25:
            break
    return scale
