import numpy as np
import pytest
from pyspark.sql import functions as F

from annospark.llm import mixing as M

SAMPLE = "sample_id long, source string, system_tasks array<struct<task:struct<task_name:string,element:array<string>,use_unit:boolean>,unit:array<string>>>, conversations array<struct<sender:string,value:string>>, domain string"


def sample(k, source, task, words):
    entry = [((task, ["x"], True), ["box"])] if task != "none" else []
    return (k, source, entry, [("human", words)], "clash")


@pytest.fixture(scope="module")
def samples(spark):
    rows = [sample(k, "hot", "vqa" if k % 5 else None, "what colour is it") for k in range(600)]
    rows += [sample(1000 + k, "mid", (" Detection", "detection", "DETECTION", None)[k % 4], "find every box here") for k in range(120)]
    rows += [sample(2000 + k, "tiny", "gcg-segmentation", "ground each phrase") for k in range(5)]
    rows += [sample(3000, None, "vqa", "x"), (3001, "hot", None, None, "clash"), sample(3002, "hot", "none", ""), rows[0], rows[0]]
    return spark.createDataFrame(rows, SAMPLE).repartition(3)


def targets(spark, rows):
    return spark.createDataFrame(rows, "mix_name string, source string, task_name string, target_share double, max_repeats int")


def test_shares_caps_and_report(spark, samples):
    t = targets(spark, [("m", "hot", None, 0.5, 1), ("m", "mid", None, 0.4, 2), ("m", "tiny", None, 0.1, 3), ("n", "mid", None, 0.7, 1), ("n", "nowhere", None, 0.3, 5), (None, "hot", None, 1.0, 1), ("z", "hot", None, None, None)])
    plan, report = M.mix_sources(samples, t)
    by = {(r.mix_name, r.domain): r for r in report.collect()}
    assert (by["m", "tiny"].taken, by["m", "tiny"].most_repeats) == (15, 3) and by["m", "hot"].taken == 75 and by["m", "mid"].taken == 60
    for d in ("hot", "mid", "tiny"):
        assert abs(by["m", d].actual_share - by["m", d].target_share) < 1e-6
    assert by["n", "nowhere"].taken == 0 and by["n", "mid"].actual_share == 1.0 and by["n", "mid"].taken == 120
    assert by["z", "hot"].taken == 0
    rows = plan.collect()
    caps = {"hot": 1, "mid": 2, "tiny": 3}
    assert all(0 < r.repeats <= caps[r.domain] for r in rows if r.mix_name == "m")
    assert len({(r.mix_name, r.sample_id) for r in rows}) == len(rows)
    again = {(r.mix_name, r.sample_id, r.repeats) for r in M.mix_sources(samples.repartition(9), t)[0].collect()}
    assert again == {(r.mix_name, r.sample_id, r.repeats) for r in rows}


def test_total_beyond_the_scarcest(spark, samples):
    t = targets(spark, [("m", "hot", None, 0.5, 1), ("m", "tiny", None, 0.5, 2)])
    by = {r.domain: r for r in M.mix_sources(samples, t, total={"m": 400})[1].collect()}
    assert by["tiny"].taken == 10 and abs(by["hot"].taken - 200) <= 1


def test_tasks_with_missing_names(spark, samples):
    t = targets(spark, [("t", None, "vqa", 0.5, 1), ("t", None, "detection", 0.5, 3)])
    plan, report = M.mix_sources(samples, t)
    by = {r.domain: r for r in report.collect()}
    assert abs(by["vqa"].actual_share - 0.5) < 0.03 and by["detection"].available >= 110
    assert by["detection"].most_repeats <= 3


def test_classifier_on_held_out_rows(spark, samples):
    labelled = M.labelled_samples(samples).where("task is not null")
    rows = labelled.collect()
    model = M.TaskModel([(r.task, r.hint) for r in rows if r.sample_id % 2])
    held = [r for r in rows if r.sample_id % 2 == 0]
    best = [model.tasks[k] for k in model.posteriors([r.hint for r in held]).argmax(1)]
    assert sum(a == r.task for a, r in zip(best, held, strict=True)) >= 0.95 * len(held)
    assert abs(model.posteriors(["anything", ""]).sum(1) - 1).max() < 1e-9


def test_every_share_within_one_record(spark, samples):
    """Many small groups of equal rates: nothing is lost by rounding."""
    t = targets(spark, [("t", None, "vqa", 0.6, 1), ("t", None, "detection", 0.3, 2), ("t", None, "gcg segmentation", 0.1, 9)])
    report = M.mix_sources(samples, t)[1].collect()
    size = sum(r.taken for r in report)
    assert all(abs(r.taken - r.target_share * size) <= 1.01 for r in report) and all(r.fit_distance < 0.01 for r in report)


def test_size_column(spark, samples):
    t = targets(spark, [("m", "hot", None, 0.5, 1), ("m", "mid", None, 0.5, 2)])
    weighted = samples.withColumn("tokens", F.when(F.col("source") == "mid", 10).otherwise(1))
    by = {r.domain: r for r in M.mix_sources(weighted, t, size="tokens")[1].collect()}
    assert abs(by["hot"].taken - 10 * by["mid"].taken) <= 10 and abs(by["hot"].actual_share - 0.5) < 0.01


def test_projection_after_every_step():
    m = M.Mix("m", "task", ["a", "b"], ["a", "b"], [0.5, 0.5], [1, 1])
    m.steps = [np.array([3.0, -1.0]), np.array([-0.4, 0.2])]
    # up to the cap of 1, then back by 0.4: not the 1 that the clipped sum of both steps would give
    assert abs(m.rate(np.array([[1.0, 0.0]]), np.ones(1))[0] - 0.6) < 1e-12


def test_running_repeats(spark):
    rows = [("g", k, 300_000_000 + k % 7) for k in range(1000)] + [("h", k, 2_500_000_000) for k in range(3)]
    got = M.running_repeats(spark.createDataFrame(rows, "g string, k long, units long"), ["g"], "k", "units").collect()
    g = [r.repeats for r in got if r.g == "g"]
    assert sum(g) == round(sum(u for n, _, u in rows if n == "g") / M.UNIT) and set(g) == {0, 1}
    assert sorted(r.repeats for r in got if r.g == "h") == [2, 3, 3]


def test_empty(spark, samples):
    t = targets(spark, [("m", "hot", None, 1.0, 1)])
    plan, report = M.mix_sources(samples.limit(0), t)
    assert plan.count() == 0 and report.first().taken == 0
    assert M.mix_sources(samples, t.limit(0))[1].count() == 0
    assert samples.select(M.normal_task(F.lit(" Gcg-Segmentation "))).first()[0] == "gcg segmentation"
