import numpy as np
import pytest
from pyspark.sql import functions as F

from annospark.operators import inference as I


PICTURE = "image_id long, h int, w int, classes array<array<double>>, masks array<array<double>>"


def raw(spark, *pictures):
    return spark.createDataFrame([(k, h, w, [list(map(float, c)) for c in cs] if cs is not None else None, [list(map(float, m)) for m in ms] if ms is not None else None) for k, h, w, cs, ms in pictures], PICTURE)


def test_scores_of_pictures(spark):
    left, right, middle = [9, 9, -9, -9] * 2, [-9, -9, 9, 9] * 2, [-9, 9, 9, -9] * 2
    df = raw(spark, (1, 2, 4, [[5, -5, -5], [-5, 5, -5], [-5, -5, 5]], [left, right, middle]), (2, 2, 4, [[-5, 5, -5], [-5, 5, -5]], [left, right]), (3, 2, 4, [[-5, 5]], [left]), (4, 2, 2, None, None), (5, 2, 4, [[5, -5], [4, -5]], [[9] * 8, left]))
    seg = sorted((r.image_id, r.segment, r.category_id, r.thing, list(r.pixels)) for r in I.panoptic_segments(df, [0]).collect())
    assert seg == [(1, 0, 0, True, [0, 1, 4, 5]), (1, 1, 1, False, [2, 3, 6, 7]), (2, 0, 1, False, list(range(8))), (5, 0, 0, True, list(range(8)))]
    sem = {(r.image_id, r.pixel): r for r in I.semantic_labels(df).collect()}
    assert sem[1, 0].category_id == 0 and sem[1, 3].category_id == 1 and sem[1, 0].score > 0.9 and len(sem) == 32
    found = sorted((r.image_id, r.query, r.category_id, round(r.score, 3), list(r.counts)) for r in I.instance_rows(df, [0, 1], 2).where("image_id = 1").collect())
    assert found == [(1, 0, 0, 0.993, [0, 4, 4]), (1, 1, 1, 0.993, [4, 4])]


def test_segments_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pictures = [(k, 3, 4, rng.normal(0, 3, (5, 4)), rng.normal(0, 2, (5, 12))) for k in range(25)]
    got = {(r.image_id, r.segment, r.category_id, tuple(r.pixels)) for r in I.panoptic_segments(raw(spark, *pictures), [0, 1], 0.5).collect()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    want = set()
    for k, _, _, c, m in pictures:
        live = [q for q in range(5) if c[q].argmax() < 3]
        won = {q: [p for p in range(12) if max(live, key=lambda z: sig(c[z].max()) * sig(m[z][p])) == q] for q in live}  # noqa: B023
        merged = {}
        for q in live:
            mine = tuple(p for p in won[q] if m[q][p] >= 0)
            if mine and len(won[q]) / (m[q] >= 0).sum() >= 0.5:
                label = int(c[q].argmax())
                merged.setdefault((label, q if label < 2 else None), []).append((q, mine))
        want |= {(k, min(q for q, _ in v), label, tuple(sorted(p for _, ps in v for p in ps))) for (label, _), v in merged.items()}
    assert got == want


def test_stroke_box():
    before = np.zeros((4, 4))
    after = before.copy()
    after[1:3, 0:4] = 1
    assert I.stroke_box(before, after) == [0, 1, 3, 2] and I.stroke_box(before, before) is None


def test_model_boundary(spark):
    df = spark.createDataFrame([(1, "red cup"), (2, "red cup"), (3, None)], "key long, text string")
    rows = {r.key: r.vector for r in I.predict(df, I.hash_encoder(8), "key long, vector array<double>").collect()}
    assert rows[1] == rows[2] and abs(sum(x * x for x in rows[1]) - 1) < 1e-9 and not any(rows[3])
    m = [[9.0, 9.0, -9.0, -9.0]]
    raw = spark.createDataFrame([(7, 2, 2, [[5.0, -5.0]], m), (8, 2, 2, None, None)], "image_id long, h int, w int, classes array<array<double>>, masks array<array<double>>")
    r = I.instance_rows(raw, [0]).collect()
    assert [(x.image_id, x.category_id, list(x.counts)) for x in r] == [(7, 0, [0, 1, 1, 1, 1])]


def test_pipeline(spark):
    I.mapping("twice")(lambda df, by=2: df.withColumn("x", F.col("x") * by))
    df = spark.createDataFrame([(3,)], "x int")
    assert I.pipeline(df, ["twice", {"function": "twice", "args": {"by": 5}}, lambda d: d.where("x > 0")]).first().x == 30
    with pytest.raises(KeyError):
        I.pipeline(df, ["nothing"])


def test_columns(spark):
    s = lambda *xs: F.array(*[F.struct(F.lit(a).alias("score"), F.lit(b).alias("label")) for a, b in xs])
    p = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(o).alias("iou"), F.lit(n).alias("label")) for i, j, o, n in ((0, 0, 0.2, "a"), (0, 1, 0.7, "b"), (0, 2, 0.6, "a"), (1, 0, 0.9, "z"))])
    r = spark.range(1).select(
        I.top_k_correct(s((0.2, "a"), (0.7, "b"), (0.1, "c")), F.lit("a"), 2).alias("t2"),
        I.top_k_correct(s((0.2, "a"), (0.7, "b"), (0.1, "c")), F.lit("a"), 1).alias("t1"),
        I.cardinality_error(F.array(F.lit(0.9), F.lit(0.1)), F.lit(3)).alias("c"),
        I.global_matches(p, F.create_map(F.lit(0), F.array(F.lit("a")), F.lit(1), F.array(F.lit("b")))).alias("g"),
        F.size(I.prompt_masks(F.array(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))), F.lit(2), F.lit(2), 1)).alias("n"),
    ).first()
    assert (r.t2, r.t1, r.c, r.n) == (True, False, 2, 1) and [(x.i, x.j) for x in r.g] == [(0, 2)]
