"""Truth tables and properties of the column functions."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annospark.functions import geometry as G
from annospark.functions import losses as L
from annospark.functions import masks as M
from annospark.functions import text as T
from annospark.operators import conversation as C
from annospark.operators import encoding as E
from annospark.operators import metrics as A


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def box(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_geometry(spark):
    w, h = F.lit(5), F.lit(4)
    assert value(spark, G.expand_box(box(0, 0, 1, 1), w, h)) == [0.0, 0.0, 1.0, 1.0]  # odd difference: offset 0
    assert value(spark, G.expand_box(box(0, 0, 1, 1), F.lit(4), F.lit(8))) == [2.0, 0.0, 3.0, 1.0]
    assert value(spark, G.normalize_box(box(-5, 1, 20, 2), F.lit(16), F.lit(16))) == [0.0, 0.063, 1.0, 0.125]
    assert value(spark, G.xyxy_to_center(box(0, 0, 4, 2), 3)) == [2.0, 1.0, 4.0, 2.0]
    assert value(spark, G.center_to_xyxy(box(2, 1, 4, 2))) == [0.0, 0.0, 4.0, 2.0]
    assert value(spark, G.square_to_origin(box(0.25, 0.5, 0.75, 1.0), F.lit(100), F.lit(50))) == [25.0, 25.0, 75.0, 50.0]
    assert value(spark, G.square_to_origin(box(0.25, 0.5, 0.75, 1.0), F.lit(40), F.lit(40))) == [10.0, 20.0, 30.0, 40.0]
    assert value(spark, G.xywh_to_xyxy(box(1, 2, 3, 4))) == [1.0, 2.0, 4.0, 6.0] and value(spark, G.xyxy_to_xywh(box(1, 2, 4, 6))) == [1.0, 2.0, 3.0, 4.0]
    assert value(spark, G.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == 1 / 7 and value(spark, G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0
    assert abs(value(spark, G.giou(box(0, 0, 1, 1), box(2, 0, 3, 1))) + 1 / 3) < 1e-12
    assert value(spark, G.valid_box(box(3, 0, 2, 1))) is False and value(spark, G.valid_box(box(1, 1, 1, 1))) is True and value(spark, G.valid_box(F.lit(None).cast("array<double>"))) is False
    flat = [1.0, 2.0, 3.0, 4.0, 0.0, 1.0]
    arr = F.array(*[F.lit(x) for x in flat])
    assert value(spark, G.keypoints_split(arr)) == [1.0, 2.0, 0.0, 3.0, 4.0, 1.0] and value(spark, G.keypoints_join(G.keypoints_split(arr))) == flat
    assert value(spark, G.denormalize_keypoint(box(0.5, 0.26, 0), F.lit(10), F.lit(10))) == [0.0, 0.0, 0.0]
    assert value(spark, G.oks(F.array(box(0, 0, 2)), F.array(box(0, 0, 2)), F.lit(4.0))) == 1.0
    assert value(spark, G.resize_longest(box(0, 0, 10, 5), F.lit(10), F.lit(5), 20)) == [0.0, 0.0, 20.0, 10.0]
    assert value(spark, G.normalize_box(F.array(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)), F.lit(2), F.lit(2))) == [None, 0.5, 0.5, 0.5]


def test_text(spark):
    s = F.lit("a <boxes> b <boxes>")
    assert value(spark, T.splice(s, "<boxes>", F.array(F.lit("X"), F.lit("Y")))) == "a X b Y"
    assert value(spark, T.splice(s, "<boxes>", F.array(F.lit("X")))) == "a X b "
    assert value(spark, T.format_numbers(F.array(box(0.1, 0.25, 1, 0)))) == "[0.100,0.250,1.000,0.000]"
    assert value(spark, T.extract_rows(F.lit("see [0.1,0.2,0.3,0.4;1,1,1,1] and [0.5,0.5]"))) == [[[0.1, 0.2, 0.3, 0.4], [1.0, 1.0, 1.0, 1.0]]]
    assert value(spark, T.extract_rows(F.lit("at (0.5,0.25)"), 2, True)) == [[[0.5, 0.25]]]
    assert value(spark, T.placeholder_order(F.lit("<masks> x <boxes><masks>"), ("<boxes>", "<masks>"))) == ["<masks>", "<boxes>", "<masks>"]
    e = value(spark, T.phrase_elements(F.lit("<Phrase>dog</Phrase><boxes><boxes>, <Phrase>a man</Phrase><masks>, <Phrase>x</Phrase>")))
    assert [(x.phrase, x.placeholder, x.n) for x in e] == [("dog", "<boxes>", 2), ("a man", "<masks>", 1), ("x", None, 0)]
    assert value(spark, T.vqa_answer(F.lit("USER: q ASSISTANT: The answer is Red. So.</s>"))) == "red"
    assert value(spark, T.yes_no_answer(F.lit("ASSISTANT: Yes, there is"))) == "yes" and value(spark, T.yes_no_answer(F.lit("ASSISTANT: the answer is No ."))) == "no" and value(spark, T.yes_no_answer(F.lit("unclear"))) == "no"
    text = F.lit("<Task>\nUnit decode (True). Head:\n- Name: <Phrase>dog</Phrase> Unit: <Unit>box</Unit> Num: 2\n</Task>\n<Phrase>dog</Phrase>(<Unit>box</Unit>[0]<REF>[1]<REF>), ok.")
    assert [(x.name, x.unit, x.n) for x in value(spark, T.triples(text))] == [("dog", "box", 2)]
    assert [(x.name, x.unit, x.n) for x in value(spark, T.task_lines(text))] == [("dog", "box", 2)]
    assert [(x.name, x.unit, x.n) for x in value(spark, T.answer_units(text))] == [("dog", "box", 2)]
    assert [(x.name, x.unit, x.n) for x in value(spark, T.box_mask_triples(F.lit("Name: a  Unit: <Unit>mask</Unit> Num: 3")))] == [("a", "mask", 3)]
    assert [(x.name, x.unit, x.n) for x in value(spark, T.old_answer_units(F.lit("<Phrase>dog</Phrase>(<Unit>box</Unit><REF>[0], <Unit>box</Unit><REF>[1])")))] == [("dog", "box", 2)]
    assert value(spark, T.caption_text(text)) == "dog , ok."
    assert value(spark, T.list_literal(F.lit("['pine', 'wood']"))) == ["pine", "wood"] and value(spark, T.list_literal(F.lit("oops"))) is None
    assert value(spark, T.reference_ids(F.lit("a (12,3) b (4)"))) == [[12, 3], [4]]
    assert value(spark, T.zero_fill(F.lit(42))) == "000000000042" and value(spark, T.stem(F.lit("/a/b.c.jpg"))) == "b"
    assert value(spark, T.nth_occurrence(F.lit("Cat and cat"), F.lit("CAT"), F.lit(2))) == 8 and value(spark, T.nth_occurrence(F.lit("x"), F.lit("cat"), F.lit(1))) == -1
    assert value(spark, T.marked_answer(F.lit("the answer is a. the answer is b."))) is None
    assert value(spark, T.lettered(F.array(F.lit("x"), F.lit("y")))) == "(A) x (B) y"
    span = lambda a, b, s: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), s.alias("seq"))
    one = F.array(F.lit(0))
    r = value(spark, T.insert_phrases(F.lit("a dog a cat"), F.array(span(8, 11, one), span(2, 5, F.array(F.lit(1), F.lit(2))))))
    assert r.text == "a <Phrase>dog</Phrase><boxes><boxes> a <Phrase>cat</Phrase><boxes>" and r.seq == [[1, 2], [0]]


def test_round_trip_of_compiled_answers(spark):
    out = F.lit("<Phrase>dogs</Phrase><boxes><boxes> and <Phrase>a man</Phrase><boxes>.")
    seq = F.array(F.array(F.lit(0), F.lit(1)), F.array(F.lit(2)))
    full = C.answer_text(out, seq)
    assert value(spark, T.strip_task(full)).strip() == "<Phrase>dogs</Phrase>(<Unit>box</Unit>[0]<REF>[1]<REF>) and <Phrase>a man</Phrase>(<Unit>box</Unit>[0]<REF>)."
    assert [(x.name, x.unit, x.n) for x in value(spark, T.plain_triples(full))] == [("dogs", "box", 2), ("a man", "box", 1)]
    assert [(g.phrase, g.unit, g.n) for g in value(spark, E.reference_groups(full))] == [("dogs", "box", 2), ("a man", "box", 1)]
    odd = value(spark, E.reference_groups(F.lit("<REF> <Phrase>a</Phrase><REF><REF> <Unit>box</Unit><REF>")))
    assert [(g.phrase, g.unit, g.n) for g in odd] == [(None, None, 1), ("a", None, 2), (None, "box", 1)]
    assert value(spark, C.answer_text(F.lit(""), seq)) == ""


def test_encoding(spark):
    r = F.array(F.struct(F.lit("USER: <image> a [VPT] ASSISTANT:").alias("input"), F.lit("b c").alias("output"), F.lit(True).alias("need_eos"), F.lit("x").alias("sep")))
    e = value(spark, E.encoded(r))
    assert e.ids[0] == 1 and -200 in e.ids and -300 in e.ids and len(e.ids) == len(e.labels)
    assert [x for x in e.labels if x != -100][-1] == 2 and len([x for x in e.labels if x != -100]) == 3
    f = value(spark, E.with_features(F.array(F.lit(1), F.lit(-200), F.lit(5)), F.array(F.lit(-100), F.lit(-100), F.lit(5)), 3))
    assert f.ids == [1, -200, -200, -200, 5] and f.labels == [-100, -100, -100, -100, 5] and f.kinds == [0, 6, 6, 6, 0]
    sizes = F.array(*[F.lit(x) for x in (2, 3, 1)])
    assert [value(spark, E.trimmed_groups(sizes, F.lit(n))) for n in (6, 4, 2, 0)] == [[2, 3, 1], [2, 2], [2], []]
    assert value(spark, E.fixed_length(F.array(F.lit(1)), 3, F.lit(0))) == [1, 0, 0] and value(spark, E.prompt_ids(F.array(F.lit(7), F.lit(8)), F.array(F.lit(-100), F.lit(8)))) == [7]
    assert value(spark, E.token_kinds(F.array(F.lit(5), F.lit(9)), {"ref": 9})) == [0, 1] and value(spark, E.non_negative(F.array(F.lit(-200), F.lit(3)))) == [0, 3]


def _runs(dense):
    return M._runs(np.asarray(dense, bool))


def test_masks(spark):
    m = lambda c, h, w: F.struct(F.lit(h).alias("h"), F.lit(w).alias("w"), F.array(*[F.lit(x) for x in c]).alias("counts"))
    for x1, y1, x2, y2 in ((1, 1, 3, 2), (0, 0, 5, 4), (0, 0, 0, 0), (4, 3, 9, 9), (2, 0, 3, 4), (-2, -2, 1, 1)):
        d = np.zeros((4, 5), bool)
        d[max(y1, 0) : max(y2, 0), max(x1, 0) : max(x2, 0)] = True
        got = value(spark, M.box_mask(box(x1, y1, x2, y2), F.lit(5), F.lit(4)))
        assert got.counts == _runs(d), (x1, y1, x2, y2)
        assert value(spark, M.area(m(got.counts, 4, 5))) == d.sum()
        ys, xs = np.nonzero(d)
        assert value(spark, M.bounds(m(got.counts, 4, 5))) == ([float(xs.min()), float(ys.min()), float(xs.max()), float(ys.max())] if len(xs) else None)
        sq = value(spark, M.expand_square(m(got.counts, 4, 5)))
        assert M._dense(sq.counts, 5, 5).sum() == d.sum() and (M._dense(sq.counts, 5, 5)[:4] == d).all()
    disc = value(spark, M.disc_mask(F.lit(2.0), F.lit(1.0), 2, F.lit(5), F.lit(4)))
    yy, xx = np.mgrid[:4, :5]
    assert (M._dense(disc.counts, 4, 5) == ((xx - 2) ** 2 + (yy - 1) ** 2 <= 4)).all()
    rng = np.random.default_rng(0)
    for _ in range(4):
        a, b = rng.random((6, 7)) > 0.5, rng.random((6, 7)) > 0.5
        assert value(spark, M.intersection(m(_runs(a), 6, 7), m(_runs(b), 6, 7))) == (a & b).sum()
        assert abs(value(spark, M.iou(m(_runs(a), 6, 7), m(_runs(b), 6, 7))) - (a & b).sum() / (a | b).sum()) < 1e-12
    assert value(spark, M.from_pixels(F.array(*[F.lit(x) for x in (1, 1, 0, 1)]), F.lit(2), F.lit(2))).counts == [0, 2, 1, 1]
    assert value(spark, M.compressed(F.array(F.lit(0), F.lit(2), F.lit(14)))) == M.compress([0, 2, 14])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), min_size=1, max_size=40))
def test_compressed_masks_round_trip(counts):
    assert M.decompress(M.compress(counts)) == counts


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.data())
def test_runs_round_trip(h, w, data):
    d = np.array(data.draw(st.lists(st.booleans(), min_size=h * w, max_size=h * w))).reshape(h, w)
    assert (M._dense(M._runs(d), h, w) == d).all()


def test_resampling_masks(spark):
    d = np.zeros((8, 8), bool)
    d[2:6, 2:6] = True
    rows = spark.createDataFrame([((8, 8, _runs(d)), 8, 4, 0.5, 3)], "m struct<h:int,w:int,counts:array<int>>, w int, h int, r double, k int")
    r = rows.select(M.square_to_origin("m", "w", "h").alias("o"), M.resized("m", "r").alias("s"), M.dilated("m", "k").alias("g")).first()
    assert (r.o.h, r.o.w) == (4, 8) and sum(r.o.counts[1::2]) == 16 and (r.s.h, r.s.w) == (4, 4) and sum(r.g.counts[1::2]) == 36


def test_losses(spark):
    arr = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    sig = lambda x: 1 / (1 + np.exp(-x))
    z, y, v = np.array([2.0, -1.0, 0.5]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 1.0, 0.0])
    p = sig(z)
    dice = 1 - (2 * (p * y * v).sum() + 1) / ((p * v).sum() + (y * v).sum() + 1)
    assert abs(value(spark, L.dice(arr(*z), arr(*y), arr(*v))) - dice) < 1e-9
    ce = -(y * np.log(p) + (1 - y) * np.log(1 - p))
    pt = p * y + (1 - p) * (1 - y)
    focal = ((0.25 * y + 0.75 * (1 - y)) * ce * (1 - pt) ** 2 * v).sum() / v.sum()
    assert abs(value(spark, L.focal(arr(*z), arr(*y), arr(*v))) - focal) < 1e-9
    assert value(spark, L.box_l1(arr(0, 0, 1, 1), arr(1, 0, 1, 3))) == 3.0
    assert value(spark, L.language_loss(arr(-1, -3, -9), F.array(F.lit(-100), F.lit(4), F.lit(-100)))) == 1.0
    assert value(spark, L.keypoint_l1(F.array(arr(1, 1, 2), arr(5, 5, 2)), F.array(arr(0, 0, 2), arr(0, 0, 0)))) == 2.0
    assert value(spark, L.weighted({"a": F.lit(2.0), "b": F.lit(None).cast("double")}, {"a": 3.0})) == 6.0


def test_metrics(spark):
    assert value(spark, A.words(F.lit("A  dog, runs!"))) == ["a", "dog", "runs"] and value(spark, A.words(F.lit(None).cast("string"))) == []
    assert value(spark, A.vqa_correct(F.lit("a red cup"), F.lit("red"))) is True and value(spark, A.vqa_correct(F.lit("a red cup"), F.lit("red cup"))) is False
    assert value(spark, A.meteor(F.lit("the cat sat"), F.lit("the cat sat"))) == 1 * (1 - 0.5 * (1 / 3) ** 3)
    assert value(spark, A.meteor(F.lit(""), F.lit("x"))) == 0.0
    df = spark.createDataFrame([("1", "the cat sat on the mat", "the cat is on the mat")], "k string, p string, t string")
    b = A.bleu(df, "p", "t").first()
    assert abs(b.bleu1 - 5 / 6) < 1e-9 and abs(b.bleu2 - (5 / 6 * 3 / 5) ** 0.5) < 1e-9 and b.bleu4 == 0.0
    two = spark.createDataFrame([("1", "a red cup", "a red cup"), ("2", "a big dog", "a big dog"), ("3", "x", "a blue hat")], "k string, p string, t string")
    c = {r.k: r.cider for r in A.cider(two, "k", "p", "t").collect()}
    assert c["1"] > 7 and c["2"] > 7 and c["3"] == 0.0
    m = spark.createDataFrame([("a", 0.9, True, 1), ("a", 0.8, False, 2), ("a", 0.7, True, 3)], "c string, score double, hit boolean, det_id int")
    ap = A.average_precision(m, spark.createDataFrame([("a", 2), ("b", 1)], "c string, n_truth int"), ["c"], "score", "hit").orderBy("c").collect()
    assert abs(ap[0].ap - (51 * 1.0 + 50 * 2 / 3) / 101) < 1e-9 and ap[1].ap == 0.0
    r = spark.createDataFrame([("yes", "no"), ("no", "no"), (None, "yes")], "p string, t string").agg(*A.binary_metrics(F.col("p"), F.col("t"))).first()
    assert (r.precision, r.recall, r.failed) == (0.5, 1.0, 1)
    assert spark.createDataFrame([], "p string, t string").agg(*A.binary_metrics(F.col("p"), F.col("t"))).first().accuracy is None
