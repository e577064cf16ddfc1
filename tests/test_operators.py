"""Matching, corpora, validation, nested records and ranks against brute force."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from annospark.operators import corpora as K
from annospark.operators import encoding as E
from annospark.operators import grouping as J
from annospark.operators import matching as H
from annospark.operators import nested as N
from annospark.operators import validation as V
from annospark.operators.conversation import session_windows
from annospark.runtime import salted_rank


def test_salted_rank(spark):
    df = spark.createDataFrame([("hot" if i % 3 else None, i) for i in range(500)], "g string, i int")
    rows = salted_rank(df.repartition(5), ["g"], [F.col("i")]).collect()
    for g in ("hot", None):
        assert sorted(r["rank"] for r in rows if r.g == g) == list(range(sum(r.g == g for r in rows)))
    again = salted_rank(df.repartition(2), ["g"], [F.col("i")]).collect()
    assert {r.i: r["rank"] for r in rows} == {r.i: r["rank"] for r in again}
    assert salted_rank(df.limit(0), ["g"], [F.col("i")]).count() == 0


def test_assignment_is_cheapest():
    rng = np.random.default_rng(1)
    for n, m in itertools.product(range(1, 5), range(1, 5)):
        c = rng.random((n, m))
        got = H.assign(c)
        assert len(got) == min(n, m) and len({i for i, _ in got}) == len(got) == len({j for _, j in got})
        short, long = (n, m) if n <= m else (m, n)
        best = min(sum((c if n <= m else c.T)[i, p[i]] for i in range(short)) for p in itertools.permutations(range(long), short))
        assert abs(sum(c[i, j] for i, j in got) - best) < 1e-9
    assert H.assign(np.zeros((0, 3))) == []


def _brute_greedy(pairs):
    out, used_i, used_j = [], set(), set()
    for s, i, j in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if i not in used_i and j not in used_j:
            out.append((i, j))
            used_i.add(i)
            used_j.add(j)
    return set(out)


@pytest.mark.parametrize("fold", [2000, 0])
def test_greedy_match(spark, monkeypatch, fold):
    monkeypatch.setattr(H, "FOLD", fold)
    rng = np.random.default_rng(2)
    pairs = [(g, float(rng.integers(1, 6)) / 5, i, j) for g in "ab" for i in range(6) for j in range(5) if rng.random() < 0.6]
    df = spark.createDataFrame([(g, s, i, j) for g, s, i, j in pairs], "g string, s double, i int, j int")
    got = {}
    for r in H.greedy_match(df, "g", "i", "j", "s").collect():
        got.setdefault(r.g, set()).add((r.i, r.j))
    for g in "ab":
        assert got[g] == _brute_greedy([(s, i, j) for h, s, i, j in pairs if h == g])
    assert H.greedy_match(df.limit(0), "g", "i", "j", "s").count() == 0


def test_overlapping_pairs_are_complete(spark):
    rng = np.random.default_rng(3)
    boxes = [(int(k), [float(x), float(y), float(x + w), float(y + h)]) for k, (x, y, w, h) in enumerate(zip(rng.random(60) * 30 - 5, rng.random(60) * 30 - 5, rng.random(60) * 12 + 0.5, rng.random(60) * 12 + 0.5, strict=True))]
    boxes.append((60, boxes[0][1]))
    df = spark.createDataFrame([("g", k, b) for k, b in boxes], "g string, k int, b array<double>")

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        i = max(w, 0) * max(h, 0)
        return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)

    for least in (0.2, 0.5, 0.9):
        got = [(r.i, r.j) for r in H.overlapping_pairs(df.select("g", F.col("k").alias("i"), F.col("b").alias("pred")), df.select("g", F.col("k").alias("j"), F.col("b").alias("box")), "g", least).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a, p in boxes for b, q in boxes if iou(p, q) >= least}


def test_hungarian_and_others(spark):
    df = spark.createDataFrame([("g", 0, 0, 1.0), ("g", 0, 1, 2.0), ("g", 1, 0, 1.5), ("g", 1, 1, 4.0), ("h", 5, 6, 0.5)], "g string, i int, j int, c double")
    assert {(r.g, r.i, r.j) for r in H.hungarian(df, "g", "i", "j", "c").collect()} == {("g", 0, 1), ("g", 1, 0), ("h", 5, 6)}
    assert {(r.g, r.j, r.i) for r in H.cheapest_per_target(df, "g", "i", "j", "c").collect()} == {("g", 0, 0), ("g", 1, 0), ("h", 6, 5)}
    assert [(r.i, r.j) for r in H.top_class(df.where("g = 'g'"), "i", "j", "c").orderBy("i").collect()] == [(0, 1), (1, 1)]
    pair = lambda s, m, i, j: F.struct(F.lit(s).alias("score"), F.lit(m).alias("sim"), F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j"))
    pairs = F.array(pair(0.9, 0.1, 0, 0), pair(0.8, 0.9, 0, 1))
    r = spark.range(1).select(H.best_matches(pairs).alias("a"), H.best_matches(pairs, strict=True).alias("b")).first()
    assert [(x.i, x.j) for x in r.a] == [(0, 1)] and r.b == []


def test_subsets_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = {r.k for r in K.subset(df.repartition(3), "k", 0.25).collect()}
    assert len(a) == 250 and a == {r.k for r in K.subset(df.repartition(11), "k", 0.25).collect()}
    import hashlib

    order = sorted(range(1000), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    assert a == set(order[:250])
    more = K.shuffled_portion(df, "k", 2.5).groupBy("copy").count().collect()
    assert sum(r["count"] for r in more) == 2500 and len(more) == 3
    with pytest.raises(ValueError):
        K.subset(df, "k", 0.0)
    assert K.sampled_per_group(df.withColumn("g", F.lit(1)), "g", "k", 7).count() == 7


def test_interleaving(spark):
    lengths = {"a": 3, "b": 4, "c": 5}
    df = spark.createDataFrame([(c, p) for c, n in lengths.items() for p in range(n)], "c string, p int")
    offset = {"a": 0, "b": 3, "c": 7}
    flat = lambda out: [offset[r.c] + r.p for r in out.orderBy("out_pos").collect()]
    assert flat(K.interleaved(df, "c", "p")) == [0, 3, 7, 1, 4, 8, 2, 5, 9]
    assert flat(K.interleaved(df, "c", "p", all_exhausted=True)) == [0, 3, 7, 1, 4, 8, 2, 5, 9, 0, 6, 10, 1, 3, 11]
    drawn = K.interleaved_by_probability(df, "c", "p", {"a": 0.5, "b": 0.5, "c": 0.0}, 1000).collect()
    assert len(drawn) == 1000 and {r.c for r in drawn} == {"a", "b"} and 400 < sum(r.c == "a" for r in drawn) < 600
    by_a = [r.p for r in sorted(drawn, key=lambda r: r.turn) if r.c == "a"]
    assert by_a == [k % 3 for k in range(len(by_a))]


def test_shuffled_rounds_keep_entries_aligned(spark):
    df = spark.createDataFrame([(k, [(i, i * 10) for i in range(6)]) for k in range(30)], "k int, r array<struct<q:int,s:int>>")
    rows = df.select("k", K.shuffled_rounds(F.col("r"), F.col("k"), 4).alias("r")).collect()
    assert all(1 <= len(r.r) <= 4 and all(x.s == x.q * 10 for x in r.r) for r in rows) and len({len(r.r) for r in rows}) == 4


def test_batches(spark):
    df = spark.createDataFrame([(i, list(range(i % 7))) for i in range(50)], "k int, ids array<int>").withColumn("labels", F.col("ids"))
    rows = E.padded_batches(df, "k", 8).collect()
    by = {}
    for r in rows:
        by.setdefault(r.batch_id, []).append(r)
    assert sorted(len(v) for v in by.values()) == [2] + [8] * 6
    for v in by.values():
        width = max(r.k % 7 for r in v)
        assert all(len(r.ids) == len(r.labels) == len(r.attention) == len(r.positions) == width and sum(r.attention) == r.k % 7 for r in v)


def test_validation(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    kept = V.common_keys((a, "x"), (b, "x"))
    assert [k.count() for k in kept] == [2, 1] and [(r.x, r.n) for r in V.duplicate_keys(a, "x").collect()] == [(2, 2)]
    good, bad = V.split(a, [("small", F.col("x") > 1)])
    assert good.count() == 2 and bad.first().reason == "small"
    ok = lambda c: spark.range(1).select(c.alias("x")).first().x
    arr = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    assert ok(V.point_encoding_ok(arr(1, 2))) and ok(V.point_encoding_ok(arr(1, 2, -1, -1))) and not ok(V.point_encoding_ok(arr(1, 2, 3, 4)))
    assert ok(V.slots_ok(F.lit("<a> <b>"), ("<a>", "<b>"))) and not ok(V.slots_ok(F.lit("<a><a>"), ("<a>",)))
    assert not ok(V.nested_phrase_ok(F.lit("<Phrase>x <masks></Phrase>"))) and ok(V.nested_phrase_ok(F.lit("<Phrase>x</Phrase><masks>")))


def test_joins(spark):
    names = F.array(F.lit("cat"), F.lit("red cat"))
    assert spark.range(1).select(J.first_contained(F.lit("a red cat"), names).alias("x")).first().x == "cat"
    s = spark.createDataFrame([(1, {"a": 5})], "k int, o map<string,int>")
    q = spark.createDataFrame([(1, ["a", "z"]), (2, ["a"])], "k int, ids array<string>")
    assert {r.k: r.found for r in J.scene_lookup(q, s, "k", "ids", "o").collect()} == {1: [5, None], 2: [None]}


def test_sessions(spark):
    t = spark.createDataFrame([("s", i, "x" * n) for i, n in enumerate((4, 4, 4, 20, 1))], "session string, pos long, value string")
    assert [(r.used, r.resets) for r in session_windows(t, 10).orderBy("pos").collect()] == [(4, 0), (8, 0), (4, 1), (20, 2), (1, 3)]


NESTED = [
    (1, '{"conversations":[{"from":"system","value":[{"task":{"task_name":"vqa"}},null,{"unit":[null,"box"]}]},{"from":"human","value":"q"}]}'),
    (2, '{"conversations": [null, {"value": {"unit": "mask", "task": {"task_name": "vqa"}}, "from": "system"}]}'),
    (3, '{"conversations":[{"from":"system","task":{"task_name":"vqa"},"unit":[]},{"from":"gpt","task":{"task_name":"x"},"value":"[1]"}]}'),
    (4, '{"conversations":[{"from":"system","value":"[{\\"task\\": {\\"task_name\\": \\"vqa\\"}, \\"unit\\": [\\"box\\", \\"point\\"]}]"}]}'),
    (5, '{"conversations":[{"from":"system","value":[{"task":{"task_name":"vqa"},"unit":[null]}]'),
    (6, None), (7, ""), (8, "[]"), (9, "null"), (10, "{}"), (11, '{"conversations": null, "x": [[{"a": [1, {"b": 2.50}]}], []]}'), (12, '{"a": NaN}'),
    (1, '{"conversations":[{"from":"system","value":[{"task":{"task_name":"vqa"}},null,{"unit":[null,"box"]}]},{"from":"human","value":"q"}]}'),
    (13, '{"conversations":{"from":"system","value":[{"unit":"box"}]}}'),
]


def _raw(spark, rows):
    return spark.createDataFrame([(i, None, p) for i, p in rows], "raw_id long, loaded_at timestamp, payload string")


def test_nested_units(spark):
    got = {(r.raw_id, r.turn_idx, r.task_idx, r.unit_idx, r.unit) for r in N.FlatTables(_raw(spark, NESTED).withColumn("node", F.lit("clash"))).unit_rows().collect()}
    assert got == {(1, 0, 0, -1, None), (1, 0, 2, 1, "box"), (2, 1, 0, 0, "mask"), (3, 0, 0, -1, None), (4, 0, 0, 0, "box"), (4, 0, 0, 1, "point"), (13, 0, 0, 0, "box")}


def test_nested_round_trip(spark):
    f = N.FlatTables(_raw(spark, NESTED)).materialised()
    nodes = {r.node: r.content for r in f.nodes.collect()}
    edges = {}
    for r in f.edges.collect():
        edges.setdefault(r.parent, []).append((r.field, r.shape, r.ordinal, r.child, r.scalar))
    roots = {r.raw_id: r.node for r in f.roots.collect()}
    assert set(roots) == {1, 2, 3, 4, 10, 11, 13} and {r.raw_id for r in f.rejects.collect()} == {5, 6, 7, 8, 9, 12}
    for i, p in NESTED:
        if i in roots:
            a, b = N.rebuild(roots[i], nodes, edges), json.loads(p)
            if i == 4:
                for x in (a, b):
                    x["conversations"][0]["value"] = json.loads(x["conversations"][0]["value"])
            assert a == b


def test_nested_identities_are_shared_and_canonical(spark):
    rows = [(1, '{"a": {"x": 1, "y": [1, {"z": null}]}}'), (2, '{ "a" : {"y":[1,{"z":null}],"x":1} }'), (3, '{"b": {"x": 1, "y": [1, {"z": null}]}}')]
    f = N.FlatTables(_raw(spark, rows))
    roots = {r.raw_id: r.node for r in f.roots.collect()}
    assert roots[1] == roots[2] != roots[3] and f.nodes.count() == 4
    assert N.FlatTables(_raw(spark, [(1, "{}")]).limit(0)).unit_rows().count() == 0


def test_nested_depth(spark):
    deep = '{"a":' * 300 + "1" + "}" * 300
    f = N.FlatTables(_raw(spark, [(1, deep), (2, '{"a":' * 200_000 + "1" + "}" * 200_000)])).materialised()
    assert {r.raw_id for r in f.roots.collect()} == {1} and {r.raw_id for r in f.rejects.collect()} == {2}
