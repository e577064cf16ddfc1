import numpy as np
import pytest
from pyspark.sql import functions as F

from annospark.llm import packing as P


def test_nnls_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((6, 9)), rng.random(6)
        x = P.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g <= 1e-6).all() and abs((x * g).sum()) < 1e-6


@pytest.mark.parametrize("capacity", [16, 100, 512, 4096])
def test_plans_hold_everything_once(capacity):
    rng = np.random.default_rng(capacity)
    for shape in ("wide", "small", "hot", "one", "large"):
        n = {"wide": rng.integers(1, capacity + 1, 700), "small": rng.integers(1, max(2, capacity // 20), 900), "hot": np.where(rng.random(600) < 0.4, capacity // 3, rng.integers(1, capacity + 1, 600)), "one": np.array([capacity // 2 + 1] * 50), "large": rng.integers(capacity // 2 + 1, capacity + 1, 300)}[shape]
        h = {int(k): int(c) for k, c in zip(*np.unique(n, return_counts=True), strict=True)}
        used: dict[int, int] = {}
        containers = 0
        for lengths, number in P.plan(h, capacity):
            assert number > 0 and 0 < sum(lengths) <= capacity
            containers += number
            for x in lengths:
                used[x] = used.get(x, 0) + number
        assert used == h
        if shape in ("wide", "small"):
            assert containers <= 1.06 * n.sum() / capacity + 2, (shape, containers, n.sum() / capacity)


def test_plan_size_does_not_follow_the_corpus():
    rng = np.random.default_rng(3)
    n = np.minimum(rng.lognormal(5.5, 0.8, 4000).astype(int) + 1, 2048)
    h = {int(k): int(c) for k, c in zip(*np.unique(n, return_counts=True), strict=True)}
    small, large = P.plan(h, 2048), P.plan({k: c * 1000 for k, c in h.items()}, 2048)
    assert len(large) < 10 * len(small) and sum(c for _, c in large) <= 1.02 * sum(k * c * 1000 for k, c in h.items()) / 2048


def _check(rows, docs, specs):
    counts = {r.doc_id: r.n_tokens for r in P.token_counts(docs).collect()}
    for s in specs.collect():
        mine = [r for r in rows if r.pack_id == s.pack_id]
        assert {r.doc_id for r in mine} == set(counts)
        by: dict[int, list] = {}
        for r in mine:
            if r.container_id is not None:
                by.setdefault(r.container_id, []).append(r)
        assert sorted(by) == list(range(len(by)))
        for v in by.values():
            v.sort(key=lambda r: r.place)
            assert [r.place for r in v] == list(range(len(v)))
            at = 0
            for r in v:
                assert r.token_offset == at
                at += r.n_tokens + s.sep_tokens
            assert at - s.sep_tokens <= s.capacity
        for d, n in counts.items():
            own = sorted((r for r in mine if r.doc_id == d), key=lambda r: r.piece)
            assert sum(r.n_tokens for r in own) == n and [r.piece for r in own] == list(range(len(own)))
            assert len(own) == 1 or n > s.capacity and all(r.n_tokens == s.capacity for r in own[:-1])
            assert abs(sum(r.doc_share for r in own) - (1 if n else 0)) < 1e-9


def test_documents(spark):
    texts = ["word " * (7 * i % 90 + 1) for i in range(120)] + ["hot text here"] * 80 + ["", None, "   ", "long " * 3000, "é" * 500]
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, container_id long").repartition(4)
    specs = spark.createDataFrame([(1, 64, 0), (2, 100, 1), (3, 1000, 2)], "pack_id int, capacity int, sep_tokens int")
    packed = P.pack_documents(docs, specs)
    _check(packed.collect(), docs, specs)
    report = {r.pack_id: r for r in P.pack_report(packed, specs).collect()}
    assert all(r.fill > 0.9 for r in report.values())
    assert P.pack_documents(docs.limit(0), specs).count() == 0
    odd = specs.where("pack_id = 1").withColumn("capacity", F.lit(None).cast("int"))
    assert P.pack_documents(docs, odd).count() == 0


def test_token_counts_are_those_of_the_library(spark):
    encoding = P._encoding(f"{P.TOKENIZERS}/{P.VOCABULARY}", P._split_pattern())
    texts = ["Hello <|endoftext|> world", "naïve café – 42 €", "a\n\n b"]
    rows = P.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(encoding.encode_ordinary(t)) for i, t in enumerate(texts)}


def test_no_silent_other_pattern(spark, monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(RuntimeError):
        P.token_counts(docs)
    assert P.token_counts(docs, pattern=r"\S+|\s+").first().n_tokens > 0
