"""Draws by probability end where a corpus is exhausted."""

import hashlib
import os

import pytest

from annospark.operators import corpora as K
from annospark.plans import corpus as P
from annospark.plans import fixtures as X

DATA = os.environ.get("ANNOSPARK_TESTDATA", "/root/testdata/sf0.001")


def drawn(lengths, probabilities, everyone, seed=42):
    """The reference's loop over the hash's draws: corpus and position of each turn."""
    names, out, at, done = sorted(probabilities), [], dict.fromkeys(lengths, 0), set()
    while not (done >= set(lengths) if everyone else done):
        u, e = int(hashlib.md5(f"{seed}:{len(out)}".encode()).hexdigest()[:12], 16) / 16**12, 0.0
        for c in names:
            e += probabilities[c]
            if u < e or c == names[-1]:
                break
        out.append((len(out), c, at[c]))
        at[c] += 1
        if at[c] >= lengths[c]:
            at[c] = 0
            done.add(c)
    return out


@pytest.mark.parametrize("everyone", [False, True])
@pytest.mark.parametrize("lengths", [{"a": 30, "b": 400, "c": 50}, {"a": 1, "b": 2, "c": 3000}])
def test_stop_rules(spark, lengths, everyone):
    p = {"a": 0.5, "b": 0.3, "c": 0.2}
    df = spark.createDataFrame([(c, k) for c, n in lengths.items() for k in range(n)], "c string, p long")
    got = [tuple(r) for r in K.interleaved_by_probability(df, "c", "p", p, all_exhausted=everyone).select("turn", "c", "p").orderBy("turn").collect()]
    assert got == drawn(lengths, p, everyone)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_ends_with_the_first_split(spark):
    n = {r["split"]: r["count"] for r in X.images(spark, DATA).where("split is not null").groupBy("split").count().collect()}
    assert set(n) == set(P.MIXTURE)
    got = [(r.turn, r.split) for r in P.interleave_probability(spark, DATA).orderBy("turn").collect()]
    assert got == [(t, c) for t, c, _ in drawn(n, P.MIXTURE, False)]
