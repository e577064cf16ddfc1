import os

import pytest
from pyspark.sql import functions as F

from annospark import runtime as R


def test_hash_sample(spark):
    df = spark.range(5000).repartition(7)
    got = [r.id for r in R.hash_sample(df, ["id"], 300).collect()]
    want = [r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(300).collect()]
    assert got == want and [r.id for r in R.hash_sample(df.repartition(2), ["id"], 300).collect()] == want
    assert R.hash_sample(df.limit(10), ["id"], 300).count() == 10 and R.hash_sample(df.limit(0), ["id"], 3).count() == 0


def test_skew_join_against_a_plain_join(spark):
    big = spark.range(900).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3), (None, 4), ("none", 5)], "k string, v int")
    got = sorted((r.row, r.k, r.v) for r in R.skew_join(big, small, "k", "row", 20).collect())
    want = sorted((r.row, r.k, r.v) for r in big.join(small, "k").collect())
    assert got == want and len(want) > 600
    assert R.skew_join(big.limit(0), small, "k", "row", 20).count() == 0


def test_stored_tables(spark):
    df = spark.createDataFrame([(1, "a", b"x"), (2, "b", None)], "n long, kind string, data binary")
    back = R.stored(df, "kind")
    assert sorted(map(tuple, back.select("n", "kind", "data").collect())) == [(1, "a", bytearray(b"x")), (2, "b", None)]
    assert R.stored(df.limit(0), "kind").count() == 0
    path = R._WRITTEN[0][1].removeprefix("file:")
    assert os.path.isdir(path)
    R.discard()
    assert not os.path.exists(path) and not R._WRITTEN


def test_no_local_folder_on_a_cluster(spark):
    class Context:
        master = "spark://elsewhere:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})()

        @staticmethod
        def getConf():  # noqa: N802
            return {}

    session = type("Session", (), {"sparkContext": Context, "conf": type("C", (), {"get": staticmethod(lambda k, d=None: d)})})
    with pytest.raises(RuntimeError):
        R.checkpoint_dir(session)
