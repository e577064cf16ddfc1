from pyspark.sql import functions as F

from annospark.operators.conversation import session_windows
from annospark.streaming import dialogue as D

SCHEMA = "session string, pos long, value string, ok boolean, at timestamp"


def rows():
    return [(f"s{i % 5}", i // 5, None if i % 17 == 0 else "x" * (i * 7 % 40), i % 3 == 0) for i in range(100)]


def write(spark, path, n=4):
    df = spark.createDataFrame(rows(), "session string, pos long, value string, ok boolean").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("pos") * 120))
    for k in range(n):
        df.where(F.floor(F.col("pos") / 5) == k).coalesce(1).write.mode("append").parquet(path)
    return df


def drain(spark, stream, name, mode, checkpoint):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert not q.isActive and q.exception() is None
    return spark.table(name).collect()


def test_dialogue_state_equals_the_batch_fold(spark, tmp_path):
    df = write(spark, str(tmp_path / "in"))
    want = {(r.session, r.pos, r.used, r.resets) for r in session_windows(df, 60).collect()}
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 20).parquet(str(tmp_path / "in"))
    got = drain(spark, D.dialogue_state(stream, 60, None), "dialogue", "append", str(tmp_path / "c1"))
    assert {(r.session, r.pos, r.used, r.resets) for r in got} == want and len(got) == 100


def test_running_accuracy(spark, tmp_path):
    df = write(spark, str(tmp_path / "in"))
    want = {r.session: (r.n, r.n_correct) for r in D.running_accuracy(df, ["session"], F.col("ok")).collect()}
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    got = drain(spark, D.running_accuracy(stream, ["session"], F.col("ok")), "accuracy", "update", str(tmp_path / "c2"))
    last = {}
    for r in got:
        last[r.session] = max(last.get(r.session, (0, 0)), (r.n, r.n_correct))
    assert last == want


def test_windows(spark, tmp_path):
    df = write(spark, str(tmp_path / "in"))
    want = {(r.start, r.session): r.n for r in D.windowed_counts(df, "at", ["session"], "10 minutes").collect()}
    assert sum(want.values()) == 100
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    got = drain(spark, D.windowed_counts(stream, "at", ["session"], "10 minutes", late="5 hours"), "windows", "complete", str(tmp_path / "c3"))
    assert {(r.start, r.session): r.n for r in got} == want
    sliding = D.windowed_counts(df, "at", ["session"], "10 minutes", "5 minutes").agg(F.sum("n")).first()[0]
    assert sliding == 200
    assert D.session_counts(df, "at", ["session"], "3 minutes").count() == 5 and D.session_counts(df, "at", ["session"], "1 minute").count() == 100
