"""Session-level helpers shared by all operators.

Nothing here collects data whose size follows the input; helpers return lazy
DataFrames unless their name says otherwise.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Number of buckets a hot key is spread over before rows of it are numbered.
SALTS = 64


def build_session(app: str = "annospark", cores: str | int = "*", shuffle: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of a data directory, optionally only some columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, or the one set on the context.

    Only where there is neither, and the master is local, a local folder is set; on a
    cluster that is an error, since executors share no machine's folder.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not known.isEmpty():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all machines share")
        named = os.path.join(tempfile.gettempdir(), "annospark-checkpoints")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in ``checkpoint_dir``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Cut the lineage with a table in ``checkpoint_dir``, compressed and by column; for wide or sparse rows that are read in parts.

    It is removed by ``discard`` or when the program ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    if not _WRITTEN:
        atexit.register(discard)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard() -> None:
    """Remove the tables written by ``stored``; results not yet computed from them are lost."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended: the folder's owner clears it
            continue


def skew_join(big: DataFrame, small: DataFrame, key: str, spread: str, limit: int) -> DataFrame:
    """Inner join on ``key`` where one key may hold a large part of ``big``.

    Keys with more than ``limit`` rows are split over as many salts as they have
    multiples of it, by the hash of ``spread``; rows of ``small`` are copied once per
    salt of their key. A key is hot only if it also holds more than 1/20,000 of all
    rows, so at most that many are, and they are broadcast.
    """
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = big.agg(F.count(F.lit(1))).scalar()
    hot = F.broadcast(counts.where((F.col("__n") > limit) & (F.col("__n") * 20_000 > total)).select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__k")))
    salts = F.coalesce(F.col("__k"), F.lit(1))
    left = big.join(hot, key, "left").withColumn("__s", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("__k")
    right = small.join(hot, key, "left").withColumn("__s", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__k")
    return left.join(right, [key, "__s"]).drop("__s")


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", salts: int = SALTS) -> DataFrame:
    """Number the rows of each group from 0, without ever sorting a whole group in one task.

    Rows are spread over ``salts`` buckets by a hash of ``order``; each bucket is
    numbered on its own and shifted by the sizes of the buckets before it. The
    counts hold at most ``salts`` rows per group. The numbering is a function of
    the rows alone when ``order`` is unique within a group; rows that tie on all
    of it take the numbers in any order. Null keys form a group of their own.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__salt").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    within = Window.partitionBy(*keys, "__salt").orderBy(*order)
    numbered = salted.withColumn("__rn", F.row_number().over(within) - 1)
    on = F.col("__salt") == F.col("__s")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return numbered.join(offsets, on, "inner").withColumn(name, (F.col("__rn") + F.col("__off")).cast("long")).drop("__salt", "__rn", "__s", "__off", *[f"__k_{k}" for k in keys])


def hash_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest hash of ``keys``, ties by them.

    Rows are counted first and thinned by a threshold on the hash to somewhat more
    than ``n``, so that only about that many, not ``n`` of every partition, meet.
    """
    total = df.count()
    h = F.xxhash64(*keys)
    if total > n:
        share = min(1.0, (n + 5 * n**0.5 + 10) / total)
        df = df.where(h < F.lit(int(-(1 << 63) + share * ((1 << 64) - 1))))
    return df.orderBy(h, *keys).limit(n)


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per context.

    Needed where the driver imports it from a folder the executors do not have
    on their path; Spark serves the archive to them.
    """
    context = spark.sparkContext
    if getattr(context, "_annospark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="annospark-")) / "annospark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(str(archive))
    context._annospark_shipped = True
