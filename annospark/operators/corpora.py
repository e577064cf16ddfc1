"""Subsets, concatenation and interleaving of corpora.

The order of a shuffle is that of ``md5(seed:key)``, ties by key: the same on any
cluster, however the data lie. No row numbers need one task: ranks are counted in
salted buckets of the key's hash, or, where rows go in hash order, in ranges of
the hash's first digits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(key: Column | str, seed: int = 42) -> Column:
    """The hash that orders a shuffle."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_rank(df: DataFrame, key: str, seed: int = 42, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Place of each row (from 0) in the order of its hash, within ``by``.

    Rows are numbered within ranges of the hash's first three digits; the sizes of
    the ranges before are added. Each range holds 1/4096 of a group.
    """
    by = by or []
    keyed = df.withColumn("__h", shuffle_key(key, seed)).withColumn("__b", F.substring("__h", 1, 3))
    sizes = keyed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by, F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__b").alias("__o"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    within = Window.partitionBy(*by, "__b").orderBy("__h", key)
    on = F.col("__b") == F.col("__o")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    numbered = keyed.withColumn("__rn", F.row_number().over(within) - 1).join(offset, on)
    return numbered.withColumn(name, (F.col("__rn") + F.col("__off")).cast("long")).drop("__h", "__b", "__rn", "__o", "__off", *[f"__k_{c}" for c in by])


def subset(df: DataFrame, key: str, portion: float, seed: int = 42) -> DataFrame:
    """The first ``int(n * portion)`` rows in hash order (L1); 0 < portion <= 1."""
    if not 0 < portion <= 1:
        raise ValueError("portion must be in (0, 1]")
    total = df.agg(F.count(F.lit(1))).scalar()
    return hash_rank(df, key, seed).where(F.col("rank") < F.floor(total * portion)).drop("rank")


def concatenated(corpora: dict[str, DataFrame]) -> DataFrame:
    """One table of several, with their names in ``corpus``; missing columns are null."""
    out = None
    for name, df in corpora.items():
        one = df.withColumn("corpus", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no corpora")
    return out


def shuffled_portion(df: DataFrame, key: str, portion: float, seed: int = 42) -> DataFrame:
    """Shuffled rows, repeated for a portion above 1 (U2): copies ``0..ceil(portion)-1``, the first ``int(n * portion)`` in hash order."""
    copies = int(np.ceil(portion))
    if copies < 1:
        raise ValueError("portion must be positive")
    many = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("__key", F.concat_ws("#", F.col(key).cast("string"), F.col("copy").cast("string")))
    total = df.agg(F.count(F.lit(1))).scalar()
    return hash_rank(many, "__key", seed).where(F.col("rank") < F.floor(total * portion)).drop("__key")


def interleaved(df: DataFrame, corpus: str, pos: str, all_exhausted: bool = False) -> DataFrame:
    """Round robin over corpora (U3, U4): ``turn``, place ``out_pos`` in the result.

    ``pos`` counts from 0 in each corpus. Ends with the shortest corpus, or with
    the longest while shorter ones begin again.
    """
    lengths = df.groupBy(corpus).agg((F.max(pos) + 1).alias("__n"))
    # the number of corpora is that of the configuration; their lengths are one small row
    names = lengths.agg(F.sort_array(F.collect_list(F.struct(F.col(corpus).alias("c"), F.col("__n").alias("n")))).alias("__all"))
    wide = df.withColumn("__all", names.scalar()).withColumn("__k", F.size("__all")).withColumn("__i", F.array_position(F.transform("__all", lambda x: x["c"]), F.col(corpus)) - 1)
    if not all_exhausted:
        shortest = F.array_min(F.transform("__all", lambda x: x["n"]))
        return wide.where(F.col(pos) < shortest).withColumn("turn", F.col(pos).cast("long")).withColumn("out_pos", F.col("turn") * F.col("__k") + F.col("__i")).drop("__all", "__k", "__i")
    longest = F.array_max(F.transform("__all", lambda x: x["n"]))
    own = F.get(F.transform("__all", lambda x: x["n"]), F.col("__i").cast("int"))
    turns = F.sequence(F.col(pos).cast("long"), F.greatest(longest - 1, F.col(pos)).cast("long"), own.cast("long"))
    return wide.withColumn("turn", F.explode(F.filter(turns, lambda t: t < longest))).withColumn("out_pos", F.col("turn") * F.col("__k") + F.col("__i")).drop("__all", "__k", "__i")


def interleaved_by_probability(df: DataFrame, corpus: str, pos: str, probabilities: dict[str, float], turns: int | None = None, seed: int = 42, all_exhausted: bool = False) -> DataFrame:
    """Draws of a corpus by probability (U3): each draw takes that corpus's next row, beginning again at its end.

    Ends with the draw that exhausts the first corpus, or with ``all_exhausted`` the last one; a number of
    ``turns`` ends it there instead. The draw of turn ``t`` is a hash of ``seed`` and ``t``, so turns are made
    by the workers; how often a corpus was drawn before is counted in ranges of turns.
    """
    spark = df.sparkSession
    names = sorted(n for n, p in probabilities.items() if p > 0)
    total = sum(probabilities[n] for n in names)
    edges = np.cumsum([probabilities[n] / total for n in names]).tolist()
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("turn").cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)
    pick = F.lit(names[-1])
    for n, e in reversed(list(zip(names, edges, strict=True))[:-1]):
        pick = F.when(u < e, F.lit(n)).otherwise(pick)

    def draws(n: int) -> DataFrame:
        return spark.range(n).withColumnRenamed("id", "turn").withColumn("__c", pick).withColumn("__b", F.floor(F.col("turn") / 65536))

    def counted(drawn: DataFrame) -> DataFrame:
        sizes = drawn.groupBy("__c", "__b").agg(F.count(F.lit(1)).alias("__m"))
        before = Window.partitionBy("__c").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        offset = sizes.select(F.col("__c").alias("__c2"), F.col("__b").alias("__b2"), F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__off"))
        return drawn.withColumn("__rn", F.row_number().over(Window.partitionBy("__c", "__b").orderBy("turn")) - 1).join(offset, (F.col("__c") == F.col("__c2")) & (F.col("__b") == F.col("__b2")))

    lengths = df.groupBy(F.col(corpus).alias("__c3")).agg((F.max(pos) + 1).alias("__n"))
    if turns is None:
        if all_exhausted and len(names) < len(probabilities):
            raise ValueError("a corpus without probability is never exhausted")
        # one row per corpus of the configuration
        wanted = {r["__c3"]: r["__n"] for r in lengths.where(F.col("__c3").isin(names)).collect()}
        until = max if all_exhausted else min
        turns = int(until((n / probabilities[c] * total for c, n in wanted.items()), default=0) * 1.05) + (1_000 if wanted else 0)
        while wanted:
            made = {r["__c"]: r["count"] for r in draws(turns).groupBy("__c").count().collect()}
            if (all if all_exhausted else any)(made.get(c, 0) >= n for c, n in wanted.items()):
                break
            turns *= 2
        if wanted:
            last = F.coalesce(*[F.when(F.col("__c") == c, F.lit(n - 1)) for c, n in wanted.items()])
            ends = counted(draws(turns)).where(F.col("__rn") + F.col("__off") == last)
            turns = ends.agg((F.max if all_exhausted else F.min)("turn")).first()[0] + 1
    at = counted(draws(turns)).join(lengths, F.col("__c") == F.col("__c3")).select("turn", "__c", F.pmod(F.col("__rn") + F.col("__off"), F.col("__n")).alias("__p"))
    return df.join(at, (F.col(corpus) == F.col("__c")) & (F.col(pos) == F.col("__p"))).drop("__c", "__p")


def chosen(key: Column, n: int | Column, seed: int = 42) -> Column:
    """One of ``n`` by a hash of the key (L5, P1): a number from 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(F.substring(shuffle_key(key, seed), 1, 8), 16, 10).cast("long"), n)


def coin(key: Column, p: float, seed: int = 42) -> Column:
    """True for a share ``p`` of keys."""
    return chosen(key, 10_000, seed) < int(p * 10_000)


def sampled_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each group in hash order.

    Hash ranges are thinned first, so a hot group is no single sort.
    """
    first = Window.partitionBy(group, F.substring(shuffle_key(key, seed), 1, 2)).orderBy(shuffle_key(key, seed), key)
    thin = df.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= n)
    return thin.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(shuffle_key(key, seed), key))).where(F.col("__r") <= n).drop("__r")


def top_per_group(df: DataFrame, group: str, value: Column, key: str, n: int, name: str = "rank") -> DataFrame:
    """The ``n`` rows of each group with the largest value (L3, L4, L12), ties by key; thinned per bucket before the last sort."""
    bucket = F.pmod(F.xxhash64(key), F.lit(32))
    thin = df.withColumn("__v", value).withColumn("__r", F.row_number().over(Window.partitionBy(group, bucket).orderBy(F.col("__v").desc(), key))).where(F.col("__r") <= n)
    return thin.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(F.col("__v").desc(), key))).where(F.col(name) <= n).drop("__v", "__r")


def shuffled_rounds(rounds: Column, key: Column, length: int, seed: int = 42) -> Column:
    """Rounds in hash order, a hash-chosen number of 1 to ``length`` kept (L7); works on any array, so rounds and system entries zipped stay aligned."""
    keyed = F.transform(rounds, lambda r, i: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"), i.cast("string"))).alias("h"), r.alias("r")))
    n = (F.pmod(F.conv(F.substring(shuffle_key(key, seed + 1), 1, 8), 16, 10).cast("long"), F.lit(length)) + 1).cast("int")
    return F.slice(F.transform(F.array_sort(keyed, lambda a, b: F.when(a["h"] < b["h"], F.lit(-1)).when(a["h"] > b["h"], F.lit(1)).otherwise(F.lit(0))), lambda x: x["r"]), 1, n)
