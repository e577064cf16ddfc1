"""Token ids, labels and padded batches.

The tokenizer is pluggable: ``hash_tokens`` is a built-in expression for tests and
pipelines without a model, ``library_tokens`` runs a tokenizer library over Arrow
batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..constants import IGNORE, IMAGE, IMAGE_TOKEN, PAD, PROMPT_TOKEN, REFERENCE, TOKEN_MASKS, VISUAL_PROMPT
from ..functions.geometry import let

# Begin and end ids by tokenizer family; a family without a begin id has none.
FAMILIES = {"llama": ([1], [2]), "qwen": ([], [151643]), "chatglm": ([64790, 64792], [2])}


def pieces(text: Column) -> Column:
    """Words and special tokens of a text."""
    spaced = F.regexp_replace(text, r"(<image>|\[VPT\]|</?[A-Za-z]+>)", " $1 ")
    return F.filter(F.split(spaced, r"\s+"), lambda x: x != "")


def hash_tokens(text: Column, size: int = 30000) -> Column:
    """Ids from a hash of each word; the image and prompt marks get their own."""
    one = lambda w: F.when(w == IMAGE, F.lit(IMAGE_TOKEN)).when(w == VISUAL_PROMPT, F.lit(PROMPT_TOKEN)).otherwise(F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int") % size + 1000)
    return F.transform(pieces(text), one)


def library_tokens(encode: Callable[[list[str]], list[list[int]]]) -> Callable[[Column], Column]:
    """A tokenizer library as a vectorised function; the special marks are cut out before it sees the text."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            ids: list[int] = []
            for a, chunk in enumerate((t or "").split(IMAGE)):
                if a:
                    ids.append(IMAGE_TOKEN)
                for b, part in enumerate(chunk.split(VISUAL_PROMPT)):
                    if b:
                        ids.append(PROMPT_TOKEN)
                    ids += encode([part])[0] if part else []
            out.append(ids)
        return pd.Series(out)

    return run


def encoded(rounds: Column, tokens: Callable[[Column], Column] = hash_tokens, family: str = "llama", max_length: int = 2048) -> Column:
    """``struct<ids, labels>`` of a conversation (B2): questions and separators are not learned, answers and end marks are."""
    bos, eos = (F.array(*[F.lit(x) for x in ids]) if ids else F.array().cast("array<int>") for ids in FAMILIES[family])
    ignored = lambda a: F.transform(a, lambda _: F.lit(IGNORE))

    def one(r: Column, i: Column, all_rounds: Column) -> Column:
        # a begin mark goes where the round before ended with an end mark
        opened = F.when(i == 0, F.lit(True)).otherwise(F.coalesce(F.get(all_rounds, i - 1)["need_eos"], F.lit(True)))
        head = F.concat(F.when(opened, bos).otherwise(F.array().cast("array<int>")), tokens(F.coalesce(r["input"], F.lit(""))))
        body = F.concat(tokens(F.coalesce(r["output"], F.lit(""))), F.when(F.coalesce(r["need_eos"], F.lit(True)), eos).otherwise(F.array().cast("array<int>")))
        sep = tokens(F.coalesce(r["sep"], F.lit("")))
        return F.struct(F.concat(head, body, sep).alias("ids"), F.concat(ignored(head), body, ignored(sep)).alias("labels"))

    parts = let(rounds, lambda rs: F.transform(rs, lambda r, i: one(r, i, rs)))
    whole = lambda field: F.slice(F.flatten(F.transform(parts, lambda p: p[field])), 1, max_length)
    return F.struct(whole("ids").alias("ids"), whole("labels").alias("labels"))


def token_kinds(ids: Column, special: dict[str, int]) -> Column:
    """Mark of each token's kind (B5): reference, unit and phrase borders; 0 for others. ``special``: kind to id."""
    return F.transform(ids, lambda x: F.coalesce(*[F.when(x == i, F.lit(TOKEN_MASKS[k])) for k, i in special.items()], F.lit(0)))


def with_features(ids: Column, labels: Column, image_length: int, prompt_length: int = 1) -> Column:
    """Sequence after image and prompt features are put in (B6): ``struct<ids, labels, kinds>``; features stay outside."""
    length = lambda x: F.when(x == IMAGE_TOKEN, F.lit(image_length)).when(x == PROMPT_TOKEN, F.lit(prompt_length)).otherwise(F.lit(1))
    feature = lambda x: x.isin(IMAGE_TOKEN, PROMPT_TOKEN)
    return F.struct(
        F.flatten(F.transform(ids, lambda x: F.array_repeat(x, length(x)))).alias("ids"),
        F.flatten(F.zip_with(ids, labels, lambda x, y: F.array_repeat(F.when(feature(x), F.lit(IGNORE)).otherwise(y), length(x)))).alias("labels"),
        F.flatten(F.transform(ids, lambda x: F.array_repeat(F.when(x == IMAGE_TOKEN, F.lit(TOKEN_MASKS["vis"])).when(x == PROMPT_TOKEN, F.lit(TOKEN_MASKS["vpt"])).otherwise(F.lit(0)), length(x)))).alias("kinds"),
    )


def supervised(labels: Column) -> Column:
    """Labels without ignored ones."""
    return F.filter(labels, lambda x: x != IGNORE)


def prompt_ids(ids: Column, labels: Column) -> Column:
    """Ids before the first learned label (B11); all of them without one."""
    at = F.array_position(F.transform(labels, lambda x: x != IGNORE), True)
    return F.when(at > 0, F.slice(ids, 1, (at - 1).cast("int"))).otherwise(ids)


def non_negative(ids: Column) -> Column:
    """Generated ids with marks below zero as padding."""
    return F.transform(ids, lambda x: F.when(x < 0, F.lit(PAD)).otherwise(x))


def padded_batches(df: DataFrame, key: str, size: int, ids: str = "ids", labels: str = "labels", seed: int = 42) -> DataFrame:
    """Rows in shuffled batches of ``size``, padded to the longest of each (B3): ids with 0, labels with -100, attention mask, positions.

    The order is that of the key's hash; rows are numbered in ranges of it, so no
    task sorts them all.
    """
    from .corpora import hash_rank

    ranked = hash_rank(df, key, seed, name="__pos").withColumn("batch_id", F.floor(F.col("__pos") / size))
    longest = F.max(F.size(ids)).over(Window.partitionBy("batch_id"))
    wide = ranked.withColumn("__n", F.size(ids)).withColumn("__m", longest)
    fill = F.col("__m") - F.col("__n")
    return wide.withColumn("attention", F.concat(F.array_repeat(F.lit(1), F.col("__n")), F.array_repeat(F.lit(0), fill))).withColumn("positions", F.when(F.col("__m") > 0, F.sequence(F.lit(0), F.col("__m") - 1)).otherwise(F.array().cast("array<int>"))).withColumn(ids, F.concat(ids, F.array_repeat(F.lit(PAD), fill))).withColumn(labels, F.concat(labels, F.array_repeat(F.lit(IGNORE), fill))).drop("__n", "__m", "__pos")


def trimmed_groups(sizes: Column, left: Column) -> Column:
    """Sizes of reference groups when only ``left`` references survive, cut from the tail."""
    before = lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda s, x: s + x)
    return F.filter(F.transform(sizes, lambda n, i: F.greatest(F.lit(0), F.least(n, left - before(i)))), lambda n: n > 0)


def trimmed(labels: Column, left: Column) -> Column:
    """Labels of the surviving references."""
    return F.slice(labels, 1, F.greatest(left.cast("int"), F.lit(0)))


def fixed_length(values: Column, n: int, filler: Column) -> Column:
    """Exactly ``n`` entries."""
    return F.concat(F.slice(values, 1, n), F.array_repeat(filler, F.greatest(F.lit(0), F.lit(n) - F.size(values))))


def reference_groups(text: Column) -> Column:
    """References grouped with the unit and phrase before them (D1): ``array<struct<phrase, unit, n>>``.

    Phrases, units and references are read in order. A group is a run of
    references; it belongs to the unit right before it and to the phrase before
    that unit, or to the phrase right before it. What is missing is null.
    """
    pattern = r"(?s)<Phrase>.*?</Phrase>|<Unit>.*?</Unit>|" + REFERENCE
    events = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "struct<groups:array<struct<phrase:string,unit:string,n:int>>,phrase:string,unit:string,last:string>"
    start = F.struct(F.array().cast("array<struct<phrase:string,unit:string,n:int>>").alias("groups"), F.lit(None).cast("string").alias("phrase"), F.lit(None).cast("string").alias("unit"), F.lit("").alias("last")).cast(kind)

    def step(s: Column, e: Column) -> Column:
        is_ref, is_unit = e == REFERENCE, F.startswith(e, F.lit("<Unit>"))
        inner = F.regexp_extract(e, r"(?s)^<(?:Phrase|Unit)>(.*)</(?:Phrase|Unit)>$", 1)
        again = is_ref & (s["last"] == "ref")
        grown = F.transform(s["groups"], lambda g, i: F.when(i == F.size(s["groups"]) - 1, F.struct(g["phrase"].alias("phrase"), g["unit"].alias("unit"), (g["n"] + 1).alias("n"))).otherwise(g))
        fresh = F.concat(s["groups"], F.array(F.struct(s["phrase"].alias("phrase"), s["unit"].alias("unit"), F.lit(1).alias("n"))))
        none = F.lit(None).cast("string")
        return F.struct(
            F.when(again, grown).when(is_ref, fresh).otherwise(s["groups"]).alias("groups"),
            F.when(is_ref, none).when(is_unit, F.when(s["last"] == "phrase", s["phrase"]).otherwise(none)).otherwise(inner).alias("phrase"),
            F.when(is_ref, none).when(is_unit, inner).otherwise(none).alias("unit"),
            F.when(is_ref, F.lit("ref")).when(is_unit, F.lit("unit")).otherwise(F.lit("phrase")).alias("last"),
        ).cast(kind)

    return F.aggregate(events, start, step, lambda s: s["groups"])
