"""Problem 2: the same picture in the train split and in an evaluation split.

Records are the rows of ``images`` and the samples with an image; their text is
the file name. Names of the same picture share a long part and differ in what
copying and exporting add, so shared spans are found with a suffix array:

1. A name is split into tokens of letters, of digits, and digests (percent
   escapes, accents, case, folders, zero padding and separators aside; so are
   sizes and the counters that file systems add). Every record is parsed once.
2. Affixes are learned: a word is one if names that hold it mostly occur without
   it too (``grv train 2021 102352`` and ``102352``), counted over all distinct
   texts, with a prior for the words of ``USUAL``. Words of a series, however
   frequent, never pass: ``terrace 168`` is not found as ``168``.
3. Suffix array over the partitioned, concatenated texts: the suffixes of all
   distinct texts, one at each token, are range partitioned and sorted by suffix
   and a salt, so that even equal suffixes may lie in several partitions. One pass
   over the sorted suffixes keeps a stack of the open common prefixes of
   neighbours; a prefix that suffixes of both sides have is a shared span.
   Prefixes open at the edge of a partition come out with the sides seen so far
   and are put together from their parts.
4. A text is a candidate where a shared span reaches over its whole core, that is
   what is left without affixes; coverage merges all shared spans of a text.
5. An exact check follows: the cores (series, number, frame, tile or digest) of
   two records must be equal.

The texts of a hot picture (copied into a third of all rows) are counted before
anything is joined; only ``overlaps`` writes pairs, with as many salts as the
picture's train records need. ``overlap_classes`` and the report make no pairs.

Defined results: records without a name, or with an unknown or null split, give
no pair; a repeated key counts once; equal ids in both tables do not occur; a
name that is nothing but affixes is its own core.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

EVALUATION = ("val", "test", "testa", "testb")
#: Train records of one picture that meet one copy of its evaluation records when pairs are written.
TRAIN_ROWS = 4096
#: Values of the salt that parts equal suffixes in the sort order.
SORT_SALTS = 64
#: A word is an affix if of the texts that hold it at least this share is found without it, after so many imagined texts have been added: (found, all) for any word and for ``USUAL`` ones.
AFFIX_SHARE, ANY_PRIOR, USUAL_PRIOR = 0.2, (0.0, 6.0), (6.0, 12.0)
#: A learned affix occurs in at least one of so many texts, which bounds how many there are.
RARE = 20_000

# Words that copies, exports and splits commonly add to a name, in any data; evidence may overrule them.
USUAL = frozenset(
    "train val test testa testb minival copy copie kopie kopia copia dup duplicate final new old edit edited resized resize scaled small large thumb thumbnail min crop cropped web hd orig original export img image pic photo v version".split()
)
# Endings of image files.
_ENDINGS = frozenset("jpg jpeg png tif tiff webp gif bmp min heic avif jfif".split())
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_HEX = re.compile(r"(?<![0-9a-z])(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{12,64}(?![0-9a-z])")
# What exporters and file systems append: densities, counters in brackets or after a tilde, sizes.
_MARKS = (re.compile(r"@\d+(?:\.\d+)?x"), re.compile(r"[(\[{][^)\]}]*[)\]}]"), re.compile(r"~\d+"), re.compile(r"(?<![^\W_])(?:\d{2,5}x\d{2,5}|w\d{2,5}|\d{2,5}w|h\d{2,5}|@?\d(?:\.\d)?x)(?![^\W_])"))


def base_name(name: str) -> str:
    """The file's own name: no escapes, query, folders, accents, case or file ending."""
    text = name
    for _ in range(2):
        text = unquote(text)
    text = re.split(r"[?#]", text, maxsplit=1)[0]
    text = re.split(r"[/\\]", text.rstrip("/\\"))[-1]
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c))
    text = text.casefold()
    while "." in text and text.rsplit(".", 1)[1] in _ENDINGS:
        text = text.rsplit(".", 1)[0]
    return text.strip()


def name_text(name: str | None) -> str | None:
    """Tokens of a name, parted by blanks; null where there are none. A mark is left out only if a digit stays elsewhere."""
    if not name or not name.strip():
        return None
    text = base_name(name)
    for mark in _MARKS:
        rest = mark.sub(" ", text)
        if any(c.isdigit() for c in rest):
            text = rest
    out, at = [], 0
    for digest in _HEX.finditer(text):
        out += _TOKEN.findall(text[at : digest.start()])
        out.append(digest.group())
        at = digest.end()
    out += _TOKEN.findall(text[at:])
    return " ".join((t.lstrip("0") or "0") if t.isdigit() else t for t in out) or None


def _is_digest(token: str) -> bool:
    return len(token) >= 12 and bool(_HEX.fullmatch(token))


def core_of(text: str, affixes: frozenset[str]) -> tuple[list[str], int, int]:
    """The text as the suffix array holds it, and place and length of its core there.

    Affixes go, with a year or a small number directly behind them (``train 2021``,
    ``copy 2``) as long as another number stays. Those between parts of the core
    leave the text, so that the core is one span; those around it stay. A digest
    is the core by itself.
    """
    tokens = text.split(" ")
    for i, t in enumerate(tokens):
        if _is_digest(t):
            return tokens, i, 1
    numbers = sum(t.isdigit() for t in tokens)
    kept = [t not in affixes for t in tokens]
    for i, t in enumerate(tokens[:-1]):
        after = tokens[i + 1]
        if not kept[i] and numbers > 1 and after.isdigit() and (len(after) <= 2 or len(after) == 4 and after[:2] in ("19", "20")):
            kept[i + 1] = False
            numbers -= 1
    if not any(kept):
        return tokens, 0, len(tokens)
    first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
    core = [t for t, k in zip(tokens, kept, strict=True) if k]
    return [*tokens[:first], *core, *tokens[last + 1 :]], first, len(core)


def core_text(text: str, affixes: frozenset[str]) -> str:
    """What names the picture."""
    tokens, at, n = core_of(text, affixes)
    return " ".join(tokens[at : at + n])


def records(images: DataFrame, samples: DataFrame) -> DataFrame:
    """``rec``, ``name``, ``split``, ``source`` of both tables; a key counts once."""
    a = images.select(F.col("image_id").cast("long").alias("rec"), F.col("file_name").alias("name"), "split", "source")
    b = samples.where("image is not null").select(F.col("sample_id").cast("long").alias("rec"), F.col("image.path").alias("name"), "split", "source")
    return a.unionByName(b).where("rec is not null and name is not null").dropDuplicates(["rec"])


def parsed_records(images: DataFrame, samples: DataFrame) -> DataFrame:
    """``rec``, ``train``, ``split``, ``source``, ``text`` of the records with a known split, parsed once and stored."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="name").assign(text=[name_text(n) for n in pdf["name"]])

    rows = records(images, samples).where((F.col("split") == "train") | F.col("split").isin(*EVALUATION)).withColumn("train", F.col("split") == "train").select("rec", "train", "split", "source", "name")
    return cut(rows.mapInPandas(parse, "rec long, train boolean, split string, source string, text string").where("text is not null"))


def learned_affixes(texts: DataFrame) -> frozenset[str]:
    """Affixes of the distinct ``text``s, see above; at most ``RARE`` times the tokens of a name."""

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                core, words = core_text(text, USUAL), set(text.split(" "))
                rows.append((core, None, False))
                rows += [(core, w, True) for w in words & USUAL]
                tokens = core.split(" ")
                if len(tokens) > 1:
                    rows += [(" ".join(x for x in tokens if x != w), w, False) for w in set(tokens) if w.isalpha() and w not in USUAL]
            yield pd.DataFrame(rows, columns=["core", "word", "usual"])

    rows = texts.select("text").mapInPandas(evidence, "core string, word string, usual boolean").groupBy("core", "word", "usual").agg(F.count(F.lit(1)).alias("m"))
    cores = rows.where("word is null").select("core", F.col("m").alias("n"))
    # a usual word has left the core, so its core must have a text without it as well
    found = rows.where("word is not null").join(cores, "core", "left").withColumn("ok", F.coalesce(F.col("n") > F.when(F.col("usual"), F.col("m")).otherwise(0), F.lit(False)))
    words = found.groupBy("word", "usual").agg(F.sum("m").alias("n"), F.sum(F.when(F.col("ok"), F.col("m")).otherwise(0)).alias("k"))
    total = texts.agg(F.count(F.lit(1))).scalar()
    prior = lambda i: F.when(F.col("usual"), USUAL_PRIOR[i]).otherwise(ANY_PRIOR[i])
    share = (F.col("k") + prior(0)) / (F.col("n") + prior(1))
    judged = words.where((F.col("n") * RARE >= total) | F.col("usual")).select("word", "usual", (share >= AFFIX_SHARE).alias("affix"))
    verdict = {r["word"]: r["affix"] for r in judged.where("affix or usual").toLocalIterator()}
    return frozenset(w for w, yes in verdict.items() if yes) | (USUAL - verdict.keys())


def suffixes(texts: DataFrame) -> DataFrame:
    """``suffix``, ``core`` (tokens of the core that begins there, else 0), ``train``, ``held``: every suffix that begins at a token."""
    n = F.size("tokens")
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.array_join(F.slice("tokens", i + 1, n), " ").alias("suffix"), F.when(i == F.col("core_at"), F.col("core_n")).otherwise(0).alias("core")))
    return texts.select("text", "train", "held", F.explode(rows).alias("s")).select("s.suffix", "s.core", "train", "held", F.pmod(F.xxhash64("text"), F.lit(SORT_SALTS)).cast("int").alias("salt"))


_SPANS = "span string, core boolean, train boolean, held boolean"


class _Open:
    """An open common prefix: its tokens, the sides seen, and the lengths of the cores that end within it."""

    __slots__ = ("depth", "train", "held", "cores", "edge")

    def __init__(self, depth: int, train: bool, held: bool, cores: set[int], edge: bool):
        self.depth, self.train, self.held, self.cores, self.edge = depth, train, held, cores, edge


def _scan(every: bool):
    """One pass over sorted suffixes; memory is the tokens of one suffix, whatever the length of a run.

    Comes out: the cores that lie within a prefix of both sides and, with ``every``, all
    such prefixes. Prefixes of the first and the last suffix of the partition come out
    in any case, with the sides seen.
    """

    def close(top: _Open, parent: _Open, tokens: list[str], out: list[tuple]) -> None:
        if top.edge:
            out += [(" ".join(tokens[:n]), n in top.cores, top.train, top.held) for n in range(parent.depth + 1, top.depth + 1)]
        elif top.train and top.held:
            out += [(" ".join(tokens[:n]), True, True, True) for n in top.cores if n > parent.depth]
            if every:
                out.append((" ".join(tokens[: top.depth]), False, True, True))
        parent.train, parent.held = parent.train or top.train, parent.held or top.held
        parent.cores |= {n for n in top.cores if n <= parent.depth}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[_Open] = []
        before: list[str] = []
        for pdf in batches:
            out: list[tuple] = []
            for suffix, core, train, held in zip(pdf["suffix"], pdf["core"], pdf["train"], pdf["held"], strict=True):
                tokens = suffix.split(" ")
                if not stack:
                    # every prefix of the first suffix may have begun in the partition before
                    stack = [_Open(d, False, False, set(), True) for d in range(len(tokens) + 1)]
                else:
                    common = 0
                    for a, b in zip(before, tokens, strict=False):
                        if a != b:
                            break
                        common += 1
                    while stack[-1].depth > common:
                        top = stack.pop()
                        if stack[-1].depth < common:
                            stack.append(_Open(common, False, False, set(), False))
                        close(top, stack[-1], before, out)
                    if stack[-1].depth < len(tokens):
                        stack.append(_Open(len(tokens), False, False, set(), False))
                top = stack[-1]
                top.train, top.held = top.train or train, top.held or held
                if core:
                    top.cores.add(core)
                before = tokens
            if out:
                yield pd.DataFrame(out, columns=["span", "core", "train", "held"])
        out = []
        while len(stack) > 1:
            top = stack.pop()
            top.edge = True
            close(top, stack[-1], before, out)
        yield pd.DataFrame(out, columns=["span", "core", "train", "held"])

    return run


def shared_spans(texts: DataFrame, every: bool = False, partitions: int | None = None) -> DataFrame:
    """``span``, ``core``: spans that texts of both sides have, from the suffix array; with ``every`` also those that are no core but hold a number."""
    n = partitions or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = suffixes(texts).repartitionByRange(n, "suffix", "salt").sortWithinPartitions("suffix", "salt")
    spans = ordered.mapInPandas(_scan(every), _SPANS).groupBy("span").agg(F.max("core").alias("core"), F.max("train").alias("train"), F.max("held").alias("held")).where("train and held")
    return spans.where(F.col("core") | F.col("span").rlike(r"\d") if every else F.col("core")).select("span", "core")


def cored_texts(parsed: DataFrame) -> DataFrame:
    """``text``, ``train``, ``held``, ``tokens``, ``core_at``, ``core_n``, ``core`` of the distinct texts, stored."""
    texts = parsed.groupBy("text").agg(F.max("train").alias("train"), F.max(~F.col("train")).alias("held"))
    affixes = learned_affixes(texts)

    def cored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, batches):
            parts = [core_of(t, affixes) for t in pdf["text"]]
            yield pdf.assign(tokens=[t for t, _, _ in parts], core_at=[a for _, a, _ in parts], core_n=[n for _, _, n in parts], core=[" ".join(t[a : a + n]) for t, a, n in parts])

    return cut(texts.mapInPandas(cored, "text string, train boolean, held boolean, tokens array<string>, core_at int, core_n int, core string"))


def overlap_classes(images: DataFrame, samples: DataFrame) -> DataFrame:
    """Records of the pictures that are on both sides, one row each: ``rec``, ``train``, ``split``, ``source``, ``text``, ``core`` (the class)."""
    parsed = parsed_records(images, samples)
    texts = cored_texts(parsed)
    shared = shared_spans(texts).select(F.col("span").alias("core"))
    found = texts.select("text", "core").join(shared, "core", "left_semi")
    members = parsed.join(found, "text")
    # the exact check: records of both sides with this very core
    both = members.groupBy("core").agg(F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_held")).where("n_train > 0 and n_held > 0")
    return members.join(both, "core").select("rec", "train", "split", "source", "text", "core", "n_train", "n_held")


def overlaps(images: DataFrame, samples: DataFrame) -> DataFrame:
    """Pairs ``rec_a`` < ``rec_b`` of a train and an evaluation record that show the same picture."""
    members = overlap_classes(images, samples)
    salts = F.ceil(F.col("n_train") / TRAIN_ROWS).cast("int")
    train = members.where("train").select("core", F.col("rec").alias("t_rec"), F.pmod(F.xxhash64("rec"), salts).cast("int").alias("salt"))
    held = members.where("not train").select("core", F.col("rec").alias("h_rec"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return train.join(held, ["core", "salt"]).select(F.least("t_rec", "h_rec").alias("rec_a"), F.greatest("t_rec", "h_rec").alias("rec_b"))


def overlap_report(members: DataFrame) -> DataFrame:
    """Pairs, evaluation records and pictures per split and source of the evaluation record, from the classes."""
    return members.where("not train").groupBy("split", "source").agg(F.sum("n_train").alias("n_pairs"), F.count(F.lit(1)).alias("n_records"), F.countDistinct("core").alias("n_pictures"))


def coverage(images: DataFrame, samples: DataFrame) -> DataFrame:
    """``rec``, ``class``, ``n_partners``, ``coverage`` of the records of the classes: the part of the name's tokens that lies in shared spans, merged."""
    members = cut(overlap_classes(images, samples))
    texts = cored_texts(parsed_records(images, samples))
    spans = shared_spans(texts, every=True).select("span").distinct()
    n = F.size("tokens")
    pieces = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.struct(i.alias("a"), j.alias("b"), F.array_join(F.slice("tokens", i + 1, j - i), " ").alias("span")))))
    mine = texts.join(members.select("text").distinct(), "text", "left_semi").select("text", n.alias("n"), F.explode(pieces).alias("p")).select("text", "n", "p.a", "p.b", "p.span").join(spans, "span")
    covered = mine.groupBy("text", "n").agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("a", F.col("b") - 1))))).alias("k")).select("text", F.round(F.col("k") / F.col("n"), 4).alias("coverage"))
    return members.join(covered, "text").select("rec", F.col("core").alias("class"), F.when(F.col("train"), F.col("n_held")).otherwise(F.col("n_train")).alias("n_partners"), "coverage")
