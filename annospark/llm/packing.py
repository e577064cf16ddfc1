"""Problem 5: documents into containers of fixed capacity.

Documents are measured in tokens of a public tokenizer. A document longer than
a container is cut into full containers and a rest; nothing else is split.

Planning sees only the histogram of the pieces' lengths, whose size is bounded
by the capacity and not by the corpus. What is collected is the histogram of the
documents' lengths in tokens, one row per distinct length, so at most as many rows
as the longest document has tokens:

1. Pattern packing: patterns of a few documents that (nearly) fill a block are
   enumerated over length bins, and non-negative least squares finds how often
   each must be used to use up the histogram. A block is the container, or an
   even part of it where containers hold many documents.
2. The repeat counts are rounded down; each pattern then takes real lengths from
   its bins in runs, so the room left over is known exactly.
3. The residual lengths are packed best fit, longest first, in bulk: into the
   room left over, then into new containers.

The plan says, for every exact length, which slots its documents take. Documents
of one length are numbered (in salted buckets, so a length shared by a third of
the corpus is no single task) and look up their slot by binary search.

Defined results: a null, empty or token-less document comes out once with null
container and place; repeated ids are separate items; an empty table gives no
rows; specs with a null or non-positive capacity give none.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, salted_rank

#: Folder of the tokenizer files, and the file used.
TOKENIZERS = os.environ.get("ANNOSPARK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Length bins of a block, documents in a pattern, part of a block a pattern may leave unused.
BINS, DEPTH, SLACK = 96, 4, 0.03
#: Part of the tokens, in the shortest pieces, that patterns leave for the room they cannot fill.
RESERVE = 0.06
#: A block holds about so many documents of mean length at most.
BLOCK_DOCS = 5


def _split_pattern() -> str:
    """The pattern that belongs to the vocabulary; without it counts would differ, so its absence is an error."""
    try:
        from public_tokenizers import PATTERN
    except ImportError as e:
        raise RuntimeError("give the tokenizer's split pattern: the package that holds it is not installed") from e
    return PATTERN


_encodings: dict = {}


def _encoding(path: str, pattern: str):
    import tiktoken

    if (path, pattern) not in _encodings:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path, pattern] = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every document, whole texts; null counts as empty.

    The vocabulary is read where the driver runs and sent to the workers, and the
    split pattern is settled there, so that all machines count alike.
    """
    split = pattern if pattern is not None else _split_pattern()
    docs.sparkSession.sparkContext.addFile(os.path.join(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(SparkFiles.get(name), split).encode_ordinary
        for batch in batches:
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ b
    tolerance = 1e-9 * max(1.0, np.abs(gradient).max(initial=0.0))
    for _ in range(rounds):
        free = np.where(passive, -np.inf, gradient)
        if not n or free.max() <= tolerance:
            break
        passive[int(free.argmax())] = True
        while True:
            at = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 1e-12
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - z[bad], 1e-300))
            x[at] += step * (z - x[at])
            passive[at[x[at] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                break
        gradient = a.T @ (b - a @ x)
    return x


def patterns(sizes: list[int], capacity: int, slack: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Multisets of at most ``depth`` bins whose sizes fill the capacity but for ``slack``."""
    out: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], start: int, room: int) -> None:
        if chosen and room <= slack:
            out.append(chosen)
        left = depth - len(chosen)
        if not left:
            return
        for k in range(start, len(sizes)):
            if sizes[k] > room:
                continue
            if sizes[k] * left < room - slack:
                break  # sizes fall; even the largest allowed from here cannot fill the room
            extend((*chosen, k), k, room - sizes[k])

    extend((), 0, capacity)
    return out


class _Plan:
    """Containers in bulk: classes of containers with the same lengths, and how many there are."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.classes: list[list] = []  # [lengths, number, room]
        self.rooms: list[tuple[int, int]] = []  # (room, class), sorted

    def add(self, lengths: list[int], number: int) -> int:
        room = self.capacity - sum(lengths)
        self.classes.append([lengths, number, room])
        if room > 0:
            insort(self.rooms, (room, len(self.classes) - 1))
        return len(self.classes) - 1

    def put(self, length: int, number: int) -> None:
        """Best fit: the fullest containers that still have room; new ones when there are none."""
        while number:
            at = bisect_left(self.rooms, (length, -1))
            if at == len(self.rooms):
                each = self.capacity // length
                whole, rest = divmod(number, each)
                if whole:
                    self.add([length] * each, whole)
                if rest:
                    self.add([length] * rest, 1)
                return
            room, k = self.rooms.pop(at)
            lengths, have, _ = self.classes[k]
            each = min(room // length, max(1, number // have))
            take = min(have, number // each)
            if take < have:
                self.classes[k][1] = have - take
                insort(self.rooms, (room, k))
                self.add([*lengths, *[length] * each], take)
            else:
                self.classes[k] = [[*lengths, *[length] * each], have, room - each * length]
                if room - each * length > 0:
                    insort(self.rooms, (room - each * length, k))
            number -= take * each


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Containers for a histogram of lengths (each at most the capacity): lists of lengths and their numbers."""
    left = {n: c for n, c in histogram.items() if 0 < n < capacity and c > 0}
    out = _Plan(capacity)
    if histogram.get(capacity):
        out.add([capacity], histogram[capacity])
    if not left:
        return [(c[0], c[1]) for c in out.classes]
    mean = sum(n * c for n, c in left.items()) / sum(left.values())
    parts = 1
    while capacity // (parts * 2) >= BLOCK_DOCS * mean / 2 and capacity // parts > BLOCK_DOCS * mean:
        parts *= 2
    block = capacity // parts
    kept = _reserve(left)
    usable = lambda top: {n: c - kept.get(n, 0) for n, c in left.items() if n <= top and c > kept.get(n, 0)}
    if parts > 1:
        # documents longer than a block first, while short ones are there to go with them
        long = [(x, c) for x, c in _blocks(usable(capacity), capacity, longer=block)]
        for lengths, number in long:
            out.add(lengths, number)
            for n in lengths:
                left[n] -= number
    loose: list[list[int]] = []
    for lengths, number in _blocks(usable(block), block):
        whole, rest = divmod(number, parts)
        if whole:
            out.add(lengths * parts, whole)
        loose += [lengths] * rest
        for n in lengths:
            left[n] -= number
    for k in range(0, len(loose), parts):
        some = [n for lengths in loose[k : k + parts] for n in lengths]
        if len(loose) - k >= parts:
            out.add(some, 1)
        else:
            for n in some:
                left[n] += 1
    for n in sorted(left, reverse=True):
        if left[n]:
            out.put(n, left[n])
    return [(c[0], c[1]) for c in out.classes]


def _reserve(histogram: dict[int, int]) -> dict[int, int]:
    """The shortest pieces, kept back to fill the room that patterns leave."""
    room, out = RESERVE * sum(n * c for n, c in histogram.items()), {}
    for n in sorted(histogram):
        out[n] = min(histogram[n], int(room // n))
        room -= n * out[n]
        if out[n] < histogram[n]:
            break
    return out


def _blocks(histogram: dict[int, int], capacity: int, longer: int = 0) -> list[tuple[list[int], int]]:
    """Full blocks by pattern packing, each with a piece longer than ``longer``; uses at most what the histogram holds."""
    if not histogram:
        return []
    lengths = sorted(histogram, reverse=True)
    width = max(1, -(-capacity // BINS))
    bins: dict[int, list[int]] = {}
    for n in lengths:
        bins.setdefault(-(-n // width), []).append(n)
    order = sorted(bins, reverse=True)
    sizes = [min(b * width, capacity) for b in order]
    chosen = [p for p in patterns(sizes, capacity, max(int(SLACK * capacity), width)) if sizes[p[0]] > longer]
    if not chosen:
        return []
    a = np.zeros((len(order), len(chosen)))
    for j, p in enumerate(chosen):
        for k in p:
            a[k, j] += 1
    b = np.array([sum(histogram[n] for n in bins[k]) for k in order], float)
    x = np.floor(nnls(a, b) + 1e-6).astype(np.int64)
    stock = {k: [[n, histogram[n]] for n in bins[order[k]]] for k in range(len(order))}
    have = b.astype(np.int64).copy()
    out = []
    for j in np.argsort(-x, kind="stable"):
        need = a[:, j].astype(np.int64)
        number = int(min([x[j], *(have[k] // need[k] for k in np.flatnonzero(need))]))
        if number <= 0:
            continue
        have -= need * number
        while number:
            taken, run = [], number
            for k in chosen[j]:
                n, c = stock[k][0]
                taken.append((k, n))
            for k, _ in taken:
                same = sum(1 for q, _ in taken if q == k)
                run = min(run, max(1, stock[k][0][1] // same))
            lengths_now = []
            for k in chosen[j]:
                n, c = stock[k][0]
                take = min(run, c)
                if take < run:
                    run = take
                lengths_now.append(n)
                stock[k][0][1] -= run
                if not stock[k][0][1]:
                    stock[k].pop(0)
            out.append((lengths_now, run))
            number -= run
    return out


PACKED = "pack_id int, doc_id long, piece int, container_id long, place int, token_offset long, n_tokens long, doc_share double, container_share double"


def pack_documents(docs: DataFrame, specs: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """Every document's containers under every spec.

    ``docs``: ``doc_id``, ``text``; ``specs``: ``pack_id``, ``capacity``,
    ``sep_tokens`` (spent between two items of a container). One row per piece:
    ``piece`` counts a document's pieces from 0, ``place`` the items of a
    container from 0, ``token_offset`` is where the piece begins in the container,
    ``doc_share`` its part of the document, ``container_share`` of the capacity.
    """
    counts = cut(token_counts(docs, folder, name, pattern))
    histogram = {r["n_tokens"]: r["c"] for r in counts.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).toLocalIterator()}
    rows = [r for r in specs.select("pack_id", "capacity", F.coalesce("sep_tokens", F.lit(0)).alias("sep")).where("pack_id is not null and capacity > 0").dropDuplicates(["pack_id"]).toLocalIterator()]
    spark = docs.sparkSession
    out = None
    ranked = salted_rank(counts.where("n_tokens > 0"), ["n_tokens"], [F.col("doc_id")])
    ranked = cut(ranked.select("doc_id", "n_tokens", "rank"))
    for r in sorted(rows, key=lambda r: r["pack_id"]):
        slots = _slots(histogram, int(r["capacity"]), max(0, int(r["sep"])))
        one = ranked.mapInPandas(_place(int(r["pack_id"]), int(r["capacity"]), slots), PACKED)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], PACKED)
    packs = F.array(*[F.lit(int(r["pack_id"])) for r in rows])
    empty = counts.where("n_tokens = 0").select("doc_id", F.explode(packs).alias("pack_id"))
    blank = empty.select("pack_id", "doc_id", F.lit(0).alias("piece"), F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("long").alias("token_offset"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("doc_share"), F.lit(0.0).alias("container_share"))
    return out.unionByName(blank)


def _slots(histogram: dict[int, int], capacity: int, sep: int) -> dict:
    """Lookup arrays of a plan: for a key of length and rank, the first container, place and offset of its run.

    A separator is charged to every item, and the capacity grown by one, which
    is the same as charging it between items only.
    """
    pieces: dict[int, int] = {}
    for n, c in histogram.items():
        rest = n % capacity or capacity
        pieces[rest] = pieces.get(rest, 0) + c
    planned = plan({n + sep: c for n, c in pieces.items()}, capacity + sep)
    runs: list[tuple[int, int, int, int, int]] = []  # length, number, container, place, offset
    container = 0
    for lengths, number in planned:
        offset = 0
        for place, n in enumerate(lengths):
            runs.append((n - sep, number, container, place, offset))
            offset += n
        container += number
    runs.sort(key=lambda x: x[0])
    length = np.array([x[0] for x in runs], np.int64)
    number = np.array([x[1] for x in runs], np.int64)
    start = np.cumsum(number) - number
    first = np.searchsorted(length, length)
    start -= start[first] if len(start) else 0
    # documents of different lengths share a rest length; each length's documents follow those of the shorter ones
    base, done = {}, {}
    for n in sorted(histogram):
        rest = n % capacity or capacity
        base[n] = done.get(rest, 0)
        done[rest] = base[n] + histogram[n]
    full, at = {}, container
    for n in sorted(histogram):
        if n > capacity:
            full[n] = at
            at += histogram[n] * ((n - 1) // capacity)
    table = lambda d: (np.array(sorted(d), np.int64), np.array([d[k] for k in sorted(d)], np.int64))
    return {"length": length, "start": start, "container": np.array([x[2] for x in runs], np.int64), "place": np.array([x[3] for x in runs], np.int64), "offset": np.array([x[4] for x in runs], np.int64), "base": table(base), "full": table(full)}


_RANKS = np.int64(1) << 40


def _place(pack: int, capacity: int, slots: dict):
    """Rows of the pieces of ranked documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = slots["length"] * _RANKS + slots["start"]
        for pdf in batches:
            n, rank, doc = (pdf[c].to_numpy(np.int64) for c in ("n_tokens", "rank", "doc_id"))
            rest = np.where(n % capacity == 0, capacity, n % capacity)
            number = slots["base"][1][np.searchsorted(slots["base"][0], n)] + rank
            at = np.searchsorted(key, rest * _RANKS + number, side="right") - 1
            last = pd.DataFrame({"doc_id": doc, "piece": (n - 1) // capacity, "container_id": slots["container"][at] + number - slots["start"][at], "place": slots["place"][at], "token_offset": slots["offset"][at], "n_tokens": rest, "whole": n})
            long = np.flatnonzero(n > capacity)
            parts = (n[long] - 1) // capacity
            piece = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first = slots["full"][1][np.searchsorted(slots["full"][0], n[long])] + rank[long] * parts if len(long) else np.zeros(0, np.int64)
            cuts = pd.DataFrame({"doc_id": np.repeat(doc[long], parts), "piece": piece, "container_id": np.repeat(first, parts) + piece, "place": 0, "token_offset": 0, "n_tokens": capacity, "whole": np.repeat(n[long], parts)})
            both = pd.concat([last, cuts], ignore_index=True)
            both["pack_id"] = pack
            both["doc_share"] = both["n_tokens"] / both["whole"]
            both["container_share"] = both["n_tokens"] / capacity
            yield both[["pack_id", "doc_id", "piece", "container_id", "place", "token_offset", "n_tokens", "doc_share", "container_share"]]

    return run


def pack_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, items, tokens, separators and the share of all capacity in use."""
    each = packed.where("container_id is not null").groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    total = each.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("items").alias("n_items"), F.sum("tokens").alias("n_tokens"))
    named = specs.select(F.col("pack_id").cast("int").alias("pack_id"), "capacity", "sep_tokens").dropDuplicates(["pack_id"])
    return total.join(named, "pack_id").withColumn("fill", F.round((F.col("n_tokens") + F.coalesce("sep_tokens", F.lit(0)) * (F.col("n_items") - F.col("n_containers"))) / (F.col("n_containers") * F.col("capacity")), 6))
