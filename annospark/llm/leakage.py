"""Problem 6: passages of evaluation items inside documents.

Texts are reduced to their letters and digits, so that case, punctuation,
layout and marks do not count. Then, per document:

1. q-gram lemma: hits of the items' q-grams are counted in overlapping diagonal
   bands (document position minus item position). Two strings of ``n`` symbols
   within ``k`` edits share ``n - q + 1 - k q`` q-grams, so a band with fewer
   hits than that for the shortest piece of interest is dropped.
2. The bands kept for one item are joined (an interruption moves the rest of a
   passage to another diagonal) and must together reach the bound of a whole
   case.
3. Banded alignment: the words of the item and of the document around the kept
   diagonals are aligned; the longest stretch of the item that is present with
   few changed or missing words decides.

The bounds follow each part (passage or question): a case of ``n`` symbols, the
shortest run of ``MIN_WORDS`` words of it, must keep ``HITS`` q-grams, so by the
lemma every case within ``(n - Q + 1 - HITS) // Q`` edits is a candidate; of a
shorter part as many q-grams as it has are asked for. Parts shorter than a q-gram
are searched letter by letter.

Sentences that several items share are counted over all items before anything
else. Then the items' q-gram index is sent to the workers after a check of its
size; beyond ``ITEM_BYTES`` of items the operator goes over them in blocks, each
within the bound, with the same result: a part is found or not by itself.

Defined results: null and blank documents and items give no row; a document
holding an item twice gives one row per document row and item; equal items under
two ids are each reported; sentences shared by several items are no evidence.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Symbols in a q-gram.
Q = 16
#: Width of a diagonal band, in symbols; bands overlap by half.
BAND = 48
#: Words of an unbroken stretch that make a case.
MIN_WORDS = 20
#: Q-grams that a band must hold to be kept: those of a piece of 40 symbols, about seven words, with one edit.
PIECE_HITS = 40 - Q + 1 - Q
#: Q-grams that a case must keep: those of 20 short words, 74 symbols, with three edits.
HITS = 74 - Q + 1 - 3 * Q
#: Half width of the aligned band: words along and across the diagonal of a hit.
REACH, SLACK = 6, 3
#: A stretch of ``n`` words needs ``WORD_SHARE * n + WORD_BASE`` of them, a question ``QUESTION_SHARE`` of its words.
WORD_SHARE, WORD_BASE, QUESTION_SHARE = 0.7, 3, 0.8
#: Words of other text that may interrupt a stretch, and item words that may be missing in one place.
INTERRUPTION, MISSING = 45, 3
#: Words around a question in which its answer is looked for.
ANSWER_REACH = 25
#: Symbols of a cell; of so many cells in a row, hits must touch so many for a stretch to be possible.
CELL, WINDOW, TOUCHED = 8, 24, 9
#: Width of a region of diagonals, twice the symbols of the longest interruption.
REGION = 640
#: Bands and regions of all texts begin at multiples of this, whichever texts are handled together.
GRID = 1920
#: Fewest words of a sentence that counts as shared when several items have it.
SHARED_WORDS = 6
#: Items whose texts together are larger are handled in several blocks.
ITEM_BYTES = 8 << 20
CHUNK = 1_000_000

_BASE = np.uint64(1_000_003)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TAG = re.compile(r"<[^<>]{1,24}>")
_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 for what is left out, equal for a letter with and without case and accent."""
    out = np.zeros(65536, np.uint64)
    for code in range(65536):
        if 0xD800 <= code < 0xE000:
            continue
        ch = chr(code)
        if ch.isalnum():
            base = unicodedata.normalize("NFKD", ch.lower())[0]
            out[code] = ord(base.lower()) + 1
    return out


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(codes, 65535)


def _grams(symbols: np.ndarray) -> np.ndarray:
    """Hash of the q-gram beginning at each symbol."""
    n = len(symbols) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        parts, width, power = {1: symbols}, 1, _BASE
        powers = {1: _BASE}
        while width * 2 <= Q:
            h = parts[width]
            parts[width * 2] = h[:-width] * power + h[width:]
            width *= 2
            power = power * power
            powers[width] = power
        out, at = None, 0
        for w in sorted(parts, reverse=True):
            if Q & w or (w == width and at == 0 and Q & w):
                piece = parts[w][at : at + n]
                out = piece if out is None else out * powers[w] + piece
                at += w
        return out * _MIX


def _letters(symbols: np.ndarray) -> str:
    """Symbols as text, one character each."""
    return symbols.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def words_of(text: str) -> list[str]:
    """Words without case and accents; tags and marks are left out."""
    text = unicodedata.normalize("NFKD", _TAG.sub(" ", text))
    return [w.lower() for w in _WORD.findall("".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text)]


def _sentences(text: str | None) -> list[str]:
    return re.split(r"(?<=[.!?])\s+", text or "")


def with_shared(items: DataFrame) -> DataFrame:
    """The items with ``shared``: the places of those sentences of the passage that another item has too, counted over all items."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, passage in zip(pdf["item_id"], pdf["passage"], strict=True):
                for place, sentence in enumerate(_sentences(passage)):
                    w = words_of(sentence)
                    if len(w) >= SHARED_WORDS:
                        rows.append((item, place, blake2b(" ".join(w).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()))
            yield pd.DataFrame(rows, columns=["item_id", "place", "key"])

    sentences = items.select("item_id", "passage").mapInPandas(split, "item_id long, place int, key string")
    several = sentences.groupBy("key").agg(F.countDistinct("item_id").alias("n")).where("n > 1").select("key")
    flagged = sentences.join(several, "key", "left_semi").groupBy("item_id").agg(F.collect_set("place").alias("shared"))
    return items.join(flagged, "item_id", "left")


class Index:
    """The q-grams of a block of items: ``item_id``, question, passage, answer, places of shared sentences."""

    def __init__(self, items: list[tuple[int, str | None, str | None, str | None, list[int] | None]]):
        self.parts: list[tuple[int, str, list[str], np.ndarray, list[str]]] = []  # item, kind, words, evidence, answer
        self.short: list[tuple[str, int]] = []  # letters of a part shorter than a q-gram, part
        grams, owner, place, need, cells = [], [], [], [], []
        for item, question, passage, answer, shared in items:
            for kind, text in (("p", passage), ("q", question)):
                if not text or not text.strip():
                    continue
                if kind == "q" and not words_of(answer or ""):
                    continue
                words, evidence = [], []
                for k, s in enumerate(_sentences(text)):
                    w = words_of(s)
                    words += w
                    evidence += [not (kind == "p" and k in (shared or ()))] * len(w)
                if not any(evidence):
                    continue
                letters = "".join(words)
                symbols = _symbols()[_codes(letters)]
                h = _grams(symbols)
                of_word = np.repeat(np.arange(len(words)), [len(w) for w in words])[: len(h)] if words else np.zeros(0, int)
                use = np.array(evidence, bool)[of_word] if len(h) else np.zeros(0, bool)
                at = np.flatnonzero(use)
                if not len(at):
                    self.short.append((_letters(symbols), len(self.parts)))
                grams.append(h[at])
                owner.append(np.full(len(at), len(self.parts), np.int32))
                place.append(at.astype(np.int32))
                sizes = np.array([len(w) for w, e in zip(words, evidence, strict=True) if e])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                case = int((ends[MIN_WORDS:] - ends[:-MIN_WORDS]).min()) if kind == "p" and len(sizes) > MIN_WORDS else int(ends[-1])
                need.append(min(max(case - Q + 1, 1), HITS))
                cells.append(int(ends[-1]) // CELL)
                self.parts.append((item, kind, words, np.array(evidence, bool), words_of(answer or "")))
        g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.gram, self.owner, self.place = g[order], (np.concatenate(owner) if owner else np.zeros(0, np.int32))[order], (np.concatenate(place) if place else np.zeros(0, np.int32))[order]
        self.unique, self.first, self.count = np.unique(self.gram, return_index=True, return_counts=True)
        self.words = [np.repeat(np.arange(len(p[2])), [len(w) for w in p[2]]) for p in self.parts]
        self.question = np.array([p[1] == "q" for p in self.parts], bool)
        self.need, self.cells = np.array(need, np.int64), np.array(cells, np.int64)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.unique >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position in ``gram``, part and place of every hit."""
        at = np.flatnonzero(self.filter[(gram >> np.uint64(42)).astype(np.int64)])
        where = np.searchsorted(self.unique, gram[at])
        where[where == len(self.unique)] = 0
        same = self.unique[where] == gram[at] if len(self.unique) else np.zeros(len(at), bool)
        at, where = at[same], where[same]
        n = self.count[where]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        slot = np.repeat(self.first[where], n) + step
        return np.repeat(at, n), self.owner[slot], self.place[slot]

    def dense(self, part: np.ndarray, pair: np.ndarray, place: np.ndarray) -> np.ndarray:
        """For each of the numbered pairs, whether its hits touch enough of the part close together: a stretch, or a whole question."""
        width = int(place.max() + Q) // CELL + 1
        touched = np.zeros((len(part), width), bool)
        for step in (0, Q // 2, Q - 1):
            touched[pair, (place + step) // CELL] = True
        reach = np.cumsum(touched, axis=1, dtype=np.int32)
        total = reach[:, -1].copy()
        if width > WINDOW:
            reach[:, WINDOW:] -= reach[:, :-WINDOW].copy()
        return np.where(self.question[part], total >= 0.6 * self.cells[part], reach.max(1) >= np.minimum(TOUCHED, 0.6 * self.cells[part]))


def _kept(index: Index, doc: np.ndarray, part: np.ndarray, at: np.ndarray, place: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Hits of the bands that are kept, by document and part."""
    parts = len(index.parts)
    pair = doc.astype(np.int64) * parts + part
    few = np.bincount(pair)
    need = index.need[part]
    keep = np.flatnonzero(few[pair] >= need)
    need = need[keep]
    pair, at, place = pair[keep], at[keep], place[keep]
    if not len(pair):
        return []
    diagonal = at - place
    low = int(diagonal.min()) // GRID * GRID - GRID
    bands = int(diagonal.max() - low) // BAND + 2
    kept = np.zeros(len(pair), bool)
    for shift in (0, BAND // 2):
        _, back, size = np.unique(pair * bands + (diagonal - low + shift) // BAND, return_inverse=True, return_counts=True)
        kept |= size[back] >= np.minimum(need, PIECE_HITS)
    pair, at, place = pair[kept], at[kept], place[kept]
    # an interruption moves a passage by at most REGION / 2, so each case lies within one region of either shift
    diagonal = at - place - low
    regions = int(diagonal.max()) // REGION + 2 if len(pair) else 1
    out, done = [], set()
    for shift in (0, REGION // 2):
        group = pair * regions + (diagonal + shift) // REGION
        order = np.argsort(group, kind="stable")
        group, first, second = group[order], at[order], place[order]
        lo = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1]) if len(group) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([lo, [len(group)]]))
        some = np.flatnonzero(size >= index.need[group[lo] // regions % parts])
        if not len(some):
            continue
        slot = np.full(len(lo), -1)
        slot[some] = np.arange(len(some))
        mine = np.repeat(slot, size)
        of = group[lo[some]] // regions
        good = index.dense(of % parts, mine[mine >= 0], second[mine >= 0])
        for k in some[good]:
            key = (int(group[lo[k]] // regions), int(first[lo[k]]), int(size[k]))
            if key not in done:
                done.add(key)
                out.append((key[0] // parts, key[0] % parts, first[lo[k] : lo[k] + size[k]], second[lo[k] : lo[k] + size[k]]))
    return sorted(out, key=lambda x: x[:2])


def _aligned(item: list[str], doc: list[str], pairs: np.ndarray) -> list[tuple[int, int]]:
    """Longest chain of equal words (item index, document index) inside the bands around ``pairs``.

    The candidates are the cells of the word matrix near a kept hit; the chain is
    the longest one rising in both indices.
    """
    shift_i, shift_j = np.meshgrid(np.arange(-REACH, REACH + 1), np.arange(-SLACK, SLACK + 1))
    i = (pairs[0][:, None] + shift_i.ravel()).ravel()
    j = (pairs[1][:, None] + (shift_i + shift_j).ravel()).ravel()
    inside = (i >= 0) & (i < len(item)) & (j >= 0) & (j < len(doc))
    cell = np.unique(i[inside] * len(doc) + j[inside])
    i, j = cell // len(doc), cell % len(doc)
    number = {w: k for k, w in enumerate(dict.fromkeys(item))}
    item_id = np.array([number[w] for w in item])
    seen, back = np.unique(j, return_inverse=True)
    same = item_id[i] == np.array([number.get(doc[k], -1) for k in seen.tolist()])[back]
    cells = sorted(zip(i[same].tolist(), (-j[same]).tolist(), strict=True))
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, minus) in enumerate(cells):
        at = bisect_left(tails, -minus)
        if at == len(tails):
            tails.append(-minus)
            ends.append(k)
        else:
            tails[at], ends[at] = -minus, k
        before.append(ends[at - 1] if at else -1)
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append((cells[k][0], -cells[k][1]))
        k = before[k]
    return chain[::-1]


def _stretch(chain: list[tuple[int, int]], evidence: np.ndarray) -> tuple[int, int, int]:
    """Longest part of the chain that is one stretch of the item: words it spans, first and last chain index."""
    best, start = (0, 0, -1), 0
    for k in range(len(chain) + 1):
        broken = k == len(chain) or k > start and (chain[k][0] - chain[k - 1][0] > MISSING + 1 or chain[k][1] - chain[k - 1][1] > INTERRUPTION + 1)
        if broken:
            lo, hi = start, k - 1
            # loose ends do not stretch a case: drop edge words that hang on by less than half
            while hi > lo and (chain[hi][0] - chain[hi - 1][0] > 2 or chain[hi][1] - chain[hi - 1][1] > 3) and hi - lo < k:
                hi -= 1
            while hi > lo and (chain[lo + 1][0] - chain[lo][0] > 2 or chain[lo + 1][1] - chain[lo][1] > 3):
                lo += 1
            if hi > lo:
                a, b = chain[lo][0], chain[hi][0]
                span = int(evidence[a : b + 1].sum())
                there = sum(bool(evidence[i]) for i, _ in chain[lo : hi + 1])
                if there >= min(span, WORD_SHARE * span + WORD_BASE) and span > best[0]:
                    best = (span, lo, hi)
            start = k
    return best


def _verify(index: Index, part: int, words: list[str], word_at: np.ndarray, at: np.ndarray, place: np.ndarray) -> bool:
    """Whether the document's words hold the part. ``word_at``: word of each symbol of the document."""
    _, kind, item, evidence, answer = index.parts[part]
    item_word = index.words[part]
    chain = _aligned(item, words, np.unique(np.stack([item_word[place], word_at[at]]), axis=1))
    if kind == "p":
        span, _, _ = _stretch(chain, evidence)
        return span >= min(MIN_WORDS, int(evidence.sum()))
    span, lo, hi = _stretch(chain, evidence)
    if hi < lo or span < len(item) - MISSING or hi - lo + 1 < QUESTION_SHARE * len(item):
        return False
    a, b = chain[lo][1], chain[hi][1]
    near = words[max(0, a - ANSWER_REACH) : a] + ["\n"] + words[b + 1 : b + 1 + ANSWER_REACH + len(answer)]
    text = " " + " ".join(near) + " "
    core = answer[1:] if len(answer) > 1 and answer[0] in {"a", "an", "the"} else answer
    return f" {' '.join(core)} " in text


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _symbols()
        for batch in batches:
            ids = batch.column("doc_id")
            found: list[tuple[int, int]] = []
            rows: list[int] = []
            texts: list[str] = []
            size = 0
            values = batch.column("text").to_pylist()
            for i, text in enumerate(values):
                if text:
                    rows.append(i)
                    texts.append(_TAG.sub(" ", text) if "<" in text else text)
                    size += len(text)
                if texts and (size >= CHUNK or i == len(values) - 1):
                    found += [(ids[rows[d]].as_py(), item) for d, item in _in_texts(index, table, texts)]
                    rows, texts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())], ["doc_id", "item_id"])

    return run


def _in_texts(index: Index, table: np.ndarray, texts: list[str]) -> list[tuple[int, int]]:
    codes = _codes("\n".join(texts))
    symbol = table[codes]
    at = np.flatnonzero(symbol)
    ends = np.cumsum([len(t) + 1 for t in texts])
    symbol = symbol[at]
    gram = _grams(symbol)
    hit, part, place = index.hits(gram)
    if not len(hit) and not index.short:
        return []
    first = np.searchsorted(at, np.concatenate([[0], ends]))
    of_symbol = np.repeat(np.arange(len(texts)), np.diff(first))
    doc = of_symbol[hit]
    inside = doc == of_symbol[hit + Q - 1]
    hit, part, place, doc = hit[inside], part[inside], place[inside], doc[inside]
    out: set[tuple[int, int]] = set()
    known: dict[int, tuple[list[str], np.ndarray]] = {}
    kept = _kept(index, doc, part, hit, place) if len(hit) else []
    for d, p, h, pl in sorted([*kept, *_short(index, symbol, of_symbol)], key=lambda x: x[:2]):
        item = index.parts[p][0]
        if (d, item) in out:
            continue
        if d not in known:
            known = {d: _doc_words(texts[d])}
        words, word_at = known[d]
        if _verify(index, p, words, word_at, h - first[d], pl):
            out.add((d, item))
    return sorted(out)


def _short(index: Index, symbol: np.ndarray, of_symbol: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Where the parts shorter than a q-gram occur, letter for letter."""
    whole = _letters(symbol) if index.short else ""
    for letters, part in index.short:
        at = whole.find(letters)
        while at >= 0:
            if of_symbol[at] == of_symbol[at + len(letters) - 1]:
                yield int(of_symbol[at]), part, np.array([at]), np.array([0])
            at = whole.find(letters, at + 1)


def _doc_words(text: str) -> tuple[list[str], np.ndarray]:
    """Words of a document in symbols, and the word of each symbol."""
    table = _symbols()
    codes = _codes(text)
    symbol = table[codes]
    at = np.flatnonzero(symbol)
    if not len(at):
        return [], np.zeros(0, np.int64)
    word = np.concatenate([[0], np.cumsum(np.diff(at) > 1)])
    letters = (symbol[at] - 1).astype(np.uint32)
    joined = letters.tobytes().decode("utf-32-le", "replace")
    cuts = np.flatnonzero(np.diff(word)) + 1
    bounds = [0, *cuts.tolist(), len(letters)]
    return [joined[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], word


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs ``doc_id``, ``item_id`` of documents and the evaluation items they hold.

    ``docs``: ``doc_id``, ``text``. ``items``: ``item_id``, ``question``,
    ``passage``, ``answer``. A case is the whole passage, an unbroken stretch of
    at least ``MIN_WORDS`` words of it, or the whole question with the answer.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "question", "passage", "answer").where("item_id is not null").dropDuplicates(["item_id"])
    sized = items.withColumn("bytes", sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("question", "passage", "answer")), F.lit(0)))
    blocks = max(1, -(-int(sized.agg(F.sum("bytes")).first()[0] or 0) // ITEM_BYTES))
    marked = with_shared(items)
    if blocks > 1:
        marked = cut(marked)
    out = None
    for b in range(blocks):
        block = marked if blocks == 1 else marked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        index = Index(sorted((r["item_id"], r["question"], r["passage"], r["answer"], r["shared"]) for r in block.toLocalIterator()))
        one = docs.mapInArrow(_search(index), "doc_id long, item_id long")
        out = one if out is None else out.unionByName(one)
    return out
