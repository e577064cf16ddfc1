"""Problem 7: text decoded with the wrong character encoding, found and restored.

A hidden Markov model reads the non-ASCII characters of a text. Its states are
``clean`` and one per encoding pair (the bytes' true encoding, the one they were
read with), besides ``lost`` for U+FFFD. ASCII characters have the same
emission in every state, since all encodings here share ASCII, so a run of them
leaves the path as it is and the chain need only visit the other characters.

* Clean emission: the joint probability of a character with the classes of its
  two neighbours, counted over all documents. The table has a fixed size (the
  characters of the encodings below times 10 x 10 classes).
* Emission of a pair's state: the same probability of what the character, or
  the byte sequence it belongs to, becomes under the pair's inverse.
* The counts are taken twice: once over everything, and again over what the
  first labelling calls clean (one EM step), so that common damage does not
  pass as clean.

Each labelled span gets the inverse of its state; what comes out is read again,
up to ``ROUNDS`` times, for text that was damaged more than once.

Defined results: null and blank texts give no row, a document without damage
gives no row, repeated rows give repeated rows; texts are read whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings in which UTF-8 bytes are commonly misread.
UTF8_READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp866", "koi8_r", "iso8859_2", "iso8859_15", "cp1254")
#: (true encoding, encoding it was read with) of single-byte text.
SINGLE_READ_AS = (
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "cp866"), ("cp1252", "koi8_r"), ("cp1252", "cp1250"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp1251", "cp866"), ("cp1251", "koi8_r"), ("cp1251", "mac_roman"), ("cp1251", "cp437"), ("cp1251", "cp850"),
    ("cp866", "cp1252"), ("cp866", "cp1251"), ("cp866", "koi8_r"), ("cp866", "cp437"), ("koi8_r", "cp1252"), ("koi8_r", "cp1251"), ("koi8_r", "cp866"), ("koi8_r", "cp437"), ("koi8_r", "mac_roman"),
    ("iso8859_5", "cp1251"), ("iso8859_5", "cp1252"), ("mac_cyrillic", "cp1251"), ("mac_cyrillic", "cp1252"), ("cp1250", "cp1252"),
)
#: Costs, in nats, of entering and leaving a damaged state.
ENTER, LEAVE = 6.0, 1.0
#: Further cost of entering or leaving between two characters that touch; damage begins and ends at gaps.
TOUCHING = 8.0
#: Emission of a character that a state cannot produce.
NEVER = -30.0
#: Weight of the prior notion of clean text; small against any real corpus.
PRIOR = 2
#: Readings of a text that was damaged more than once.
ROUNDS = 3
#: Characters handled at a time in a worker, so that memory does not follow the Arrow batch.
CHUNK = 1_000_000

_CLASSES = 10


def _class_of(code: int) -> int:
    if code < 128:
        ch = chr(code)
        if ch.islower():
            return 1
        if ch.isupper():
            return 2
        return 3 if ch.isdigit() else 4 if code > 32 else 0
    if code in (0xA0, 0x2009, 0x202F):
        return 0
    name = unicodedata.name(chr(code), "") if not 0xD800 <= code < 0xE000 else ""
    kind = unicodedata.category(chr(code))
    if name.startswith("CYRILLIC"):
        return 8 if kind == "Lu" else 7
    if name.startswith("LATIN"):
        return 6 if kind == "Lu" else 5
    return 9


def _byte_char(byte: int, codec: str) -> str:
    """The character of one byte; bytes the encoding leaves open become C1 controls, as lenient readers do."""
    try:
        return bytes([byte]).decode(codec)
    except UnicodeDecodeError:
        return chr(byte)


@lru_cache(maxsize=1)
def _tables() -> dict:
    """Fixed lookup tables: class, alphabet index, byte of each encoding, inverse of each single-byte pair."""
    cls = np.fromiter((_class_of(i) for i in range(65536)), np.uint8, 65536)
    letters = set()
    for codec in {*UTF8_READ_AS, *(x for p in SINGLE_READ_AS for x in p)}:
        letters |= {_byte_char(b, codec) for b in range(128, 256)}
    letters |= {chr(c) for c in (*range(0x80, 0x180), *range(0x400, 0x460), *range(0x2010, 0x2045), 0x20AC, 0x2116, 0x2122, 0xFFFD)}
    letters = sorted(x for x in letters if ord(x) > 127)
    ident = np.zeros(65536, np.int32)
    for k, ch in enumerate(letters, 1):
        ident[ord(ch)] = k
    byte = {}
    for codec in UTF8_READ_AS:
        m = np.full(65536, -1, np.int16)
        for b in range(128, 256):
            m[ord(_byte_char(b, codec))] = b
        byte[codec] = m
    inverse = {}
    for true, read in SINGLE_READ_AS:
        m = np.full(65536, -1, np.int32)
        for b in range(128, 256):
            to = _byte_char(b, true)
            if not 0x80 <= ord(to) < 0xA0:
                m[ord(_byte_char(b, read))] = ord(to)
        inverse[true, read] = m
    return {"cls": cls, "ident": ident, "size": len(letters) + 1, "byte": byte, "inverse": inverse}


def states() -> list[str]:
    """Names of the damaged states, in the order of the emission rows."""
    return [f"utf-8>{c}" for c in UTF8_READ_AS] + [f"{a}>{b}" for a, b in SINGLE_READ_AS] + ["lost"]


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes > 65535, 65535, codes).astype(np.uint16)


class _Events:
    """The non-ASCII characters of some texts, with their neighbours. Texts are kept apart by a blank."""

    def __init__(self, texts: list[str]):
        t = _tables()
        codes = _codes(" " + " ".join(texts) + " ")
        self.at = np.flatnonzero(codes > 127)
        self.code = codes[self.at].astype(np.int64)
        self.before = codes[self.at - 1].astype(np.int64)
        self.after = codes[self.at + 1].astype(np.int64)
        ends = np.cumsum([len(x) + 1 for x in texts])
        self.text = np.searchsorted(ends, self.at - 1, side="right")
        self.start = np.concatenate([[1], ends[:-1] + 1]) if texts else np.zeros(0, np.int64)
        joined = np.diff(self.at) == 1
        self.next_joined = np.append(joined, False)
        self.prev_joined = np.append(False, joined) if len(self.at) else np.zeros(0, bool)
        self.next_joined = self.next_joined[: len(self.at)]
        self.prev_joined = self.prev_joined[: len(self.at)]
        cls = t["cls"]
        self.key = _key(t["ident"][self.code], cls[self.before], cls[self.after])


def _key(ident: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return (ident.astype(np.int64) * _CLASSES + before) * _CLASSES + after


def _decode_units(ev: _Events, codec: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 sequences among the events read back through ``codec``: length at their first event, code point, events covered."""
    b = _tables()["byte"][codec][ev.code].astype(np.int64)
    n = len(b)
    length, point, covered = np.zeros(n, np.int8), np.zeros(n, np.int64), np.zeros(n, bool)
    if not n:
        return length, point, covered
    tail = (b >= 0x80) & (b < 0xC0) & ev.prev_joined
    shift = lambda a, k: np.append(a[k:], np.zeros(min(k, n), a.dtype))[:n]
    t1, t2, t3 = shift(tail, 1), shift(tail, 2), shift(tail, 3)
    b1, b2, b3 = shift(b, 1), shift(b, 2), shift(b, 3)
    two = (b >= 0xC2) & (b < 0xE0) & t1
    three = (b >= 0xE0) & (b < 0xF0) & t1 & t2
    four = (b >= 0xF0) & (b < 0xF5) & t1 & t2 & t3
    p2 = (b & 31) << 6 | b1 & 63
    p3 = (b & 15) << 12 | (b1 & 63) << 6 | b2 & 63
    three &= p3 >= 0x800
    for mask, p, k in ((two, p2, 2), (three, p3, 3), (four, np.full(n, 65535), 4)):
        length[mask], point[mask] = k, np.minimum(p[mask], 65535)
        where = np.flatnonzero(mask)
        for j in range(k):
            covered[where + j] = True
    return length, point, covered


def _emissions(ev: _Events, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratio of every event in every damaged state against ``clean``, and where an event continues a sequence that the state cannot leave or enter."""
    t = _tables()
    cls, ident = t["cls"], t["ident"]
    clean = logp[ev.key]
    clean = np.where(ev.code == 0xFFFD, NEVER, clean)
    n = len(ev.code)
    out = np.full((len(UTF8_READ_AS) + len(SINGLE_READ_AS) + 1, n), NEVER, np.float32)
    inside = np.zeros(out.shape, bool)
    total = np.concatenate([[0.0], np.cumsum(clean)])
    row = 0
    for codec in UTF8_READ_AS:
        length, point, covered = _decode_units(ev, codec)
        lead = np.flatnonzero(length)
        if len(lead):
            k = length[lead].astype(np.int64)
            last = lead + k - 1
            unit_class = np.zeros(n, np.uint8)
            unit_class[lead] = cls[point[lead]]
            ends_class = np.zeros(n, np.uint8)
            ends_class[last] = cls[point[lead]]
            is_end = np.zeros(n, bool)
            is_end[last] = True
            before = np.where(ev.prev_joined[lead] & is_end[lead - 1], ends_class[lead - 1], cls[ev.before[lead]])
            nxt = np.minimum(last + 1, n - 1)
            after = np.where(ev.next_joined[last] & (length[nxt] > 0), unit_class[nxt], cls[ev.after[last]])
            out[row, covered] = 0
            inside[row, covered] = True
            inside[row, lead] = False
            out[row, lead] = logp[_key(ident[point[lead]], before, after)] - (total[last + 1] - total[lead])
        row += 1
    for pair in SINGLE_READ_AS:
        to = t["inverse"][pair]
        point = to[ev.code]
        ok = np.flatnonzero(point >= 0)
        if len(ok):
            ascii_or = lambda c: np.where(c < 128, c, np.maximum(to[c], 0))
            before, after = cls[ascii_or(ev.before[ok])], cls[ascii_or(ev.after[ok])]
            ratio = logp[_key(ident[point[ok]], before, after)] - clean[ok]
            # what stays the same, between neighbours that stay the same, is no sign of damage
            same = (point[ok] == ev.code[ok]) & (before == cls[ev.before[ok]]) & (after == cls[ev.after[ok]])
            out[row, ok] = np.where(same, np.minimum(ratio, 0), ratio)
        row += 1
    lost = ev.code == 0xFFFD
    out[row, lost] = -NEVER
    return out, inside


def _viterbi(scores: np.ndarray, inside: np.ndarray, joined: np.ndarray, enter: float, leaving: float) -> np.ndarray:
    """Best state of each event (-1 clean), for one text; scores are ratios against clean."""
    live = np.flatnonzero(np.maximum(scores, 0).sum(1) > enter)
    n, size = scores.shape[1], len(live)
    path = np.full(n, -1, np.int16)
    if not size:
        return path
    never = float("-inf")
    clean, best = 0.0, [never] * size
    came_from, stayed = [], []
    for score, held, touch in zip(scores[live].T.tolist(), inside[live].T.tolist(), (joined * TOUCHING).tolist(), strict=True):
        top = max(range(size), key=lambda k: never if held[k] else best[k])  # noqa: B023
        leave = never if held[top] else best[top] - leaving - touch
        came_from.append(top if leave > clean else -1)
        clean = max(clean, leave)
        entered = clean - enter - touch
        stay = [h or b >= entered for h, b in zip(held, best, strict=True)]
        best = [(b if k else entered) + s for b, k, s in zip(best, stay, score, strict=True)]
        stayed.append(stay)
    top = max(range(size), key=best.__getitem__)
    state = top if best[top] - leaving > clean else -1
    for i in range(n - 1, -1, -1):
        if state >= 0:
            path[i] = live[state]
        if state < 0 or not stayed[i][state]:
            state = came_from[i]
    return path


def _paths(ev: _Events, logp: np.ndarray, costs: tuple[float, float]) -> np.ndarray:
    """State of every event; texts whose gain cannot pay for entering a state are clean without a search."""
    n = len(ev.code)
    path = np.full(n, -1, np.int16)
    if not n:
        return path
    scores, inside = _emissions(ev, logp)
    bounds = np.flatnonzero(np.diff(ev.text)) + 1
    lo = np.concatenate([[0], bounds])
    hi = np.concatenate([bounds, [n]])
    gains = np.add.reduceat(np.maximum(scores, 0), lo, axis=1).max(0)
    for a, b in zip(lo[gains > costs[0]], hi[gains > costs[0]], strict=True):
        path[a:b] = _viterbi(scores[:, a:b], inside[:, a:b], ev.prev_joined[a:b], *costs)
    return path


def _restore(text: str, ev: _Events, path: np.ndarray) -> tuple[str, int, set[str], bool]:
    """The text with the inverse of each labelled span, the number of spans, their states, whether nothing is lost."""
    names, t = states(), _tables()
    where = np.flatnonzero(path >= 0)
    if not len(where):
        return text, 0, set(), True
    spans = int(1 + np.count_nonzero((np.diff(where) > 1) | (np.diff(path[where]) != 0)))
    chars, whole = list(text), True
    for state in np.unique(path[where]):
        mine = where[path[where] == state]
        if state < len(UTF8_READ_AS):
            length, _, covered = _decode_units(ev, UTF8_READ_AS[state])
            back = t["byte"][UTF8_READ_AS[state]]
            whole &= bool(covered[mine].all())
            for i in mine[length[mine] > 0]:
                at, k = ev.at[i] - 1, int(length[i])
                chars[at] = bytes(int(back[c]) for c in ev.code[i : i + k]).decode("utf-8", "replace")
                chars[at + 1 : at + k] = [""] * (k - 1)
        elif names[state] == "lost":
            whole = False
        else:
            to = t["inverse"][SINGLE_READ_AS[state - len(UTF8_READ_AS)]]
            for i in mine:
                if to[ev.code[i]] >= 0:
                    chars[ev.at[i] - 1] = chr(to[ev.code[i]])
                else:
                    whole = False
    return "".join(chars), spans, {names[s] for s in np.unique(path[where])}, whole


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[str]]]:
    """Rows of a batch with a non-ASCII text, some at a time."""
    rows, texts, size = [], [], 0
    for i, text in enumerate(batch.column("text").to_pylist()):
        if text and not text.isascii():
            rows.append(i)
            texts.append(text)
            size += len(text)
            if size >= CHUNK:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _count(logp: np.ndarray | None, costs: tuple[float, float]):
    """Partial counts of the keys; with ``logp`` only of characters labelled clean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = _tables()["size"] * _CLASSES * _CLASSES
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for _, texts in _chunks(batch):
                ev = _Events(texts)
                key = ev.key if logp is None else ev.key[_paths(ev, logp, costs) < 0]
                counts += np.bincount(key, minlength=size)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["key", "n"])

    return run


def _model(docs: DataFrame, logp: np.ndarray | None, costs: tuple[float, float]) -> np.ndarray:
    """Log probabilities of all keys. The collected table has a fixed number of rows whatever the corpus."""
    size = _tables()["size"] * _CLASSES * _CLASSES
    rows = docs.select("text").mapInArrow(_count(logp, costs), "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(size)
    for r in rows:
        n[r["key"]] = r["n"]
    n = n.reshape(-1, _CLASSES * _CLASSES) + _prior()
    total = n.sum()
    chars, contexts = (n.sum(1, keepdims=True) + 0.05) / (total + 1), (n.sum(0, keepdims=True) + 0.5) / (total + 1)
    p = (n + 5 * chars * contexts) / (total + 5)
    return np.log(p).astype(np.float32).ravel()


@lru_cache(maxsize=1)
def _prior() -> np.ndarray:
    """A few counts of ordinary letters and marks, so that small corpora have a notion of clean text."""
    t = _tables()
    n = np.zeros((t["size"], _CLASSES * _CLASSES))
    put = lambda chars, before, after, k: [n.__setitem__((t["ident"][ord(c)], before * _CLASSES + after), k) for c in chars]
    put("éèàáíóúñüöäçêâôîû", 1, 1, 3)
    put("éèàáíóúßä", 1, 0, 1)
    put("éàáíóúñüöä", 0, 1, 1)
    put("ÉÁÖÜÄ", 0, 1, 0.3)
    put("°±µ§£€×", 0, 0, 0.3)
    put("°±µ§£€×", 0, 3, 0.3)
    put("°µ", 0, 2, 0.3)
    for a, b in ((7, 7), (0, 7), (7, 0)):
        put("абвгдежзийклмнопрстуфхцчшщыьэюяё", a, b, 3)
    put("АБВГДЕЖЗИКЛМНОПРСТУ", 0, 7, 1)
    put("’", 1, 1, 3)
    put("“‘«", 0, 2, 3)
    put("”’»", 1, 0, 3)
    put("–—", 0, 0, 3)
    return n * PRIOR


FOUND = "doc_id long, n_spans int, encodings array<string>, restored string, complete boolean"


def _find(logp: np.ndarray, costs: tuple[float, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column("doc_id"), []
            for rows, texts in _chunks(batch):
                ev = _Events(texts)
                path = _paths(ev, logp, costs)
                for k in np.unique(ev.text[path >= 0]):
                    text, spans, names, complete = texts[k], 0, set(), True
                    for _ in range(ROUNDS):
                        one = _Events([text])
                        text, more, which, whole = _restore(text, one, _paths(one, logp, costs))
                        if not more:
                            break
                        spans, names, complete = max(spans, more), names | which, complete and whole
                    out.append((ids[rows[k]].as_py(), spans, sorted(names), text, complete))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types, strict=True)], ["doc_id", "n_spans", "encodings", "restored", "complete"])

    return run


def garbled_documents(docs: DataFrame, enter: float = ENTER, leave: float = LEAVE) -> DataFrame:
    """Damaged documents with the restored text.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Columns:
    ``doc_id``, ``n_spans``, ``encodings`` (names ``true>read as``), ``restored``
    and ``complete`` (false where some character could not be had).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    costs = (enter, leave)
    logp = _model(docs, _model(docs, None, costs), costs)
    return docs.mapInArrow(_find(logp, costs), FOUND)
