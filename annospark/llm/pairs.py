"""Problem 1: rounds whose answer is not usable, with the kinds of defect.

A multi-label linear classifier on hashed n-grams and pair features. Nothing is
labelled by hand: the sound rounds are turned into defective ones (cut off, copied
from the question, swapped with an answer in another language, refused, emptied),
and one logistic model per defect learns to tell them from the rounds as they are.
Real defects are label noise; after a first fit the rounds it flags leave, and the
models are fitted again. How common each defect is follows from how many rounds
score as made-up defects do; the threshold of a model is set on held-out rounds
for the best F1 at that share.

Languages are learned from all texts with a language label (labels that the texts
themselves contradict left out) and adapted to the short texts of the rounds. The
features say how well an answer fits the question's language, not only which other
one fits better: when defects are made, the true language of half the swapped
answers is hidden, so an answer in a language without a model is found by its bad
fit. Without labelled texts no language defect is reported.

All of it comes from all rounds and all labelled texts. Counts and thresholds are
sums over the whole tables. Models are fitted in blocks: rounds are dealt by the
hash of their key to blocks of about ``BLOCK``, each block is cleaned and fitted by
itself, and every weight of the model is the mean over the blocks, in which a block
counts as often as the feature occurs in it. What the tasks send is of fixed size
and whole-numbered, so no result depends on partitions; the models are a few
hundred kilobytes. Every round is then scored, whole texts, in batches of flat
arrays, into which all texts of a batch are split at once.

Defined results: samples without conversation and turns that are null are passed
over (a null turn breaks adjacency); a round without a gpt turn directly after it
is ``empty``; a null question takes part as an empty one; repeated rows of a
sample count once; of several defects the one furthest beyond its threshold is
``defect`` and all are in ``defects``, ``empty`` before and without all others.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFECTS = ("empty", "refusal", "copied", "language", "truncated")
#: Rounds of a block: all rounds are dealt to blocks of about so many by the hash of their key.
BLOCK = 12_000
#: Defects are made and models fitted so many times over in a table of one block, as a block alone leaves much to chance; over that many blocks once.
DRAWS = 4
#: A language is learned if it has at least so many labelled texts.
LEAST_TEXTS = 10
#: First guess of each defect's share, the range of its estimate, and the part of made-up defects that the estimate counts by.
PRIOR, SHARES, COUNTED = 0.01, (0.002, 0.2), 0.7
#: Hashed weights of each model.
DIMENSIONS = 1 << 17
EPOCHS, RATE, DECAY = 8, 0.3, 1e-6
#: Times the sample is cleaned of rounds that look defective, and the log odds below which a round stays.
CLEANINGS, CLEAN_BELOW = 2, 1.5
#: Scores are counted in steps of 1 / ``STEPS`` up to +-``REACH``; fits of languages in steps of 1 / ``FIT_STEPS`` from -``FIT_REACH`` to 0.
STEPS, REACH, FIT_STEPS, FIT_REACH = 256, 64, 1024, 32
#: Sums over tasks are of whole numbers, so their order does not matter: weights in units of 1 / ``UNIT``.
UNIT = 1 << 20
#: Most letters that are split into words at once.
LETTERS = 300_000

# Names under which a question may ask for a language.
LANGUAGE_NAMES = {
    "en": "english anglais englisch englische englischen inglés английском английский".split(),
    "fr": "french français française französisch französische französischen francés французском французский".split(),
    "de": "german allemand allemande deutsch deutsche deutschen alemán немецком немецкий".split(),
    "es": "spanish espagnol espagnole spanisch spanische spanischen español испанском испанский".split(),
    "ru": "russian russe russisch russische russischen ruso русском русский".split(),
    "it": "italian italien italienisch italienischen italiano итальянском".split(),
    "pt": "portuguese portugais portugiesisch portugiesischen portugués португальском".split(),
}
# Parts of which refusals are put together.
REFUSAL_OPENINGS = ("", "", "Sorry, ", "I'm sorry, but ", "I am sorry, ", "My apologies: ", "I apologize, however ", "I apologise, but ", "Unfortunately, ", "Regrettably ", "Thank you for asking, but ", "Hmm, ", "I'm afraid ", "Apologies, ")
REFUSAL_BODIES = (
    "I can't help with that request", "I cannot help with this", "I cannot provide an answer to this question", "I am not able to view pictures", "I am unable to see images", "I'm unable to assist with questions of this kind", "I do not have the ability to look at images",
    "I won't describe what is shown there", "I'd rather not comment on this picture", "I must decline to answer", "this is something I must decline to answer", "that is beyond what I may discuss", "answering this would go against my guidelines", "this would violate the content policy",
    "as a language model I have no access to visual content", "as an AI I cannot see the image", "no reply can be given because the request is not allowed", "it is not appropriate for me to respond to this", "this model does not answer questions about pictures",
    "that falls outside the scope of what this service covers", "this topic is off limits for me", "I am only able to process text, not pictures", "I would prefer to skip this one", "nothing can be said about that here", "my instructions do not let me describe images",
    "let us talk about something different", "viewing photographs is not among my capabilities", "there is no way for this system to look at the file", "I have to pass on this question", "I don't think I should respond to that", "requests like this one are declined",
    "pictures of this kind are not something I comment on", "you will have to look for help elsewhere", "I prefer not to answer that", "I am not comfortable answering this", "I have no way of answering that", "it is impossible for me to answer", "I refuse to answer this question",
)
REFUSAL_ENDINGS = ("", "", ". Please ask me something else", ". I hope you understand", ". Is there anything else you would like to know?", ". Consider asking an expert instead", ". Can I help with something else?")
REFUSALS = {
    "fr": (
        ("", "Désolé, ", "Je suis désolé, mais ", "Malheureusement, ", "En tant que modèle de langage, ", "Je regrette, mais "),
        ("je ne peux pas répondre à cette demande", "je ne peux pas vous aider avec cela", "il m’est impossible de vous aider avec cela", "je n’ai pas accès aux images", "je ne peux pas voir les images", "je préfère ne pas répondre à cette question", "je dois refuser cette demande", "je ne suis pas en mesure de commenter cette image"),
    ),
    "de": (
        ("", "Leider ", "Es tut mir leid, aber ", "Entschuldigung, ", "Als Sprachmodell ", "Bedauerlicherweise "),
        ("kann ich diese Frage nicht beantworten", "kann ich dabei nicht helfen", "dabei kann ich nicht helfen", "habe ich keinen Zugriff auf Bilder", "bin ich nicht in der Lage, Bilder anzusehen", "muss ich diese Anfrage ablehnen", "diese Anfrage muss ich ablehnen", "beantworte ich solche Fragen nicht", "möchte ich mich dazu nicht äußern", "darf ich dazu nichts sagen"),
    ),
    "es": (
        ("", "Lo siento, pero ", "Lamentablemente ", "Desgraciadamente ", "Como modelo de lenguaje ", "Me temo que ", "Disculpe, "),
        ("no puedo ayudar con esa petición", "no puedo responder a esta pregunta", "no me es posible responder", "no tengo acceso a las imágenes", "no puedo ver imágenes", "prefiero no contestar a esta pregunta", "debo rechazar esta solicitud", "no estoy autorizado a comentar esta imagen"),
    ),
    "ru": (
        ("", "К сожалению, ", "Извините, но ", "Простите, ", "Как языковая модель, ", "Увы, "),
        ("ответить на этот вопрос невозможно для меня", "я не могу помочь с этим запросом", "я не могу ответить на этот вопрос", "я не вижу изображений", "у меня нет доступа к изображениям", "я предпочитаю не отвечать на этот вопрос", "я вынужден отклонить этот запрос", "я вынужден отказаться от ответа на этот вопрос", "этот запрос мне недоступен"),
    ),
}
REFUSAL_ENDINGS_IN = {
    "fr": ("", "", ", merci de votre compréhension", ". Posez-moi une autre question"), "de": ("", "", ", bitte haben Sie Verständnis", ". Bitte stellen Sie eine andere Frage"),
    "es": ("", "", ", gracias por su comprensión", ". Por favor, haga otra pregunta"), "ru": ("", "", ", прошу понять", ". Задайте, пожалуйста, другой вопрос"),
}
BLANKS = ("", " ", "   ", "\n", "\t\n ", "-", "--", "...", "…", ".", '""', "''", "​", "\xa0", "</s>", "<s></s>", "ASSISTANT:", "?", "()", "[]", "Answer:", "A:")

_SPECIAL = re.compile(r"</?s>|<\|?\w*(?:end|im|eot|pad|bos|eos)\w*\|?>|^\s*(?:user|assistant|human|gpt|question|answer|q|a)\s*[:：]", re.I)
_WORD = re.compile(r"[^\W_]+(?:[’'-][^\W_]+)*")
_TAG = re.compile(r"<[^<>]*>")
_ASKED = {w: code for code, words in LANGUAGE_NAMES.items() for w in words}
_QUOTED = re.compile(r"[\"“«„][^\"”»“]*[\"”»“]")
_LETTER = re.compile(r"\w")
_PAIRED = re.compile(r"[()<\"“”«»]")
_WHOLE = (False,) * 7
_OPENS = re.compile(r"[\"“«„]")
_LID_BITS, _WORD_BITS, _FINAL_BITS = 1 << 14, 1 << 15, 1 << 20
#: Where absent features point: a weight that stays 0.
_NONE = DIMENSIONS


def rounds(samples: DataFrame) -> DataFrame:
    """``sample_id``, ``round_idx``, ``question``, ``answer`` (null without a gpt turn directly after it)."""
    turns = F.coalesce(F.col("conversations"), F.array().cast(samples.schema["conversations"].dataType))

    def pair(turn: Column, at: Column) -> Column:
        after = F.get(F.col("turns"), at + 1)
        return F.struct(turn["sender"].alias("sender"), turn["value"].alias("question"), F.when(after["sender"] == "gpt", after["value"]).alias("answer"))

    asked = F.filter(F.transform("turns", pair), lambda t: t["sender"] == "human")
    return samples.select(F.col("sample_id").cast("long").alias("sample_id"), turns.alias("turns")).select("sample_id", F.posexplode(asked).alias("round_idx", "r")).select("sample_id", "round_idx", F.coalesce("r.question", F.lit("")).alias("question"), F.col("r.answer").alias("answer"))


def _plain(text: str) -> str:
    return _SPECIAL.sub(" ", text) if "<" in text or ":" in text or "：" in text else text


def _words(text: str) -> list[str]:
    """The words of one text; ``Words`` splits many at once into the same."""
    return _WORD.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())


def _bare(text: str) -> str:
    return _TAG.sub(" ", text) if "<" in text else text


def _bins(x: np.ndarray, edges: tuple[float, ...]) -> np.ndarray:
    """How many of the edges each value reaches."""
    return np.searchsorted(np.asarray(edges, float), np.asarray(x, float), side="right")


def _crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _mix(tag: str, *parts: np.ndarray) -> np.ndarray:
    """Hashed feature of a tag and the parts' values, row by row."""
    with np.errstate(over="ignore"):
        h = np.full(len(parts[0]), _crc(tag) * 2 + 1, np.uint64)
        for p in parts:
            h = (h ^ (np.asarray(p).astype(np.int64).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return ((h >> np.uint64(20)) % np.uint64(DIMENSIONS)).astype(np.int64)


class Ragged:
    """Rows of different length as one flat array."""

    def __init__(self, flat: np.ndarray, n: np.ndarray):
        self.flat, self.n = flat, n
        self.first = np.cumsum(n) - n

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of some rows, and for each the number of its row among them."""
        n = self.n[rows]
        of = np.repeat(np.arange(len(rows)), n)
        return self.flat[np.repeat(self.first[rows] - np.cumsum(n) + n, n) + np.arange(len(of))], of

    def part(self, i: int, j: int) -> Ragged:
        """Rows ``i`` to ``j``."""
        first = int(self.n[:i].sum())
        return Ragged(self.flat[first : first + int(self.n[i:j].sum())], self.n[i:j])

    def sub(self, rows: np.ndarray) -> Ragged:
        return Ragged(self.take(rows)[0], self.n[rows])

    def from_end(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k``-th value from the end of each row, and whether there is one."""
        there = self.n >= k
        return np.where(there, self.flat[np.where(there, self.first + self.n - k, 0)] if len(self.flat) else 0, 0), there

    def at(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        there = self.n > k
        return np.where(there, self.flat[np.where(there, self.first + k, 0)] if len(self.flat) else 0, 0), there


def _parts(texts: list[str]) -> Iterator[range]:
    """Neighbouring texts of at most ``LETTERS`` letters together, or one longer one."""
    first, letters = 0, 0
    for i, t in enumerate(texts):
        if i > first and letters + len(t) > LETTERS:
            yield range(first, i)
            first, letters = i, 0
        letters += len(t)
    if first < len(texts):
        yield range(first, len(texts))


def _split(texts: list[str]) -> Iterator[tuple[Words, list[str]]]:
    """Texts without mark-up, split some at a time, and these texts."""
    for at in _parts(texts):
        some = [texts[i] for i in at]
        yield Words([_bare(t) for t in some]), some


def _quantile(counts: np.ndarray, q: float | np.ndarray) -> np.ndarray:
    """Slots that quantiles lie in, from counts per slot."""
    upto = np.cumsum(counts)
    return np.searchsorted(upto, np.floor(np.asarray(q) * (upto[-1] - 1)), side="right")


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of every character: 1 in a word, 2 between two parts of one, else 0; and a random number."""
    kind = np.strings.isalnum(np.arange(sys.maxunicode + 1, dtype=np.uint32).view("U1")).astype(np.uint8)
    kind[[ord(c) for c in "’'-"]] = 2
    return kind, np.random.default_rng(9).integers(0, 1 << 64, len(kind), np.uint64)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64, 2 ** bits of them."""
    base = 0x9E3779B97F4A7C15
    up, down = (np.full(1 << bits, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Words:
    """The words (``_WORD``) of texts, split together: ``rows`` has their numbers, text by text, ``names`` the distinct ones in the order they occur."""

    def __init__(self, texts: list[str]):
        # a mark before and after each text keeps words apart
        low = [f"\n{(t if t.isascii() else unicodedata.normalize('NFC', t)).lower()}\n" for t in texts]
        joined = "".join(low)
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in low], np.int64)
        kinds, numbers = _characters()
        kind = kinds[c]
        inside = kind == 1
        inside[1:-1] |= (kind[1:-1] == 2) & inside[:-2] & inside[2:]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        first, end = edges[::2], edges[1::2]
        at = np.cumsum(size) - size
        of = np.searchsorted(at, first, side="right") - 1
        # the same word has the same 64 bits wherever it stands
        up, down = _powers(max(10, len(c).bit_length()))
        upto = np.cumsum(numbers[c] * up[: len(c)])
        number, _ = pd.factorize((upto[end - 1] - upto[first - 1]) * down[first])
        where = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
        where[number[::-1]] = np.arange(len(number))[::-1]
        self.names = [joined[i:j] for i, j in zip(first[where].tolist(), end[where].tolist(), strict=True)]
        self.rows = Ragged(number.astype(np.int64), np.bincount(of, minlength=len(texts)))
        self._grams_of = c, inside, at, end, size

    def __len__(self) -> int:
        return len(self.rows.n)

    def hashes(self) -> np.ndarray:
        return np.array([_crc(w) for w in self.names], np.int64)

    def grams(self) -> Ragged:
        """Hashed letter trigrams of the words, with one blank before, between and behind them."""
        c, inside, at, end, size = self._grams_of
        kept = inside.copy()
        kept[at] = kept[end] = True
        row = np.repeat(np.arange(len(size), dtype=np.int32), size)[kept]
        c = np.where(inside, c, np.uint32(ord(" ")))[kept]
        if len(c) < 3:
            return Ragged(np.zeros(0, np.int64), np.zeros(len(size), np.int64))
        with np.errstate(over="ignore"):
            h = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1]) * np.uint32(0x85EBCA77) + c[2:]
        same = row[:-2] == row[2:]
        return Ragged(((h >> np.uint32(7)) % np.uint32(_LID_BITS))[same].astype(np.int64), np.bincount(row[:-2][same], minlength=len(size)))


#: Trigrams of texts and the text of each, words by their slots and the text of each, and how many texts there are.
Split = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]


class Languages:
    """Naive Bayes on hashed letter trigrams and words, from counts per language (languages x slots, trigrams before words)."""

    SLOTS = _LID_BITS + _WORD_BITS

    def __init__(self, names: list[str], counts: np.ndarray | None = None):
        self.names = names
        self.typical = np.zeros(max(1, len(names)))
        counts = np.zeros((max(1, len(names)), self.SLOTS)) if counts is None else counts
        grams, words = counts[:, :_LID_BITS] + 0.05, counts[:, _LID_BITS:] + 0.02
        self.grams, self.words = (np.log(x / x.sum(1, keepdims=True)).astype(np.float32).astype(float) for x in (grams, words))

    @staticmethod
    def split(words: Words) -> Split:
        g, rows, each = words.grams(), words.rows, np.arange(len(words))
        return g.flat, np.repeat(each, g.n), (words.hashes() % _WORD_BITS)[rows.flat], np.repeat(each, rows.n), len(words)

    def counted(self, lang: np.ndarray, split: Split, weight: np.ndarray) -> np.ndarray:
        """Counts of texts of known languages, each as often as ``weight`` says."""
        k, (g, row, slot, of, _) = max(1, len(self.names)), split
        grams = np.bincount(lang[row] * _LID_BITS + g, weight[row], k * _LID_BITS).reshape(k, -1)
        words = np.bincount(lang[of] * _WORD_BITS + slot, weight[of], k * _WORD_BITS).reshape(k, -1)
        return np.concatenate([grams, words], axis=1).astype(np.int64)

    def labelled(self, texts: list[str], labels: list[str], checked: bool) -> np.ndarray:
        """Counts of labelled texts; ``checked``: without those whose label the text contradicts."""
        total = np.zeros((max(1, len(self.names)), self.SLOTS), np.int64)
        number = {c: i for i, c in enumerate(self.names)}
        for at in _parts(texts):
            known = [i for i in at if labels[i] in number]
            lang, split = np.array([number[labels[i]] for i in known], np.int64), self.split(Words([_bare(texts[i]) for i in known]))
            total += self.counted(lang, split, (self._sums(split)[3].argmax(1) == lang).astype(float) if checked else np.ones(len(lang)))
        return total

    def sure(self, words: Words, split: Split, n: np.ndarray) -> np.ndarray:
        """Counts of the texts whose language is beyond doubt, each ``n`` times."""
        if len(self.names) < 2:
            return np.zeros((max(1, len(self.names)), self.SLOTS), np.int64)
        score = self._sums(split)[3]
        top = np.sort(score, axis=1)
        return self.counted(score.argmax(1), split, n * ((top[:, -1] - top[:, -2] > 4) & (words.rows.n > 0)))

    def fits(self, texts: Counter[str]) -> np.ndarray:
        """How often each fit occurs: per language among its own texts of some length, and among all texts."""
        k = max(1, len(self.names))
        total = np.zeros((2, k, FIT_STEPS * FIT_REACH), np.int64)
        for words, at in _split(list(texts)):
            n = np.array([texts[t] for t in at], float) * (words.rows.n > 0)
            gram, _, grams, score = self._sums(self.split(words))
            best, step = score.argmax(1), np.clip((gram / np.maximum(1, grams)[:, None] + FIT_REACH) * FIT_STEPS, 0, FIT_STEPS * FIT_REACH - 1).astype(np.int64)
            long = words.rows.n > 3
            for j in range(k):
                mine = long & (best == j)
                total[0, j] += np.bincount(step[mine, j], n[mine], total.shape[2]).astype(np.int64)
                total[1, j] += np.bincount(step[:, j], n, total.shape[2]).astype(np.int64)
        return total

    def settle(self, fits: np.ndarray) -> None:
        """Typical fits: the median among a language's own texts, among all where it has none."""
        for j in range(len(self.names)):
            counts = fits[0, j] if fits[0, j].any() else fits[1, j]
            if counts.any():
                self.typical[j] = (_quantile(counts, 0.5) + 0.5) / FIT_STEPS - FIT_REACH

    def _sums(self, split: Split) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log probability of each text per language by its trigrams and by its words, its trigrams, and the log probability by both, up to a constant."""
        g, row, slot, of, n = split
        by_gram = np.stack([np.bincount(row, lp[g], n) for lp in self.grams], axis=1)
        by_word = np.stack([np.bincount(of, lp[slot], n) for lp in self.words], axis=1)
        return by_gram, by_word, np.bincount(row, minlength=n), by_gram + by_word

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        return self._sums(self.split(Words([" ".join(t) for t in texts])))[3]


_ENDS = ".!?…。"


class Features:
    """Hashed features of rounds for each defect's model, a batch at a time."""

    def __init__(self, languages: Languages, final: np.ndarray):
        self.languages = languages
        last, other = final
        steps = 1 + _bins(last / np.maximum(1, last + other), (0.002, 0.02, 0.1, 0.4, 0.8))
        #: How often each word, by its hash, ends a sound answer, in steps; 0 for words not met twice.
        self.final = np.where(last + other > 1, steps, 0).astype(np.int8)

    def of(self, questions: list[str], answers: list[str | None], hidden: np.ndarray | None = None) -> list[Ragged]:
        """Features of every round per defect; ``hidden``: number of a language that takes no part, per round, or -1."""
        q_number, a_number = {}, {}
        q_row = np.array([q_number.setdefault(q, len(q_number)) for q in questions], np.int64)
        a_row = np.array([a_number.setdefault(a or "", len(a_number)) for a in answers], np.int64)
        rows = len(q_row)
        # each distinct text is split once
        texts = [_plain(a).strip() for a in a_number]
        tagless = [_TAG.sub(" ", t) if "<" in t else t for t in texts]
        # quoted text may be in any language
        quoting = [i for i, t in enumerate(tagless) if _OPENS.search(t)]
        words = Words([_bare(_plain(q)) for q in q_number] + tagless + [_QUOTED.sub(" ", tagless[i]) for i in quoting])
        nq, na = len(q_number), len(a_number)
        qs, as_ = words.rows.part(0, nq), words.rows.part(nq, nq + na)
        size = max(1, len(words.names))
        word = words.hashes() if words.names else np.zeros(1, np.int64)
        finality = self.final[word % _FINAL_BITS].astype(np.int64) if words.names else np.zeros(1, np.int64)
        # the text of an answer that its language is read from, none where it is one word
        own = np.arange(nq, nq + na)
        own[quoting] = np.arange(nq + na, len(words))
        own[as_.n < 2] = -1
        n, qn = as_.n[a_row], qs.n[q_row]
        tags = np.array([len(_TAG.findall(t)) if "<" in t else 0 for t in texts], np.int64)[a_row]
        letters = np.array([bool(_LETTER.search(t)) for t in texts], np.int64)[a_row]

        empty = [_mix("content", np.minimum(n, 2), np.minimum(tags, 1), letters)]

        # words that the answer shares with the question, and those it adds, as multisets
        aw, of = as_.take(a_row)
        a_key, a_count = np.unique(of * size + aw, return_counts=True)
        qw, q_of = qs.take(q_row)
        q_key, q_count = np.unique(q_of * size + qw, return_counts=True)
        at = np.minimum(np.searchsorted(q_key, a_key), max(0, len(q_key) - 1))
        there = np.where(q_key[at] == a_key, q_count[at], 0) if len(q_key) else np.zeros(len(a_key), np.int64)
        row = a_key // size
        repeats = np.maximum(1, -(-n // np.maximum(1, qn)))
        extra = np.bincount(row, np.maximum(0, a_count - there * repeats[row]), rows)
        covered = np.bincount(row, np.minimum(a_count, there), rows)
        cover, fresh = covered / np.maximum(1, qn), np.where(n > 0, extra / np.maximum(1, n), 1.0)

        opens = np.array([t[:1] in "\"“«‘" and t != "" for t in texts], np.int64)
        closes = np.array([t[-1:] in "\"”»’" and t != "" for t in texts], np.int64)
        fixed = np.stack([_mix("cover", _bins(cover, (0.01, 0.15, 0.3, 0.5)), _bins(fresh, (0.3, 0.6, 0.8, 0.95))), _mix("quoted", opens[a_row], closes[a_row]), _mix("tags", np.minimum(tags, 2)), _mix("n", _bins(n, (3, 6, 9, 14, 20, 30)))], axis=1)
        refusal = self._ngrams(as_, word, a_row, fixed)

        q_marks = np.array([q.count("<") for q in q_number], np.int64)[q_row]
        copied = [
            _mix("copy", _bins(extra, (1, 2, 3, 5)), _bins(cover, (0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.999)), _bins(n, (2, 4, 6))), _mix("extra", np.minimum(extra, 4)), _mix("cover", _bins(cover, (0.5, 0.65, 0.8, 0.95))),
            _mix("len", _bins(n / np.maximum(1, qn), (0.3, 0.6, 0.8, 0.95, 1.05, 1.5))), _mix("more", np.minimum(tags, 2) > q_marks),
        ]

        language = self._language(words, word, qs, q_row, own[a_row], n, hidden)

        ends = [t[-1:] for t in texts]
        kind_of = {c: "." for c in _ENDS} | {c: "q" for c in "\"”»’'"} | {c: ")" for c in ")]"} | {">": ">"}
        kinds = [kind_of.get(e, "w" if e.isalnum() else e) for e in ends]
        hashed = {k: _crc(k) for k in {".", *kinds}}
        kind = np.array([hashed[k] for k in kinds], np.int64)[a_row]
        stops = np.array([hashed["." if k in (".", ")", "q") else k] for k in kinds], np.int64)[a_row]
        two = np.array([_crc(t[-2:]) if k not in (".", "w", "") else hashed[k] for t, k in zip(texts, kinds, strict=True)], np.int64)[a_row]
        broken = np.array([self._broken(t) if _PAIRED.search(t) else _WHOLE for t in texts], np.int64).reshape(len(texts), 7)[a_row]
        start = _crc("^")
        value = lambda r, k, end: (lambda x, y: (np.where(y, word[x], start), np.where(y, finality[x], 0), x, y))(*(r.from_end(k) if end else r.at(k)))
        last, last_f, last_id, some = (x[a_row] for x in value(as_, 1, True))
        before, before_f, _, _ = (x[a_row] for x in value(as_, 2, True))
        third, _, _, _ = (x[a_row] for x in value(as_, 3, True))
        first, _, _, _ = (x[a_row] for x in value(as_, 0, False))
        second, _, _, _ = (x[a_row] for x in value(as_, 1, False))
        q1, _, _, _ = (x[q_row] for x in value(qs, 0, False))
        q2, _, _, _ = (x[q_row] for x in value(qs, 1, False))
        key = np.arange(rows) * size + last_id
        found = np.minimum(np.searchsorted(q_key, key), max(0, len(q_key) - 1))
        in_question = some & (q_key[found] == key) if len(q_key) else np.zeros(rows, bool)
        by_n = _bins(n, (1, 2, 3, 5, 8, 12, 16, 24))
        truncated = [
            _mix("end", kind), _mix("broken", *broken.T), *[np.where(broken[:, i] > 0, _mix(f"b{i}", broken[:, i]), _NONE) for i in range(7)],
            _mix("t1", stops, last), _mix("t2", stops, before, last), _mix("t3", stops, third, before, last), _mix("final", stops, last_f), _mix("final2", stops, before_f, last_f),
            _mix("head", q1, q2, stops, last_f), _mix("headn", q1, q2, stops, by_n), _mix("n", stops, by_n), _mix("open", first, stops, _bins(n, (2, 4, 7, 11))), _mix("tagend", tags > 0, stops), _mix("end2", two),
            _mix("new", stops, in_question, last_f), _mix("frame", first, second, stops, np.where(last_f > 3, last, last_f)),
        ]
        grid = lambda columns: Ragged(np.stack(columns, axis=1).ravel(), np.full(rows, len(columns)))
        return [grid(empty), refusal, grid(copied), grid(language), grid(truncated)]

    @staticmethod
    def _broken(t: str) -> tuple[bool, ...]:
        """Marks of a text that lack the other of their pair."""
        return (t.count("(") != t.count(")"), "<" in t and ">" not in t.rsplit("<", 1)[-1], t.count("<Phrase>") != t.count("</Phrase>"), t.count("<Unit>") != t.count("</Unit>"), t.count('"') % 2 == 1, t.count("“") != t.count("”"), t.count("«") != t.count("»"))

    @staticmethod
    def _ngrams(words: Ragged, word: np.ndarray, a_row: np.ndarray, fixed: np.ndarray) -> Ragged:
        """One to three words in a row, begin and end counted as words, and the fixed features."""
        n = words.n + 2
        first = np.cumsum(n) - n
        flat = np.full(int(n.sum()), _crc("^"), np.int64)
        row = np.repeat(np.arange(len(n)), n)
        inner = np.ones(len(flat), bool)
        inner[first] = inner[first + n - 1] = False
        flat[inner] = word[words.flat] if len(words.flat) else 0
        flat[first + n - 1] = _crc("$")
        parts, of = [_mix("r1", flat)], [row]
        for k in (2, 3):
            same = row[: len(row) - k + 1] == row[k - 1 :]
            parts.append(_mix(f"r{k}", *(flat[i : len(flat) - k + 1 + i] for i in range(k)))[same])
            of.append(row[: len(row) - k + 1][same])
        order = np.argsort(np.concatenate(of), kind="stable")
        grams = Ragged(np.concatenate(parts)[order], np.bincount(np.concatenate(of), minlength=len(n)))
        mine, at = grams.take(a_row)
        rows = np.concatenate([at, np.repeat(np.arange(len(a_row)), fixed.shape[1])])
        order = np.argsort(rows, kind="stable")
        return Ragged(np.concatenate([mine, fixed.ravel()])[order], grams.n[a_row] + fixed.shape[1])

    def _language(self, words: Words, word: np.ndarray, qs: Ragged, q_row: np.ndarray, own: np.ndarray, n: np.ndarray, hidden: np.ndarray | None) -> list[np.ndarray]:
        lid = self.languages
        g, flat, each = words.grams(), words.rows.flat, np.arange(len(words))
        sums = lid._sums((g.flat, np.repeat(each, g.n), (word % _WORD_BITS)[flat], np.repeat(each, words.rows.n), len(words)))
        q_score = sums[3][q_row]
        gram, by_word, grams, score = (np.where((own >= 0).reshape(-1, *[1] * (x.ndim - 1)), x[own], 0) for x in sums)
        rows = np.arange(len(own))
        q_lang = q_score.argmax(1)
        if hidden is not None and len(lid.names) > 1:
            masked = np.flatnonzero(hidden >= 0)
            score = score.copy()
            score[masked, hidden[masked]] = -np.inf
        a_lang = score.argmax(1)
        lead = score[rows, a_lang] - score[rows, q_lang]
        word_lead = by_word[rows, a_lang] - by_word[rows, q_lang]
        top = np.sort(q_score, axis=1)
        sure = top[:, -1] - top[:, -2] if len(lid.names) > 1 else np.zeros(len(rows))
        misfit = np.where(grams > 0, lid.typical[q_lang] - gram[rows, q_lang] / np.maximum(1, grams), 0.0)
        codes = lid.names or [""]
        # 0: no language; 1: one without a model, which may look like any of the others; from 2: the languages
        code = np.array([0 if (c := _ASKED.get(w)) is None else 2 + codes.index(c) if c in codes else 1 for w in words.names], np.int64)
        of = np.repeat(np.arange(len(qs.n)), qs.n)
        named = np.zeros((len(qs.n), 2 + len(codes)), bool)
        if len(qs.flat):
            named[of, code[qs.flat]] = True
        asks, asks_other, any_ask = named[q_row, 2:], named[q_row, 1], named[q_row, 1:].any(1)
        asked = asks[rows, a_lang] | asks_other
        long = _bins(n, (2, 3, 5, 8))
        return [
            _mix("lead", _bins(lead, (0.5, 3, 6, 10, 15, 25)), asked, _bins(sure, (3, 8))),
            _mix("words", _bins(word_lead, (0.5, 2, 4, 7)), asked, _bins(lead, (3, 10))),
            _mix("n", long, _bins(lead, (3, 10))),
            _mix("pair", q_lang, a_lang, _bins(lead, (6,)), any_ask),
            _mix("misfit", _bins(misfit, (0.3, 0.7, 1.1, 1.5, 2.0, 2.6)), long, any_ask),
            _mix("misfit2", _bins(misfit, (0.3, 0.7, 1.1, 1.5, 2.0, 2.6)), _bins(lead, (0.5, 6)), asked),
        ]


def _finals(answers: Counter[str], split: tuple[Words, list[str]] | None = None) -> np.ndarray:
    """How often each word, by its hash, is the last of an answer that ends in a full stop, and how often it is not (2 x slots); ``split``: some of the texts, if they are split already."""
    if split is None:
        return sum((_finals(answers, part) for part in _split(list(answers))), np.zeros((2, _FINAL_BITS), np.int64))
    words, texts = split
    rows, n = words.rows, np.array([answers[t] for t in texts], float)
    ends = np.array([t.rstrip()[-1:] in (".", "!", "?") for t in texts], float)
    slot = (words.hashes() % _FINAL_BITS)[rows.flat]
    n = n * (rows.n > 2)
    last = np.zeros(len(slot), bool)
    last[(rows.first + rows.n - 1)[rows.n > 0]] = True
    times = np.repeat(n, rows.n)
    return np.stack([np.bincount(slot[last], (times * np.repeat(ends, rows.n))[last], _FINAL_BITS), np.bincount(slot[~last], times[~last], _FINAL_BITS)]).astype(np.int64)


def _counted(lid: Languages, questions: list[str], answers: list[str | None]) -> np.ndarray:
    """Counts of texts of sure languages, of final words, and of rounds."""
    said, answered = _said(questions, answers), Counter(a for a in answers if a)
    sure, finals = np.zeros((max(1, len(lid.names)), lid.SLOTS), np.int64), np.zeros((2, _FINAL_BITS), np.int64)
    for words, at in _split(list(said)):
        split = lid.split(words)
        sure += lid.sure(words, split, np.array([said[t] for t in at], float))
        finals += _finals(answered, (words, at))
    return np.concatenate([sure.ravel(), finals.ravel(), [len(questions)]])


@cache
def _phrases(bodies: tuple[str, ...], part: int, held: bool) -> tuple[str, ...]:
    """The phrases to learn from, or those held out to test on: every fourth, from ``part``; all where ``part`` is negative."""
    return tuple(b for i, b in enumerate(bodies) if part < 0 or (i % 4 == part % 4) == held)


def _refuse(rng: np.random.Generator, language: str, part: int = -1, held: bool = False) -> str:
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    if language in REFUSALS:
        openings, bodies = REFUSALS[language]
        text = pick(openings) + pick(_phrases(bodies, part, held)) + pick(REFUSAL_ENDINGS_IN[language])
        return text[0].upper() + text[1:] + pick((".", ".", ""))
    opening, body, ending = pick(REFUSAL_OPENINGS), pick(_phrases(REFUSAL_BODIES, part, held)), pick(REFUSAL_ENDINGS)
    if not opening or opening.endswith(". "):
        body = body[0].upper() + body[1:]
    text = opening + body + ending
    return text if text.endswith("?") else text + pick((".", ".", ".", ""))


def _copy(rng: np.random.Generator, q: str) -> str:
    bare = re.sub(r"\s*<image>\s*", " ", q).strip()
    words = bare.split()
    how = int(rng.integers(9))
    if how == 0:
        return q
    if how == 1:
        return bare.upper()
    if how == 2:
        return bare.lower().rstrip("?.! ")
    if how == 3:
        return f"{bare} {bare}"
    if how == 4:
        return f'"{bare}"'
    if how == 5:
        return ("USER: ", "Question: ", "Q: ", "Human: ")[int(rng.integers(4))] + bare
    if how == 6:
        return "  " + "  ".join(words) + "\n"
    if how == 7 and len(words) > 4:
        return " ".join(words[: max(3, int(len(words) * rng.uniform(0.75, 1)))])
    if len(words) > 3:
        for _ in range(1 + int(rng.integers(2)) * (len(words) > 8)):
            words.pop(int(rng.integers(1, len(words))))
    return " ".join(words)


def _cut(rng: np.random.Generator, a: str) -> str | None:
    """A sound answer that stops too early: between words, inside a word, or inside mark-up."""
    a = a.strip()
    spots = [m.start() for m in re.finditer(r"\s+", a)]
    if len(spots) < 3:
        return None
    how = rng.random()
    if how < 0.1 and "<" in a:
        tags = [m for m in _TAG.finditer(a)]
        m = tags[int(rng.integers(len(tags)))]
        return a[: int(rng.integers(m.start() + 1, m.end()))]
    if how < 0.25:
        at = int(rng.integers(len(a) // 4, max(len(a) // 4 + 1, len(a) - 4)))
        return a[:at] if a[at - 1 : at + 1].isalnum() else None
    at = spots[int(rng.integers(1, len(spots)))]
    text = a[:at]
    if text[-1:] in ".!?":
        return None
    return text + (" (", " (", ",", ";", " -", ":")[int(rng.integers(6))] if how > 0.7 else text


class _Model:
    """Logistic regression on hashed features, fitted by AdaGrad."""

    def __init__(self) -> None:
        self.w, self.b, self.threshold, self.share = np.zeros(DIMENSIONS + 1, np.float32), 0.0, float("inf"), PRIOR

    def fit(self, rows: Ragged, use: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int) -> None:
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)
        # features of the same rows have the same weight throughout: one stands for all
        flat, of = rows.take(use)
        there = flat != _NONE
        of, (number, seen) = of[there], pd.factorize(flat[there])
        same = np.zeros(len(seen), np.uint64)
        np.add.at(same, number, np.random.default_rng(11).integers(0, 1 << 64, len(use), np.uint64)[of])
        group, _ = pd.factorize(same)
        size = np.bincount(group).astype(float)
        first = np.zeros(len(seen), bool)
        first[np.unique(group, return_index=True)[1]] = True
        first = first[number]
        mine = Ragged(group[number[first]], np.bincount(of[first], minlength=len(use)))
        w, h, hb, self.b = np.zeros(len(size)), np.full(len(size), 1e-6), 1e-6, 0.0
        mean, bias, counted = np.zeros(len(size)), 0.0, 0
        ends = np.cumsum([len(x) for x in np.array_split(np.arange(len(use)), max(1, len(use) // 256))]).tolist()
        for epoch in range(epochs):
            order = rng.permutation(len(use))
            index, row = mine.take(order)
            many, at = size[index], np.r_[0, np.cumsum(mine.n[order])]
            wanted, weights = y[order], weight[order]
            for i, j in zip([0, *ends], ends, strict=False):
                part = slice(at[i], at[j])
                some, of = index[part], row[part] - i
                z = np.bincount(of, w[some] * many[part], j - i) + self.b
                g = (1 / (1 + np.exp(-np.minimum(np.maximum(z, -30), 30))) - wanted[i:j]) * weights[i:j] / (j - i)
                gw = np.bincount(some, g[of], len(size))
                some = np.flatnonzero(gw != 0)
                before = w[some]
                gw = gw[some] + DECAY * before
                squares = h[some] + gw * gw
                h[some], w[some] = squares, before - RATE * gw / np.sqrt(squares)
                hb += g.sum() ** 2
                self.b -= RATE * g.sum() / np.sqrt(hb)
                # the mean over the steps of the last half varies less than where they end
                if epoch >= epochs // 2 and counted % 8 == 0:
                    mean += w
                    bias += self.b
                counted += epoch >= epochs // 2
        steps = max(1, -(-counted // 8))
        self.w[seen], self.b = (mean / steps)[group].astype(np.float32), bias / steps

    @classmethod
    def mean(cls, sums: np.ndarray) -> _Model | None:
        """The model of all blocks: the mean of each weight, every block counting as often as the feature occurs in it; None where no block has one."""
        weighted, times, (bias, rounds_) = sums[:DIMENSIONS], sums[DIMENSIONS : 2 * DIMENSIONS], sums[2 * DIMENSIONS :]
        if not rounds_:
            return None
        model = cls()
        model.w[:DIMENSIONS] = weighted / np.maximum(1, times) / UNIT
        model.b = float(bias) / float(rounds_) / UNIT
        return model

    def score(self, rows: Ragged) -> np.ndarray:
        of = np.repeat(np.arange(len(rows.n)), rows.n)
        return np.bincount(of, self.w[rows.flat], len(rows.n)) + self.b

    def calibrate(self, rounds_: np.ndarray, good: np.ndarray, bad: np.ndarray) -> None:
        """Share of the defect and the threshold with the best F1, from counts of the scores of rounds as they are, of rounds taken for sound and of made-up defects, none of which the model has seen.

        The share follows from how many rounds reach a score that a known part of the
        made-up defects and of the sound rounds reaches. What a threshold flags is counted
        among the rounds as they are: those taken for sound lack the doubtful ones.
        """
        if not good.any() or not bad.any() or not rounds_.any():
            self.threshold = 0.0
            return
        flagged, wrong, right = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (rounds_, good, bad))
        t = _quantile(bad, 1 - COUNTED)
        self.share = float(np.clip((flagged[t] - wrong[t]) / max(0.1, right[t] - wrong[t]), *SHARES))
        tries = np.unique(_quantile(bad, np.linspace(0, 1, 400)))
        hit = np.minimum(self.share * right[tries], flagged[tries])
        self.threshold = float(tries[np.argmax(2 * hit / (flagged[tries] + self.share))] / STEPS - REACH)


def _steps(scores: np.ndarray) -> np.ndarray:
    """How often each score occurs, in steps."""
    top = 2 * REACH * STEPS
    return np.bincount(np.clip((scores + REACH) * STEPS, 0, top - 1).astype(np.int64), minlength=top)


class _Block:
    """The rounds of a block in a fixed order, and defective ones made of them; the same whenever it is made.

    Rounds are judged by models that have not seen them: what a model was told is sound it
    would call sound. So every other round belongs to the other side, and a fifth of each side is held out.
    """

    #: Sums that ``fitted`` gives per side and defect: weights times counts, counts, the same of the bias.
    SUMS = 2 * DIMENSIONS + 2

    def __init__(self, features: Features, pairs: list[tuple[str, str | None]], seed: tuple[int, int], tested: bool = False):
        """``tested``: defects are made of the rounds held out only; these are the same ones."""
        self.features, self.pairs, self.rng = features, pairs, np.random.default_rng((7, *seed, 3))
        lid, n = features.languages, len(pairs)
        self.side = np.arange(n) % 2
        self.held = np.array([zlib.crc32(f"{i // 2}".encode()) % 5 == 0 for i in range(n)], bool)
        self.usable = np.array([bool(a and _LETTER.search(_plain(a))) for _, a in pairs], bool)
        usable = [np.flatnonzero(self.usable & (self.side == side)) for side in (0, 1)]
        self.made: list[tuple[str, str]] = []
        made: list[tuple[int, int, int, int]] = []
        for held in (True, False)[: 1 if tested else 2]:
            rng = np.random.default_rng((7, *seed, 2 - held))
            mine = np.flatnonzero(self.usable & (self.held == held))
            # of every third round another one of its side, whose answer may take the place of its own
            others = np.array([usable[i % 2][int(rng.integers(len(usable[i % 2])))] if i // 2 % 3 == 1 else i for i in mine.tolist()], np.int64)
            need, at = np.unique(np.concatenate([mine, others]), return_inverse=True)
            asked, said = (Words([_bare(_plain(pairs[i][side] or "")) for i in need]) for side in (0, 1))
            lang, alang = (lid._sums(lid.split(w))[3].argmax(1) for w in (asked, said))
            # of each question, how many words it has and the languages that it names
            q_n, a_n, codes = asked.rows.n, said.rows.n, [_ASKED.get(w) for w in asked.names]
            some = np.flatnonzero(np.array([c is not None for c in codes], bool)[asked.rows.flat])
            named: dict[int, set[str]] = defaultdict(set)
            for x, w in zip((np.searchsorted(asked.rows.first + q_n, some, side="right")).tolist(), asked.rows.flat[some].tolist(), strict=True):
                named[x].add(codes[w])
            for i, j, x, y in zip(mine.tolist(), others.tolist(), at[: len(mine)].tolist(), at[len(mine) :].tolist(), strict=True):
                q, a = pairs[i]
                made_of: dict[str, str | None] = {}
                kind = i // 2 % 3
                if kind == 0:
                    made_of["empty"] = BLANKS[int(rng.integers(len(BLANKS)))]
                    made_of["refusal"] = _refuse(rng, lid.names[lang[x]] if lid.names else "en", 2 * (i % 2), held)
                elif kind == 1:
                    if q_n[x] > 2:
                        made_of["copied"] = _copy(rng, q)
                    names = named.get(x, ())
                    if len(lid.names) > 1 and a_n[y] > 3 and lang[y] == alang[y] != lang[x] and lid.names[alang[y]] not in names:
                        made_of["language"] = pairs[j][1]
                made_of["truncated"] = _cut(rng, a) if kind else None
                for name, text in made_of.items():
                    if text is not None:
                        self.made.append((q, text))
                        swapped = name == "language"
                        # half of the swapped answers are seen as if their language were unknown
                        made.append((i, DEFECTS.index(name), j if swapped else i, int(alang[y]) if swapped and rng.random() < 0.5 else -1))
        #: Of the rounds made up: the round, the defect, the round that the answer is from, the hidden language.
        self.of, self.label, self.other, self.hidden = np.array(made, np.int64).reshape(-1, 4).T

    def _rows(self, made: np.ndarray) -> list[Ragged]:
        """Features of all rounds, and of some made-up ones behind them."""
        rounds_ = self.pairs + [self.made[i] for i in made]
        hidden = np.concatenate([np.full(len(self.pairs), -1), self.hidden[made]])
        parts = [self.features.of([q for q, _ in rounds_[i : i + 4000]], [a for _, a in rounds_[i : i + 4000]], hidden[i : i + 4000]) for i in range(0, len(rounds_), 4000)]
        return [Ragged(np.concatenate([p.flat for p in d]).astype(np.int32), np.concatenate([p.n for p in d])) for d in zip(*parts, strict=True)]

    def fitted(self) -> np.ndarray:
        """A model per side and defect as sums: every weight times the count of its feature, and the counts (``SUMS`` each)."""
        out = np.zeros((2, len(DEFECTS), self.SUMS), np.int64)
        if not self.usable.any():
            return out
        n, rng = len(self.pairs), self.rng
        rows = self._rows(np.arange(len(self.made)))
        label, of = np.concatenate([np.full(n, -1), self.label]), np.concatenate([np.arange(n), self.of])
        other, side, held = np.concatenate([np.arange(n), self.other]), self.side[of], self.held[of]
        sound = self.usable
        for turn in range(CLEANINGS + 1):
            last = turn == CLEANINGS
            high = np.full(n, -np.inf)
            for s in (0, 1):
                mine, unseen = (side == s) & sound[of] & sound[other] & ~held, np.flatnonzero(self.side != s)
                for d in range(len(DEFECTS)):
                    train = np.flatnonzero(mine & ((label == d) | (label == -1) | (rng.random(len(label)) < 0.3)))
                    y = (label[train] == d).astype(float)
                    if not y.any():
                        continue
                    model = _Model()
                    model.fit(rows[d], train, y, rng, EPOCHS if last else EPOCHS // 2)
                    if last:
                        times = np.bincount(rows[d].take(train)[0], minlength=DIMENSIONS + 1)[:DIMENSIONS]
                        out[s, d] = np.concatenate([np.rint(model.w[:DIMENSIONS] * (times * float(UNIT))), times, [round(model.b * len(train) * UNIT), len(train)]])
                    else:
                        high[unseen] = np.maximum(high[unseen], model.score(rows[d].sub(unseen)))
            sound = self.usable & (high < CLEAN_BELOW)
        return out

    def scored(self, sides: list[list[_Model | None]]) -> np.ndarray:
        """Counts of scores per defect: of rounds as they are, of rounds taken for sound and of made-up defects, by models that have not seen them."""
        out = np.zeros((len(DEFECTS), 3, 2 * REACH * STEPS), np.int64)
        n = len(self.pairs)
        rows = self._rows(np.arange(len(self.made)))
        high = np.full(n, -np.inf)
        for s, models in enumerate(sides):
            unseen = np.flatnonzero(self.side != s)
            for d, model in enumerate(models):
                if model is not None:
                    score = model.score(rows[d].sub(unseen))
                    out[d, 0] += _steps(score)
                    high[unseen] = np.maximum(high[unseen], score)
        sound = self.usable & (high < CLEAN_BELOW)
        of, good = self.of, sound & self.held
        bad = sound[of] & sound[self.other]
        for s, models in enumerate(sides):
            for d, model in enumerate(models):
                if model is not None:
                    out[d, 1] += _steps(model.score(rows[d].sub(np.flatnonzero(good & (self.side == s)))))
                    out[d, 2] += _steps(model.score(rows[d].sub(n + np.flatnonzero(bad & (self.side[of] == s) & (self.label == d)))))
        return out


class _Here:
    """Labelled texts and rounds, the rounds as one block, on this machine."""

    def __init__(self, pairs: list[tuple[str, str | None]], labelled: list[tuple[str, str]]):
        self.pairs, self.known, self.n_blocks = pairs, labelled, 1

    @staticmethod
    def blocks_of(n: int) -> int:
        return 1

    def names(self) -> list[tuple[str, int]]:
        return list(Counter(lang for _, lang in self.known).items())

    def labelled(self, step: Callable[[list[str], list[str]], np.ndarray], size: int) -> np.ndarray:
        return step([t for t, _ in self.known], [lang for _, lang in self.known])

    def rounds(self, step: Callable[[list[str], list[str | None]], np.ndarray], size: int) -> np.ndarray:
        return step([q for q, _ in self.pairs], [a for _, a in self.pairs])

    def blocks(self, step: Callable[[list[tuple[str, str | None]], int], np.ndarray], size: int) -> np.ndarray:
        return step(self.pairs, 0)


class _Spread:
    """All labelled texts and rounds where they are: every step gives whole numbers per batch, which are summed in the tasks, then over them."""

    def __init__(self, pairs: DataFrame, labelled: DataFrame | None):
        self.pairs, self.known, self.n_blocks = pairs, labelled, 1

    @staticmethod
    def blocks_of(n: int) -> int:
        return max(1, -(-n // BLOCK))

    def names(self) -> list[tuple[str, int]]:
        return [] if self.known is None else [(r["lang"], r["n"]) for r in self.known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]

    @staticmethod
    def _total(df: DataFrame, each: Callable[[Iterator[pd.DataFrame]], Iterator[np.ndarray]], size: int) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size, np.int64)
            for one in each(batches):
                total += one.ravel()
            some = np.flatnonzero(total)
            for i in range(0, len(some), 100_000):
                yield pd.DataFrame({"slot": some[i : i + 100_000], "n": total[some[i : i + 100_000]]})

        got = df.mapInPandas(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(size, np.int64)
        out[got["slot"].to_numpy()] = got["n"].to_numpy()
        return out

    def labelled(self, step: Callable[[list[str], list[str]], np.ndarray], size: int) -> np.ndarray:
        return self._total(self.known.select("text", "lang"), lambda batches: (step(list(p["text"]), list(p["lang"])) for p in batches), size)

    def rounds(self, step: Callable[[list[str], list[str | None]], np.ndarray], size: int) -> np.ndarray:
        return self._total(self.pairs.select("question", "answer"), lambda batches: (step(list(p["question"]), _texts(p["answer"])) for p in batches), size)

    def blocks(self, step: Callable[[list[tuple[str, str | None]], int], np.ndarray], size: int) -> np.ndarray:
        """Blocks are dealt by the hash of the key and sorted, so they do not depend on partitions; repeated keys count once."""
        n = self.n_blocks
        h = F.xxhash64("sample_id", "round_idx")
        dealt = self.pairs.select(F.pmod(h, F.lit(n)).cast("int").alias("block"), h.alias("h"), "sample_id", "round_idx", "question", "answer")
        tasks = min(n, max(8, 2 * self.pairs.sparkSession.sparkContext.defaultParallelism))
        placed = dealt.repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")).sortWithinPartitions("block", "h", "sample_id", "round_idx", "question", "answer")

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
            block, key, pairs = -1, None, []
            for p in batches:
                for b, k, r, q, a in zip(p["block"].tolist(), p["h"].tolist(), p["round_idx"].tolist(), p["question"], _texts(p["answer"]), strict=True):
                    if b != block:
                        if pairs:
                            yield step(pairs, block)
                        block, key, pairs = b, None, []
                    if (k, r) != key:
                        pairs.append((q, a))
                    key = (k, r)
            if pairs:
                yield step(pairs, block)

        return self._total(placed, each, size)


def _texts(column: pd.Series) -> list[str | None]:
    return [a if isinstance(a, str) else None for a in column]


def _said(questions: list[str], answers: list[str | None]) -> Counter[str]:
    """All texts of rounds that are not empty, and how often each occurs."""
    return Counter(t for texts in (questions, answers) for t in texts if t)


class Detector:
    """The fitted models; small, and sent to the workers as it is."""

    def __init__(self, pairs: list[tuple[str, str | None]], labelled: list[tuple[str, str]] = ()):
        self._learn(_Here(pairs, list(labelled)))

    @classmethod
    def over(cls, pairs: DataFrame, labelled: DataFrame | None = None) -> Detector:
        """Learned from all rounds (``rounds``) and all labelled texts (``text``, ``lang``) of two tables."""
        found = cls.__new__(cls)
        found._learn(_Spread(pairs, labelled))
        return found

    def _learn(self, source: _Here | _Spread) -> None:
        lid = Languages(sorted(lang for lang, n in source.names() if n >= LEAST_TEXTS))
        k, slots = max(1, len(lid.names)), lid.SLOTS
        counts = np.zeros((k, slots), np.int64)
        if lid.names:
            for checked in (False, True):
                counts = source.labelled(lambda texts, labels, lid=lid, checked=checked: lid.labelled(texts, labels, checked), k * slots).reshape(k, slots)
                lid = Languages(lid.names, counts)
        got = source.rounds(lambda qs, as_, lid=lid: _counted(lid, qs, as_), k * slots + 2 * _FINAL_BITS + 1)
        source.n_blocks = source.blocks_of(int(got[-1]))
        if lid.names:
            lid = Languages(lid.names, counts + got[: k * slots].reshape(k, slots))
            lid.settle(source.rounds(lambda qs, as_, lid=lid: lid.fits(_said(qs, as_)), 2 * k * FIT_STEPS * FIT_REACH).reshape(2, k, -1))
        features = self.features = Features(lid, got[k * slots : -1].reshape(2, _FINAL_BITS))
        self.models = [_Model() for _ in DEFECTS]
        # without a sound round to learn from, an answer without content is still empty; nothing else is known
        self.models[0].w[self.features.of([""], [""])[0].flat] = 1.0
        self.models[0].threshold = 0.5
        if not got[-1]:
            return
        draws = -(-DRAWS // source.n_blocks)
        sums = source.blocks(lambda pairs, block: sum(_Block(features, pairs, (block, i)).fitted() for i in range(draws)), 2 * len(DEFECTS) * _Block.SUMS).reshape(2, len(DEFECTS), -1)
        sides = [[_Model.mean(x) for x in side] for side in sums]
        scores = source.blocks(lambda pairs, block: sum(_Block(features, pairs, (block, i), True).scored(sides) for i in range(draws)), len(DEFECTS) * 6 * REACH * STEPS).reshape(len(DEFECTS), 3, -1)
        for d, both in enumerate(zip(*sides, strict=True)):
            found = [m for m in both if m is not None]
            if found:
                model = self.models[d]
                model.w, model.b = np.mean([m.w for m in found], axis=0), float(np.mean([m.b for m in found]))
                model.calibrate(*scores[d])

    def beyond(self, questions: list[str], answers: list[str | None]) -> np.ndarray:
        """How far each round lies beyond the threshold of each defect (rounds x defects)."""
        if not questions:
            return np.zeros((0, len(DEFECTS)))
        rows = self.features.of(questions, answers)
        over = np.stack([m.score(r) - m.threshold for m, r in zip(self.models, rows, strict=True)], axis=1)
        over[:, 0] = np.where(over[:, 0] > 0, np.inf, over[:, 0])  # nothing else can be said of an empty answer
        return over

    def predict(self, questions: list[str], answers: list[str | None]) -> list[str | None]:
        over = self.beyond(questions, answers)
        return [DEFECTS[k] if row[k] > 0 else None for row, k in zip(over, over.argmax(1), strict=True)]


def labelled(documents: DataFrame) -> DataFrame:
    """``text`` and ``lang``, the two letters of its language label however it is spelled, of all documents that have one."""
    lang = F.substring(F.trim(F.lower("lang")), 1, 2)
    return documents.where("doc_id is not null and text is not null").where(lang.rlike("^[a-z]{2}$")).select("text", lang.alias("lang"))


def labelled_texts(documents: DataFrame) -> list[tuple[str, str]]:
    """The labelled texts of a table small enough for the driver, for a ``Detector`` made there."""
    return [(r["text"], r["lang"]) for r in labelled(documents).collect()]


def fit_detector(pairs: DataFrame, documents: DataFrame | None = None) -> Detector:
    """Fit on all rounds and all labelled texts."""
    return Detector.over(pairs, labelled(documents) if documents is not None else None)


def round_defects(samples: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``sample_id``, ``round_idx``, ``defect`` and ``defects`` (all, the furthest beyond its threshold first) of every round whose answer is not usable.

    ``samples`` needs ``sample_id`` and ``conversations`` (array of ``sender``, ``value``);
    ``documents`` (``doc_id``, ``text``, ``lang``) is what the languages are learned from.
    """
    pairs = rounds(samples)
    detector = fit_detector(pairs, documents)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            over = detector.beyond(list(pdf["question"]), _texts(pdf["answer"]))
            found = over.max(1, initial=-1) > 0
            order = np.argsort(-over[found], axis=1, kind="stable")
            names = [[DEFECTS[k] for k in ks if row[k] > 0 and (row[0] <= 0 or k == 0)] for row, ks in zip(over[found], order, strict=True)]
            if names:
                yield pdf.loc[found, ["sample_id", "round_idx"]].assign(defect=[x[0] for x in names], defects=names)

    return pairs.mapInPandas(run, "sample_id long, round_idx int, defect string, defects array<string>").dropDuplicates(["sample_id", "round_idx"])


def defective_rounds(samples: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``sample_id``, ``round_idx``, ``defect`` of ``round_defects``."""
    return round_defects(samples, documents).drop("defects")
