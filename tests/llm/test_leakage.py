import random

import numpy as np
import pytest

from annospark.llm import leakage as L

RNG = random.Random(5)
WORDS = [a + b for a in ("ba", "co", "di", "fu", "ge", "ho", "ka", "lu", "mi", "no", "pe", "ra", "so", "ti", "vu") for b in ("lor", "mint", "ster", "gan", "pel", "dran", "fi", "quet", "zo", "wick")]
SHARED = "Look at the picture with care and reply in a short phrase or one complete sentence of your own."


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n)).capitalize() + "."


ITEMS = [(k, f"Which {sentence(18)[:-1]}?", ("" if k % 3 else SHARED + " ") + sentence(30) + " " + sentence(30), f"a {WORDS[k]} {WORDS[k + 40]}") for k in range(12)]


def build():
    docs, want = {}, set()
    noise = lambda: sentence(60)

    def put(doc, text, *items):
        docs[doc] = text
        want.update((doc, i) for i in items)

    words = lambda k: ITEMS[k][2].split()
    own = lambda k: words(k)[len(SHARED.split()) if k % 3 == 0 else 0 :]
    put(1, noise() + " " + ITEMS[1][2] + " " + noise(), 1)
    put(2, noise() + ITEMS[2][2].upper().replace(" ", "  \n") + noise(), 2)
    put(3, noise() + " " + " ".join(own(3)[10:34]) + " " + noise(), 3)
    put(4, noise() + " " + " ".join(own(4)[5:17]) + " " + noise())  # twelve words
    put(5, noise() + " " + SHARED + " " + noise())  # the shared sentence
    cut = own(6)
    put(6, " ".join(cut[:25]) + " [continued on page 9 of the report, see there] " + " ".join(cut[25:]), 6)
    few = own(7).copy()
    for at in (6, 19, 33, 47):
        few[at] = "changed"
    put(7, noise() + " " + " ".join(few), 7)
    less = [w for i, w in enumerate(own(8)) if i not in (9, 22, 40)]
    put(8, " ".join(less) + noise(), 8)
    put(9, noise() + " Q: " + ITEMS[9][1] + " A: " + ITEMS[9][3] + ". " + noise(), 9)
    put(10, noise() + " Q: " + ITEMS[10][1] + " " + noise() + noise())  # no answer
    put(11, ITEMS[11][2] + "\n" + ITEMS[1][2], 11, 1)
    put(12, "<p>" + " </b> <b>".join(own(2)) + "</p>", 2)
    put(13, noise() * 400 + " " + ITEMS[5][2] + noise() * 50, 5)
    put(14, "")
    put(15, None)
    put(16, "short")
    put(17, noise() + " ".join(own(4)[5:14]) + noise() + " ".join(own(4)[30:39]) + noise())  # two short quotes
    put(18, noise() + " ".join(own(10)[0:19]) + " " + noise())  # nineteen words
    put(19, noise() + " ".join(own(10)[0:21]) + " " + noise(), 10)
    return docs, want


@pytest.fixture(scope="module")
def frames(spark):
    docs, want = build()
    d = spark.createDataFrame([(k, v, k) for k, v in docs.items()], "doc_id long, text string, item_id long").repartition(3)
    i = spark.createDataFrame([*ITEMS, (90, None, None, None), (91, "", " ", "x"), (None, "q", "p", "a")], "item_id long, question string, passage string, answer string")
    return d, i, want


def test_found(frames):
    d, i, want = frames
    assert {(r.doc_id, r.item_id) for r in L.leaked_items(d, i).collect()} == want


def test_blocks_give_the_same(frames, monkeypatch):
    d, i, want = frames
    monkeypatch.setattr(L, "ITEM_BYTES", 1200)
    assert {(r.doc_id, r.item_id) for r in L.leaked_items(d, i).collect()} == want


def test_empty(spark, frames):
    d, i, _ = frames
    assert L.leaked_items(d.limit(0), i).count() == 0 and L.leaked_items(d, i.limit(0)).count() == 0


def test_gram_hashes():
    s = np.arange(1, 60, dtype=np.uint64)
    g = L._grams(s)
    assert len(g) == 60 - L.Q and len(set(g.tolist())) == len(g) and (L._grams(s[7:])[:5] == g[7:12]).all()
    assert len(L._grams(s[: L.Q - 1])) == 0


def test_exact_passages_against_brute_force(spark):
    docs = [(k, " ".join(RNG.choice(WORDS) for _ in range(80)) + (" " + ITEMS[k % 12][2] if k % 4 == 0 else "")) for k in range(80)]
    want = {(k, i) for k, t in docs for i, _, p, _ in ITEMS if p in t}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(ITEMS, "item_id long, question string, passage string, answer string")
    assert {(r.doc_id, r.item_id) for r in L.leaked_items(d, i).collect()} == want


def test_shared_sentences_are_counted_over_all_blocks(spark, monkeypatch):
    stock = sentence(25)
    items = [(k, None, f"{stock} {sentence(24)}", None) for k in range(12)]
    d = spark.createDataFrame([(1, sentence(40) + " " + stock + " " + sentence(40)), (2, items[3][2])], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, question string, passage string, answer string")
    for size in (8 << 20, 1500):
        monkeypatch.setattr(L, "ITEM_BYTES", size)
        assert {(r.doc_id, r.item_id) for r in L.leaked_items(d, i).collect()} == {(2, 3)}


def test_texts_handled_together_do_not_matter():
    docs, want = build()
    index = L.Index([(*x, [0] if x[0] % 3 == 0 else []) for x in ITEMS])
    texts = [(k, L._TAG.sub(" ", v)) for k, v in docs.items() if v]
    alone = {(k, i) for k, v in texts for _, i in L._in_texts(index, L._symbols(), [v])}
    together = {(texts[d][0], i) for d, i in L._in_texts(index, L._symbols(), [v for _, v in texts])}
    assert alone == together == want


def test_short_parts(spark):
    i = spark.createDataFrame([(1, None, "Zebra on ice", None), (2, "Who is it?", None, "Ada"), (3, None, "A kite above the pier.", None)], "item_id long, question string, passage string, answer string")
    d = spark.createDataFrame([(1, "see: zebra ON ice"), (2, "zebra"), (3, "Who is it? - Ada"), (4, "Who is it?"), (5, "x a kite, above the pier"), (6, "kite")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in L.leaked_items(d, i).collect()} == {(1, 1), (3, 2), (5, 3)}


@pytest.mark.parametrize(("share", "least"), [(0.05, 1.0), (0.1, 0.99), (0.15, 0.97)])
def test_recall_with_changed_words(share, least):
    """Passages of 40 words with a share of them changed, at random places."""
    rng = random.Random(int(share * 100))
    passages = [" ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(40)) for _ in range(200)]
    index = L.Index([(k, None, p, None, None) for k, p in enumerate(passages)])
    changed = []
    for p in passages:
        w = p.split()
        for at in rng.sample(range(40), round(40 * share)):
            w[at] = "changed" + rng.choice("xyz")
        changed.append(f"{sentence(30)} {' '.join(w)} {sentence(30)}")
    found = {(d, i) for d, i in L._in_texts(index, L._symbols(), changed) if d == i}
    assert len(found) >= least * 200
