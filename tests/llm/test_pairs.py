import os

import numpy as np
import pytest

from annospark.llm import pairs as P

DATA = os.environ.get("ANNOSPARK_TESTDATA_PAIRS", "/root/testdata/sf0.01")
CONV = "array<struct<sender:string,value:string>>"


def test_rounds(spark):
    rows = [
        (1, [("human", "a"), ("gpt", "b"), ("human", "c")]),
        (2, [("gpt", "x"), ("human", "a"), ("human", "b"), ("gpt", "c")]),
        (3, None), (4, []), (5, [None, ("human", None), ("gpt", None)]), (6, [("human", "a"), None, ("gpt", "b")]),
    ]
    df = spark.createDataFrame(rows, f"sample_id long, conversations {CONV}")
    got = {(r.sample_id, r.round_idx, r.question, r.answer) for r in P.rounds(df).collect()}
    assert got == {(1, 0, "a", "b"), (1, 1, "c", None), (2, 0, "a", None), (2, 1, "b", "c"), (5, 0, "", None), (6, 0, "a", None)}


@pytest.fixture(scope="module")
def detector(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    pairs = P.rounds(spark.read.parquet(f"{DATA}/samples.parquet")).orderBy("sample_id", "round_idx").collect()
    train = [(r.question, r.answer) for r in pairs if r.sample_id % 5]
    held = [(r.question, r.answer) for r in pairs if r.sample_id % 5 == 0]
    return P.Detector(train, P.labelled_texts(spark.read.parquet(f"{DATA}/documents.parquet"))), held


def test_held_out_accuracy(detector):
    d, held = detector
    flags = d.predict([q for q, _ in held], [a for _, a in held])
    sound = [p for p, f in zip(held, flags, strict=True) if f is None]
    assert len(sound) > 0.85 * len(held)
    rng = np.random.default_rng(3)
    lid = d.features.languages
    lang = lid.scores([P._words(q) for q, _ in sound]).argmax(1)
    for name, make in {
        "refusal": lambda i: P._refuse(rng, lid.names[lang[i]]),
        "copied": lambda i: P._copy(rng, sound[i][0]),
        "truncated": lambda i: P._cut(rng, sound[i][1]),
        "empty": lambda i: P.BLANKS[i % len(P.BLANKS)],
    }.items():
        made = [(sound[i][0], make(i)) for i in range(len(sound))]
        made = [m for m in made if m[1] is not None]
        got = d.predict([q for q, _ in made], [a for _, a in made])
        assert np.mean([g == name for g in got]) > (0.8 if name == "truncated" else 0.96), name


def test_known_cases(detector):
    d, _ = detector
    cases = [
        ("What is happening in the orchard?", None, "empty"), ("What is happening in the orchard?", "\u200b", "empty"), ("What is happening in the orchard?", "ASSISTANT:", "empty"),
        ("Where is the fern in relation to the scooter?", "I'm sorry, but I cannot help with that.", "refusal"), ("Was geschieht im Hof?", "Leider kann ich diese Frage nicht beantworten.", "refusal"),
        ("Where is the fern in relation to the scooter?", "where is the fern in relation to the scooter", "copied"), ("Describe the image<image> in detail.", '"Describe the image in detail."', "copied"),
        ("Where is the fern in relation to the scooter?", "Кто-то переносит ржавый якорь, пока рядом убирают зелёный автобус.", "language"),
        ("Please find the jug and give its box.", "<boxes>", None), ("Which colour does the fern have?", "grey", None), ("Which words are written on the board?", '"Sorry, we cannot serve you today"', None), ("How would the sentence on the ivory board read in French?", "L’objet au bord de la chaussée est surtout gris, avec un bord blanc cassé.", None),
    ]
    got = d.predict([q for q, _, _ in cases], [a for _, a, _ in cases])
    assert got == [w for _, _, w in cases]


def test_query_form(spark, detector):
    rows = [(1, [("human", "What is it?"), ("gpt", "")], 9), (1, [("human", "What is it?"), ("gpt", "")], 9), (2, [("human", "x" * 100_000), ("gpt", "y " * 50_000)], 9), (3, None, 9)]
    df = spark.createDataFrame(rows, f"sample_id long, conversations {CONV}, defect int")
    got = P.defective_rounds(df).collect()
    assert [(r.sample_id, r.round_idx, r.defect) for r in got if r.sample_id == 1] == [(1, 0, "empty")]
    assert P.defective_rounds(df.limit(0)).count() == 0


def test_refusals_in_words_never_seen(spark, monkeypatch):
    """Every third phrase is held out: the model is fitted without it and has to find it."""
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    pairs = [(r.question, r.answer) for r in P.rounds(spark.read.parquet(f"{DATA}/samples.parquet")).orderBy("sample_id", "round_idx").limit(2500).collect()]
    bodies = P.REFUSAL_BODIES
    monkeypatch.setattr(P, "REFUSAL_BODIES", tuple(b for i, b in enumerate(bodies) if i % 3))
    d = P.Detector(pairs, P.labelled_texts(spark.read.parquet(f"{DATA}/documents.parquet")))
    unseen = [b[0].upper() + b[1:] + "." for i, b in enumerate(bodies) if i % 3 == 0]
    got = d.predict(["What is happening in the orchard?"] * len(unseen), unseen)
    assert np.mean([g == "refusal" for g in got]) >= 0.7
    sound = d.predict(["What is happening in the orchard?"] * 2, ["A baker repairs the red bicycle.", "It cannot be told from the picture, but it may be a bakery."])
    assert sound[0] is None


def test_languages_without_a_model(detector):
    d, _ = detector
    answers = ["Sul tavolo c'è una tazza rossa vicino alla finestra della cucina.", "Op de tafel staat een rode kop naast het raam van de keuken.", "Na stole stoi czerwony kubek obok okna w kuchni."]
    assert d.predict(["What is on the table?"] * 3, answers) == ["language"] * 3
    assert d.predict(["Please answer in Italian: what is on the table?"], answers[:1]) == [None]


def test_without_labelled_texts_there_is_no_language_defect():
    pairs = [(f"What is the colour of the {w} in the yard?", f"The {w} in the yard is mostly green and old.") for w in ("cat", "dog", "bus", "cup", "hat")] * 40
    d = P.Detector(pairs)
    assert d.predict(["What is the colour of the cat in the yard?"], ["El gato en el patio es verde y viejo."]) != ["language"]


def test_all_defects_of_a_round(spark, detector):
    d, _ = detector
    over = d.beyond(["Where is the fern?", "Where is the fern?"], [None, "The fern is next to the scooter."])
    assert np.isinf(over[0, 0]) and (over[1] < 0).all() and d.beyond([], []).shape == (0, 5)


def test_all_rounds_and_texts_take_part_however_they_lie(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 150)
    things = [f"thing{i}" for i in range(7)] + ["cat", "dog", "bus", "cup", "hat"]
    rows = [(i, [("human", f"What is the colour of the {things[i % 12]} in yard {i}?"), ("gpt", f"The {things[i % 12]} in the yard is mostly green and old{i}.")]) for i in range(600)]
    docs = [(i, "the cat and the dog are in the old yard", "en") for i in range(4000)] + [(5000 + i, "il gatto e il cane sono nel vecchio cortile", "it") for i in range(P.LEAST_TEXTS)]
    texts = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = [P.fit_detector(P.rounds(spark.createDataFrame(rows, f"sample_id long, conversations {CONV}").repartition(n)), texts.repartition(n)) for n in (1, 5)]
    # a language with just enough texts among all; no word that ends an answer is missed
    assert all(d.features.languages.names == ["en", "it"] for d in found)
    brute = P._finals(P.Counter(r[1][1][1] for r in rows))
    assert np.array_equal(found[1].features.final, P.Features(found[1].features.languages, brute).final)
    for a, b in zip(found[0].models, found[1].models, strict=True):
        assert np.array_equal(a.w, b.w) and a.b == b.b and a.threshold == b.threshold
    assert found[0].predict(["What is the colour of the cat?"] * 2, ["The cat in the yard is mostly green and old.", "-"]) == [None, "empty"]
    # four blocks: their models are not those of one
    assert not np.array_equal(found[0].models[4].w, P.Detector([(r[1][0][1], r[1][1][1]) for r in rows], P.labelled_texts(texts)).models[4].w)


def test_words_split_together_are_those_of_each_text():
    rng = np.random.default_rng(3)
    letters = list("aaabcxyzÀéÉßİΣσςЖжé中١²ⅷ_-–'’\"“.,!?  \n\t<>\xa0\u200b😀") + ["e\u0301", "\ud800", "naïve-Word", "d’Été"]
    texts = ["", "-", "a", "\n", "x" * 5000, *("".join(rng.choice(letters, int(rng.integers(30)))) for _ in range(3000))]
    split = P.Words(texts)
    assert [[split.names[k] for k in split.rows.take(np.array([i]))[0]] for i in range(len(texts))] == [P._words(t) for t in texts]
    assert len(set(split.names)) == len(split.names) and len(P.Words([]).names) == len(P.Words(["", "-"]).names) == 0
    grams = split.grams()
    for i, t in enumerate(texts):
        assert grams.take(np.array([i]))[0].tolist() == P.Words([" ".join(P._words(t))]).grams().flat.tolist(), t


def test_fit_is_that_of_every_feature_by_itself():
    rng = np.random.default_rng(8)
    n, d, lengths = 700, 40, rng.integers(0, 9, 700)
    flat = rng.choice([P._NONE, *range(d)], int(lengths.sum()), p=[0.3, *np.full(d, 0.7 / d)])
    # some features are in the same rows
    flat = np.concatenate([flat.reshape(-1, 1), np.where(flat == 3, 1003, P._NONE).reshape(-1, 1), np.where(flat == 3, 2003, P._NONE).reshape(-1, 1)], axis=1).ravel()
    rows, use = P.Ragged(flat, 3 * lengths), rng.permutation(n)[:600]
    y = (rng.random(600) < 0.3).astype(float)
    model = P._Model()
    model.fit(rows, use, y, np.random.default_rng(2), 4)
    x, again = np.zeros((600, 2004)), np.random.default_rng(2)
    for i, r in enumerate(use):
        for f in rows.take(np.array([r]))[0]:
            if f != P._NONE:
                x[i, f] += 1
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y <= 0).sum()) * 600
    w, h, b, hb, mean, bias, steps = np.zeros(2004), np.full(2004, 1e-6), 0.0, 1e-6, np.zeros(2004), 0.0, 0
    for epoch in range(4):
        for k, part in enumerate(np.array_split(again.permutation(600), 2)):
            g = (1 / (1 + np.exp(-(x[part] @ w + b))) - y[part]) * weight[part] / len(part)
            gw = x[part].T @ g
            gw = np.where(gw != 0, gw + P.DECAY * w, 0)
            h += gw * gw
            w -= P.RATE * gw / np.sqrt(h)
            hb += g.sum() ** 2
            b -= P.RATE * g.sum() / np.sqrt(hb)
            if epoch == 2 and k == 0:
                mean, bias, steps = mean + w, bias + b, steps + 1
    assert np.allclose(model.w[:2004], mean / steps, atol=1e-6) and abs(model.b - bias / steps) < 1e-6 and not model.w[P._NONE]
