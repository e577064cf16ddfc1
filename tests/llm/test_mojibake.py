import pytest

from annospark.llm import mojibake as M

SENTENCES = {
    "fr": "Après la relecture, une fenêtre étroite fut ajoutée devant la pâtisserie, à côté du théâtre fermé où l’été déjà s’achève.",
    "de": "Später wurde für die Prüfung ein größeres Gefäß neben dem Gewächshaus über der Tür ergänzt, während schöne Kürbisse übrig blieben.",
    "es": "La máscara cubre una puerta pequeña y también un balcón angosto detrás del jardín; según la revisión, se añadió un camión.",
    "ru": "На снимке виден глиняный кувшин между деревьями, а также пустое ведро рядом с теплицей и большой колокол.",
    "en": "A courier drags a crate marked with the café’s name — mostly patched — “beside” the canal at 40 °C.",
}
CLEAN = [s + f" Bild {i}." for i in range(40) for s in SENTENCES.values()] + [
    "The letter Ã and the letter Ø are painted on the snail.", "The title «MÃE E FILHû stands above it.", "The road sign names the river “RÂUL ALB” here.", "caf&eacute; and Stra&szlig;e", "One label holds the escape \\u00e9 after it.", "About 12 % of the Łódź pictures show smörgåsbord.", "naïve piñata £88 § 65 ±3 µm", "Þór fór út á ísinn"
] * 3


def damaged(text, true, read):
    return "".join(M._byte_char(b, read) for b in text.encode(true, "ignore"))


CASES = [("utf-8", r, lang) for r in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251") for lang in SENTENCES] + [
    ("cp1252", "mac_roman", "es"), ("cp1252", "cp437", "de"), ("cp1252", "cp850", "fr"), ("cp1252", "cp1251", "fr"), ("cp1251", "cp1252", "ru"), ("cp1251", "cp866", "ru"), ("koi8_r", "cp1251", "ru"), ("cp866", "cp1251", "ru"), ("koi8_r", "cp1252", "ru")
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "x") for i, t in enumerate(CLEAN)]
    rows += [(1000 + i, "Before. " + damaged(SENTENCES[lang], a, b) + " After.", "x") for i, (a, b, lang) in enumerate(CASES)]
    rows += [(2000, damaged(damaged(SENTENCES["de"], "utf-8", "cp1252"), "utf-8", "cp1252"), "x"), (2001, "A ch�teau", "x"), (2002, None, "x"), (2003, "", "x"), (2004, "   ", "x"), (2005, "x" * 200_000, "x"), (2006, "é" * 50_000, "x"), (2007, "word " * 40_000 + "PurÃ©e", "x"), (2007, "word " * 40_000 + "PurÃ©e", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored string").repartition(3)
    return M.garbled_documents(df).collect()


def test_clean_texts_are_left_alone(found):
    assert not [r for r in found if r.doc_id < 1000]


def test_damage_is_found_and_restored(found):
    by = {r.doc_id: r for r in found}
    for i, (a, b, lang) in enumerate(CASES):
        r = by[1000 + i]
        want = "Before. " + SENTENCES[lang].encode(a, "ignore").decode(a) + " After."
        assert r.restored == want, (a, b, lang, r.restored)
        assert r.complete


def test_edges(found):
    by = {r.doc_id: r for r in found}
    assert by[2000].restored == SENTENCES["de"]
    assert not by[2001].complete and by[2001].encodings == ["lost"]
    assert not {2002, 2003, 2004, 2005, 2006} & set(by)
    assert sum(r.doc_id == 2007 for r in found) == 2 and by[2007].restored.endswith("Purée")


def test_empty_table(spark):
    assert M.garbled_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_small_corpus(spark):
    df = spark.createDataFrame([(1, "The cafÃ© is open."), *[(2 + i, t) for i, t in enumerate(SENTENCES.values())]], "doc_id long, text string")
    assert [r.doc_id for r in M.garbled_documents(df).collect()] == [1]
