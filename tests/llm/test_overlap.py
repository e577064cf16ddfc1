import itertools

import pandas as pd
import pytest

from annospark.llm import overlap as O

SAME = {
    "102352": ["000000102352.jpg", "set_a/000000102352.jpg", "GRV_train2021_102352", "val_102352.webp", "old\\img\\000000102352 (1).jpg", "000000102352_640x480.jpg#t", "test-000000102352.jpg.jpg", "C:\\x\\000000102352@2x.png", "000000102352-1024w.jpg", "train2021/000000102352~1.png"],
    "terrace 168": ["terrace_00000168.jpg", "TERRACE__00000168.JPG", "Terrace-00000168_kopie.png", "export/batch_07/terrace 00000168 - Copy.jpg", "grv_test2022_terrace_00000168_w800.jpg", "train__terrace_00000168-copy2.min.jpg"],
    "ile au phare 4651": ["Île au phare 0004651.jpg", "%C3%8Ele%20au%20phare%200004651_thumb.jpg?v=3", "ILE_AU_PHARE_0004651(copy).jpeg", "I\u0302le-au-phare-0004651-scaled.jpg"],
    "clip 385 f 26": ["clip0000385_f00026.png", "Clip0000385  F00026_dup.png", "clip0000385-f00026.webp"],
    "scan 3 r 2 c 1": ["scan_0000003_r02_c01.tif", "mirror//b/SCAN_0000003_R02_C01_resized.jpg"],
    "43a190e257db0ea9": ["43a190e257db0ea9.jpg", "43A190E257DB0EA9_copy.PNG", "test-43a190e257db0ea9"],
    "coco 12": ["coco_0012.jpg", "coco_final_0012.jpg", "COCO_train2014_000000000012.jpg"],
}
OTHER = ["terrace_00000169.jpg", "workshop_00000168.jpg", "clip0000385_f00027.png", "clip0000386_f00026.png", "scan_0000003_r02_c02.tif", "43a190e257db0ea8.jpg", "000000102353.jpg", "Old pier 0004651.jpg", "", "   ", ".jpg", "photo", "vg_copy_12.jpg", "vg_copy_77.jpg", "photo (3).jpg", "photo (4).jpg", "scan_0000253.tif", "scan_0000253_r02_c03.tif", "h123.jpg", "h124.jpg"]
AFFIXES = O.USUAL | {"grv"}


def core(name, affixes=AFFIXES):
    text = O.name_text(name)
    return None if text is None else O.core_text(text, affixes)


def test_core():
    for key, names in SAME.items():
        for n in names:
            assert core(n) == key, n
    cores = [core(n) for n in OTHER]
    known = [c for c in cores if c]
    assert len(set(known)) == len(known) == len(OTHER) - 3 and not set(known) & set(SAME)
    assert O.name_text(None) is None


def test_core_is_one_span_of_the_suffix_text():
    for n in [*itertools.chain(*SAME.values()), *OTHER]:
        text = O.name_text(n)
        if text:
            tokens, at, k = O.core_of(text, AFFIXES)
            assert k > 0 and " ".join(tokens[at : at + k]) == core(n)


def rows():
    out, k = [], 0
    for i, names in enumerate([*SAME.values(), *[[n] for n in OTHER]]):
        for j, n in enumerate(names):
            out.append((k, n, ("train", "val", "testb", None, "train", "dev")[(i + j) % 6], f"s{j % 3}"))
            k += 1
    # enough names for the unknown word to be seen with and without
    out += [(800 + 2 * j + s, f"GRV_{100 + j}.jpg" if s else f"{100 + j}.png", "train" if s else "val", "g") for j in range(8) for s in (0, 1)]
    return out + [(500 + j, "scan_0000009_r01_c01.tif", "train" if j % 2 else "test", "s") for j in range(60)] + [(700, None, "train", "s")]


@pytest.fixture(scope="module")
def frames(spark):
    r = rows()
    images = spark.createDataFrame([(a, b, c, d, a) for a, b, c, d in r if a % 2] + [(1, r[1][1], r[1][2], r[1][3], 1)], "image_id long, file_name string, split string, source string, rec long")
    samples = spark.createDataFrame([(a, (b, 1, 1) if b is not None else None, c, d) for a, b, c, d in r if a % 2 == 0], "sample_id long, image struct<path:string,width:int,height:int>, split string, source string")
    return images, samples


def wanted():
    r = {a: (core(b), c) for a, b, c, _ in rows() if b is not None}
    return {(min(a, b), max(a, b)) for a, (i, s) in r.items() if s == "train" for b, (j, t) in r.items() if t in O.EVALUATION and i is not None and i == j}


@pytest.mark.parametrize("n", [1, 5])
def test_pairs_against_brute_force(spark, frames, n, monkeypatch):
    monkeypatch.setattr(O, "TRAIN_ROWS", 7)
    spark.conf.set("spark.sql.shuffle.partitions", n)
    got = [(x.rec_a, x.rec_b) for x in O.overlaps(*frames).collect()]
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == len(set(got)) and set(got) == wanted()


def test_affixes_are_learned(frames):
    texts = O.parsed_records(*frames).select("text").distinct()
    found = O.learned_affixes(texts)
    assert "grv" in found and not found & {"terrace", "scan", "r", "c", "f", "clip", "ile", "phare", "coco"}


def test_evidence_overrules_usual_words(spark):
    texts = spark.createDataFrame([(f"original {k}",) for k in range(400)] + [(f"pier {k} thumb",) for k in range(900, 909)] + [(f"pier {k}",) for k in range(900, 909)], "text string")
    found = O.learned_affixes(texts)
    assert "original" not in found and "thumb" in found and "pier" not in found


def scan(suffixes, cuts, every=False):
    """The pass over parts of the sorted suffixes, put together as the operator does."""
    out = []
    for part in (suffixes[a:b] for a, b in zip([0, *cuts], [*cuts, len(suffixes)], strict=True)):
        out += [r for pdf in O._scan(every)([pd.DataFrame(part, columns=["suffix", "core", "train", "held"])]) for r in pdf.itertuples(index=False)]
    sides = {}
    for span, is_core, t, h in out:
        a, b, c = sides.get(span, (False, False, False))
        sides[span] = (a or t, b or h, c or is_core)
    return {k for k, (a, b, c) in sides.items() if a and b and (c or every)}


def test_scan_against_brute_force_at_any_cut():
    texts = {"a 1": (1, 0), "a 1 x": (0, 1), "a 1 x 2": (1, 1), "b 7": (1, 0), "b 7 y": (1, 0), "c a 1": (0, 1), "scan 3": (1, 0), "scan 3 r 2": (0, 1), "scan 3 r 2 z": (1, 0)}
    core_n = {"a 1": 2, "a 1 x": 2, "a 1 x 2": 4, "b 7": 2, "b 7 y": 2, "c a 1": 3, "scan 3": 2, "scan 3 r 2": 4, "scan 3 r 2 z": 4}
    rows_, every = [], {}
    for t, (a, b) in texts.items():
        w = t.split()
        for i in range(len(w)):
            rows_.append((" ".join(w[i:]), core_n[t] if i == 0 else 0, bool(a), bool(b)))
            for j in range(i + 1, len(w) + 1):
                s = every.setdefault(" ".join(w[i:j]), [0, 0])
                s[0], s[1] = s[0] or a, s[1] or b
    rows_.sort()
    want = {s for s in {" ".join(t.split()[: core_n[t]]) for t in texts} if all(every[s])}
    for cuts in ([], [1], [3, 4], list(range(1, len(rows_)))):
        assert scan(rows_, cuts) == want
        assert want <= scan(rows_, cuts, True) <= {s for s, v in every.items() if all(v)}


def test_report_and_coverage(frames):
    members = O.overlap_classes(*frames)
    assert sum(x.n_pairs for x in O.overlap_report(members).collect()) == len(wanted())
    rows_ = O.coverage(*frames).collect()
    assert {r.rec for r in rows_} == {x for p in wanted() for x in p} and all(0 < r.coverage <= 1 for r in rows_)
    assert sum(r.n_partners for r in rows_) == 2 * len(wanted())


def test_without_the_suffix_array_nothing_is_found(frames, monkeypatch):
    monkeypatch.setattr(O, "suffixes", lambda texts: texts.limit(0).selectExpr("text as suffix", "0 as core", "train", "held", "0 as salt"))
    assert O.overlaps(*frames).count() == 0


def test_empty(spark, frames):
    assert O.overlaps(frames[0].limit(0), frames[1].limit(0)).count() == 0
