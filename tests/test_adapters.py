"""Every registered adapter builds canonical records from a small fixture."""

import json

import pytest
from pyspark.sql import functions as F

from annospark import schema as S
from annospark.operators import conversation as C
from annospark.sources import adapters as A
from annospark.sources import readers as R

T = ["<image>\nAsk: <question><expr><cls><objs><region>"]
MASK = "struct<h:int,w:int,counts:array<int>>"


def one(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def first(df):
    assert [f.name for f in df.schema] == ["sample_id", "source", "image", "target", "system", "turns"]
    assert df.schema["turns"].dataType.simpleString() == f"array<{S.TURN}>"
    assert df.schema["target"].dataType.simpleString() == S.TARGET
    return df.orderBy("sample_id").first()


def test_captions_and_questions(spark):
    r = first(A.load("caption", one(spark, [("1", "a.jpg", "A cat.")], "key string, img_path string, caption string"), templates=["Say."]))
    assert (r.image.path, r.turns[0].value, r.turns[1].value, r.system[0].task_name) == ("a.jpg", "Say.", "A cat.", "vqa")
    images = one(spark, [(7, "n.jpg")], "id long, file_name string")
    assert first(A.load("nocaps", one(spark, [("1", 7, "A dog.")], "key string, image_id long, caption string"), images=images, templates=T)).image.path == "n.jpg"
    v = one(spark, [("1", "a.jpg", "What?", ("cat",))], "key string, image_path string, question string, annotation struct<multiple_choice_answer:string>")
    assert first(A.load("vqav2", v, templates=T)).turns[1].value == "The answer is cat."
    assert first(A.load("vqav2", v, templates=T, has_annotation=False)).turns[1].value == "The answer is UNKNOWN."
    e = one(spark, [("1", "a.jpg", "What?", ["Since so."], "cat", ["By ", "this."], "dog")], "key string, file_path string, question string, explanation array<string>, multiple_answers string, justification array<string>, multiple_choice_answer string")
    assert first(A.load("vqae", e, templates=T)).turns[1].value == "Since so. So the answer is cat."
    assert first(A.load("vqax", e, templates=T, is_e=False)).turns[1].value == "By this. So the answer is dog."
    o = one(spark, [("1", "a.jpg", "What?", ["pine", "wood"])], "key string, image_name string, question string, answers array<string>")
    assert first(A.load("okvqa", o, templates=T)).turns[1].value == "The answer is pine."
    assert json.loads(first(A.load("okvqa", o, templates=T, has_annotation=False)).turns[1].value) == ["pine", "wood"]
    assert first(A.load("pope", one(spark, [("1", "a.jpg", "Is it?", "Yes")], "key string, image string, text string, label string"), templates=T)).turns[1].value == "The answer is yes ."
    with pytest.raises(KeyError):
        A.load("nothing", v)


def test_flickr(spark):
    schema = "key string, image_id string, sentence string, boxes array<array<double>>, boxes_seq array<array<int>>"
    df = one(spark, [("1", "5", "<ph_st>Two dogs<ph_ed> near <ph_st>a man<ph_ed> .", [[0.0] * 4] * 3, [[0, 1], [2]]), ("2", "6", "No one .", [], [])], schema)
    out = A.load("flickr", df, templates=["Grounded?"], plain=["Plain?"]).orderBy("sample_id").collect()
    assert out[0].turns[1].value == "<Phrase>Two dogs</Phrase><boxes><boxes> near <Phrase>a man</Phrase><boxes> ."
    assert out[0].system[0].task_name == "gcg_detection" and out[1].system[0].task_name == "vqa"
    assert out[1].turns[0].value == "Plain?" and out[1].turns[1].boxes_seq is None
    assert first(A.load("flickr_caption", df, templates=T)).turns[1].value == "Two dogs near a man."
    m = one(spark, [("1", "5", "<ph_st>A dog<ph_ed>.", [(1, 2, [1, 1])], [[0]])], f"key string, image_id string, sentence string, masks array<{MASK}>, masks_seq array<array<int>>")
    assert first(A.load("flickr_segmentation", m, templates=T)).turns[1].value == "<Phrase>A dog</Phrase><masks>."


def test_referring(spark):
    df = one(spark, [("1", "a.jpg", "the red cup", [1.0, 2.0, 3.0, 4.0], [[0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0]], 4, 4)], "key string, img_path string, expression string, bbox array<double>, mask array<array<double>>, height int, width int")
    r = first(A.load("rec", df, templates=["Where is <expr>?"]))
    assert r.turns[0].value == "Where is the red cup?" and r.turns[1].value == "<Phrase>the red cup</Phrase><boxes>" and r.turns[1].boxes_seq == [[0]]
    m = first(A.load("res", df, templates=["Where is <expr>?"]))
    assert m.target.masks[0].counts == [0, 2, 2, 2, 10]
    assert first(A.load("reg", df, templates=["What is <objs>?"])).turns[0].value == "What is <boxes>?"
    assert first(A.load("gc", df, templates=["What?"], version="mask")).turns[0].masks_seq == [[0]]
    p = one(spark, [(str(i), "a.jpg", "What", "cat", [1.0, 2.0, 3.0, 4.0], [1.0, 2.0]) for i in range(40)], "key string, file_path string, question string, answer string, bbox array<double>, point array<double>")
    both = A.load("point_qa_local", p, templates=["<question>"], version="bp").collect()
    assert {r.turns[0].value for r in both} == {"What<boxes>", "What<points>"}
    again = A.load("point_qa_local", p.repartition(7), templates=["<question>"], version="bp").collect()
    assert {r.sample_id: r.turns[0].value for r in both} == {r.sample_id: r.turns[0].value for r in again}
    c = [[0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 3.0, 3.0]]
    w = one(spark, [("1", "a.jpg", "Which?", c, c[1], [0.5, 0.5])], "key string, file_path string, question string, candidates array<array<double>>, answer array<double>, point array<double>")
    r = first(A.load("v7w_point", w, templates=["<question>"]))
    assert r.turns[1].boxes_seq == [[1]] and sorted(map(tuple, r.turns[0].boxes_seq)) == [(0,), (1,)]
    assert first(A.load("v7w_point", w, templates=["<question>"], version="p")).turns[1].points_seq == [[0]]


def test_gpt4gen(spark):
    df = one(spark, [("1", "a.jpg", [[0.0] * 4], "Is <ph_st>it<ph_ed> red?", [[0]], "Yes.", "See <ph_st>the cup<ph_ed>, so yes.", [[0, 0]])], "key string, img_path string, boxes array<array<double>>, question string, question_boxes_seq array<array<int>>, answer string, cot_with_ans string, answer_boxes_seq array<array<int>>")
    r = first(A.load("gpt4gen", df, templates=["<question>"]))
    assert r.turns[0].value == "Is <Phrase>it</Phrase><boxes> red?" and r.turns[1].value == "See <Phrase>the cup</Phrase><boxes><boxes>, so yes."
    assert first(A.load("gpt4gen", df, templates=["<question>"], version="a")).turns[1].value == "Yes."
    assert first(A.load("gpt4gen", df, templates=["<question>"], version="c")).turns[1].value == "See the cup, so yes."
    with pytest.raises(ValueError):
        A.load("gpt4gen", df, templates=["<question>"], version="x")


def test_vcr(spark):
    word = lambda *ws: [(w, None) if isinstance(w, str) else (None, w) for w in ws]
    choices = [word("He", [0], "runs"), word("No"), word("Yes"), word("Maybe")]
    df = one(spark, [("1", "a.jpg", [[0.0, 0.0, 1.0, 1.0, 0.9]], word("Why", [0], "?"), choices, choices, 0, 1)], "key string, img_fn string, boxes array<array<double>>, question array<struct<word:string,ids:array<int>>>, answer_choices array<array<struct<word:string,ids:array<int>>>>, rationale_choices array<array<struct<word:string,ids:array<int>>>>, answer_label int, rationale_label int")
    r = first(A.load("vcr", df, templates=["<question>"]))
    assert r.turns[0].value == "QUESTION: Why <boxes> ?" and r.turns[1].value == "He <Phrase>target</Phrase><boxes> runs" and r.target.boxes == [[0.0, 0.0, 1.0, 1.0]]
    q = first(A.load("vcr", df, templates=["<question>"], version="qc-a"))
    assert "(A) He <boxes> runs (B) No (C) Yes (D) Maybe" in q.turns[0].value and q.turns[1].value == "The answer is (A)." and q.system[0].task_name == "vqa"
    for version in A.VCR_LAYOUTS:
        r = first(A.load("vcr", df, templates=["<question>"], version=version))
        assert len(r.turns) == 2 * len(r.system)
    assert A.load("vcr_predictions", df, templates=["<question>"], version="qac-r").count() == 16
    assert A.load("vcr_predictions", df, templates=["<question>"]).count() == 4


def test_scene_graphs(spark):
    scenes = one(spark, [("5", {"a": (1.0, 2.0, 3.0, 4.0), "b": (1.0, 2.0, 3.0, 4.0)})], "imageId string, objects map<string,struct<x:double,y:double,w:double,h:double>>")
    df = one(spark, [("1", "5", "Is the cup red ?", "yes", "Yes the cup is red", [(1, 3, ["a"])], [(1, 3, ["a", "b"]), (4, 5, ["zz"])])], "key string, imageId string, question string, answer string, fullAnswer string, question_spans array<struct<start:int,end:int,ids:array<string>>>, answer_spans array<struct<start:int,end:int,ids:array<string>>>")
    r = first(A.load("gqa", df, scenes=scenes, templates=["<question>"], answer="bl", boxed_question="box"))
    assert r.turns[1].value == "Yes <Phrase>the cup</Phrase><boxes><boxes> is red" and r.turns[1].boxes_seq == [[0, 0]] and r.target.boxes == [[1.0, 2.0, 4.0, 6.0]]
    assert r.turns[0].value == "Is the cup<boxes> red ?"
    assert first(A.load("gqa", df, scenes=scenes, templates=["<question>"])).turns[1].value == "The answer is yes."
    program = [("scene", [], [], [0, 1]), ("filter_color", [0], ["red"], [1]), ("count", [1], [], [])]
    c = one(spark, [("1", "c.png", 3, "How many?", "1", program)], "key string, image_filename string, image_index int, question string, answer string, program array<struct<function:string,inputs:array<int>,value_inputs:array<string>,ans:array<int>>>")
    cs = one(spark, [(3, [([1.0, 2.0, 0.0],), ([3.0, 4.0, 0.0],)])], "image_index int, objects array<struct<pixel_coords:array<double>>>")
    assert first(A.load("clevr", c, scenes=cs, templates=["<question>"], version="ss")).turns[1].value == "scene -> filter_color:red[0] -> count[1] The answer is 1."
    b = first(A.load("clevr", c, scenes=cs, templates=["<question>"], version="bss"))
    assert b.turns[1].value == "scene -> filter_color:red[0]<points> -> count[1] The answer is 1." and b.target.points == [[3.0, 4.0]]


def test_detection_family(spark):
    anns = one(spark, [(1, 10, 1, [0.0, 0.0, 2.0, 2.0], (2, 2, [0, 4])), (2, 10, 2, [1.0, 1.0, 2.0, 2.0], (2, 2, [4])), (3, 10, 1, [5.0, 5.0, 1.0, 1.0], (2, 2, [1, 3]))], f"id long, image_id long, category_id int, bbox array<double>, mask {MASK}")
    images = one(spark, [(10, "i.jpg", 20, 10), (11, "j.jpg", 20, 10)], "id long, file_name string, width int, height int")
    cats = one(spark, [(1, "dog"), (2, "cat")], "id int, name string")
    r = first(A.load("coco_rem", anns, images=images, categories=cats, templates=T))
    assert r.turns[1].value == "<Phrase>dog</Phrase><boxes><boxes>,<Phrase>cat</Phrase><boxes>." and r.turns[1].boxes_seq == [[0, 2], [1]] and r.target.boxes[1] == [1.0, 1.0, 3.0, 3.0]
    assert first(A.load("ade20k", anns, images=images, categories=cats, templates=T, unit="mask")).turns[1].masks_seq == [[0, 2], [1]]
    assert first(A.load("part", anns, images=images, categories=cats, templates=T, unit="mask", most=2)).target.masks is not None
    cond = A.load("conditional_detection", anns, images=images, categories=cats, templates=["Find <cls>"]).orderBy("sample_id").collect()
    assert [x.turns[0].value for x in cond] == ["Find cat", "Find dog"] and cond[1].turns[1].boxes_seq == [[0, 1]]
    assert first(A.load("lvis_test", images, templates=T)).target.boxes == [[0.0] * 4]
    labels = one(spark, [("p.png", 3, (2, 2, [4])), ("p.png", 1, (2, 2, [0, 4]))], f"path string, label int, mask {MASK}")
    classes = one(spark, [(1, ["sky"]), (3, ["sea", "water"])], "class_id int, names array<string>")
    assert first(A.load("pascal", labels, classes=classes, templates=T)).turns[1].value == "<Phrase>sky</Phrase><masks>,<Phrase>sea</Phrase><masks>."
    segs = one(spark, [("p.png", 1001, (2, 2, [4])), ("p.png", 1002, (2, 2, [4])), ("p.png", 7, (2, 2, [4]))], f"path string, segment int, mask {MASK}")
    assert first(A.load("cityscapes_instance", segs, classes=classes, templates=T)).turns[1].value == "<Phrase>sky</Phrase><masks><masks>."
    k = one(spark, [(1, 10, [0.0, 0.0, 2.0, 2.0], [1.0, 2.0, 2.0, 3.0, 4.0, 0.0], 1), (2, 10, [0.0] * 4, [0.0] * 6, 0)], "id long, image_id long, bbox array<double>, keypoints array<double>, num_keypoints int")
    people = A.load("coco_keypoints", k, images=images, templates=T).orderBy("sample_id").collect()
    assert people[0].turns[1].keypoints_seq == [[0]] and people[0].target.keypoints == [[[1.0, 2.0, 2.0], [3.0, 4.0, 0.0]]] and people[1].turns[1].value == "There is no person in the image."
    assert first(A.load("coco_keypoints_rec", k, images=images, templates=T, region=True)).turns[1].value == "<Phrase>person</Phrase><keypoints>."


def test_grounded_captions(spark):
    m = (1, 2, [1, 1])
    png = one(spark, [("1", "f.jpg", [("A dog", [m, m]), ("on", []), ("grass", [m]), (".", [])])], f"key string, file_name string, segments array<struct<utterance:string,masks:array<{MASK}>>>")
    r = first(A.load("png", png, templates=T))
    assert r.turns[1].value == "<Phrase>A dog</Phrase><masks><masks> on <Phrase>grass</Phrase><masks>." and r.turns[1].masks_seq == [[0, 1], [2]]
    psg = one(spark, [("1", "f.jpg", "a dog on grass", [(2, 5, [m]), (9, 14, [m, m])])], f"key string, file_name string, caption string, groundings array<struct<start:int,end:int,values:array<{MASK}>>>")
    r = first(A.load("openpsg", psg, templates=T))
    assert r.turns[1].value == "a <Phrase>dog</Phrase><masks> on <Phrase>grass</Phrase><masks><masks>" and r.turns[1].masks_seq == [[0], [1, 2]]
    conv = "array<struct<from:string,value:string>>"
    lg = one(spark, [("1", "i.jpg", [("human", "Show it."), ("gpt", "Here <seg> and <seg>.")], [[5], [6, 7]])], f"key string, image string, conversations {conv}, gd_ls array<array<bigint>>")
    objs = one(spark, [(5, m), (6, m), (7, m)], f"id long, mask {MASK}")
    r = first(A.load("llava_grounding", lg, objects=objs))
    assert r.turns[1].value == "Here <masks> and <masks><masks>." and r.turns[1].masks_seq == [[0], [1, 2]]
    osp = one(spark, [("1", "f.jpg", 4, 4, [m, m], [("human", "What is <region2>?"), ("gpt", "A cup.")]), ("2", "f.jpg", 4, 4, [m], [("human", "x")])], f"key string, file_name string, height int, width int, masks array<{MASK}>, conversations {conv}")
    assert A.load("osprey", osp).count() == 1 and first(A.load("osprey_short", osp, suffix=" Be short.")).turns[0].value == "What is <masks>? Be short."
    ins = one(spark, [("1", None, [("human", "Hi"), ("gpt", "Hello")])], f"key string, image string, conversations {conv}")
    assert first(A.load("instruct", ins)).image is None
    it = one(spark, [("i.jpg", 4, 4, 1, "cup", m, {"box": m, "point": m})], f"image string, width int, height int, ann_id int, label string, mask {MASK}, prompts map<string,{MASK}>")
    assert A.load("coco_interact_single", it, templates=["<image>What is <region>?"]).count() == 2
    assert A.load("coco_interact_task", it, templates=T, prompt="box").count() == 1
    many = first(A.load("coco_interact", it, templates=["<image>What is <region>?"], single=False))
    assert len(many.turns) == 4 and "<image>" not in many.turns[2].value and many.turns[3].masks_seq == [[3]]
    d = one(spark, [("1", "r.jpg", "d.png")], "key string, rgb_path string, depth_path string")
    assert first(A.load("nyu", d, templates=T)).target.depth == ["d.png"]
    assert first(A.load("single", one(spark, [("1", "a.jpg", "What?", "vqa")], "key string, image string, question string, task_name string"))).turns[1].value == ""


def test_grit_and_grand(spark):
    g = one(spark, [("1", 100, 50, "a dog and a cat", [[2.0, 5.0, 0.1, 0.2, 0.3, 0.4, 0.9], [12.0, 15.0, 0.5, 0.5, 0.6, 0.6, 0.8]], [[2.0, 5.0, 0.1, 0.2, 0.3, 0.4, 0.9]])], "key string, width int, height int, caption string, noun_chunks array<array<double>>, ref_exps array<array<double>>")
    names = {v: ["<expr><cls><objs>"] for v in A.GRIT_VERSIONS}
    assert first(A.load("grit", g, templates=names)).turns[1].value == "a <Phrase>dog</Phrase><boxes> and a <Phrase>cat</Phrase><boxes>"
    assert first(A.load("grit", g, templates=names, version="d")).turns[1].value == "<Phrase>dog</Phrase><boxes>,<Phrase>cat</Phrase><boxes>."
    assert A.load("grit", g, templates=names, version="r").count() == 1 and A.load("grit", g, templates=names, version="cond_d").count() == 2
    assert A.load("grit", g, templates=names, version="combine").count() == 1 + 1 + 2 + 1 + 2 + 1
    obj = f"array<struct<id:int,bbox:array<double>,mask:{MASK},label:string,attributes:array<string>,area:double>>"
    m = (1, 2, [1, 1])
    os = [(1, [0.0, 0.0, 1.0, 1.0], m, "dog", ["brown dog"], 5.0), (2, [1.0, 1.0, 2.0, 2.0], m, "dog", [], 9.0)]
    df = one(spark, [("1", "n.jpg", 10, 10, os, [(3, [2.0, 2.0, 3.0, 3.0], m, "cat", None, 1.0)], [("a dog and a cat", [("dog", 2, 5, [1, 2]), ("cat", 12, 15, [3]), ("x", 0, 1, [99])])])], f"key string, name string, width int, height int, objects {obj}, floating {obj}, captions array<struct<caption:string,details:array<struct<phrase:string,start:int,end:int,ids:array<int>>>>>")
    names = {v: ["<expr><cls><objs>"] for v in A.GRAND_VERSIONS}
    r = first(A.load("grand", df, templates=names))
    assert r.turns[1].value == "a <Phrase>dog</Phrase><boxes><boxes> and a <Phrase>cat</Phrase><boxes>" and r.turns[1].boxes_seq == [[0, 1], [2]]
    for version in A.GRAND_VERSIONS:
        for x in A.load("grand", df, templates=names, version=version).collect():
            for t in x.turns:
                n = sum(len(s) for s in (t.boxes_seq or []) + (t.masks_seq or []))
                assert t.value.count("<boxes>") + t.value.count("<masks>") == n
    assert first(A.load("grand", df, templates=names, version="re_det")).turns[1].value == "brown dog"


def test_lifecycle(spark):
    df = one(spark, [("1", "a.jpg", "the cup", [10.0, 20.0, 30.0, 40.0])], "key string, img_path string, expression string, bbox array<double>")
    s = A.load("rec", df, templates=["<image>\nFind <expr>"]).withColumn("image", F.struct(F.lit("a.jpg").alias("path"), F.lit(100).alias("width"), F.lit(50).alias("height")))
    n = A.normalised(s).first()
    assert n.target.boxes == [[0.1, 0.45, 0.3, 0.65]]
    r = A.compiled_rounds(s).first().rounds[0]
    assert r.output.endswith("<Phrase>the cup</Phrase>(<Unit>box</Unit>[0]<REF>)") and "- Name: the cup Unit: box Num: 1" in r.output
    assert r.system.startswith("Task Command:\n- task name: grounding_detection\n- answer element: phrase, unit\n- unit: <Unit>box</Unit>")


def test_empty_sources(spark):
    empty = one(spark, [], "key string, img_path string, caption string")
    assert A.load("caption", empty, templates=T).count() == 0


def test_readers(spark, tmp_path):
    coco = {"images": [{"id": 1, "width": 4, "height": 3, "file_name": "a_b_77.jpg"}], "annotations": [{"id": 9, "image_id": 1, "category_id": 2, "bbox": [0, 0, 1, 1], "segmentation": [[0, 0, 1, 1]]}], "categories": [{"id": 2, "name": "dog"}]}
    (tmp_path / "c.json").write_text(json.dumps(coco))
    images, anns, cats = R.coco_tables(spark, str(tmp_path / "c.json"))
    assert images.first().file_name == "a_b_77.jpg" and anns.first().image_id == 1 and cats.first().name == "dog"
    assert images.select(R.third_part(F.col("file_name")).alias("x")).first().x == "77"
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nnot json\n')
    rows = R.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()
    assert [r.a for r in rows] == [1, None] and rows[1]._corrupt_record == "not json"
    (tmp_path / "k.json").write_text(json.dumps({"pic.jpg": {"a": 3}}))
    assert R.keyed_documents(spark, str(tmp_path / "k.json"), "a:int").first().name == "pic.jpg"
    (tmp_path / "cls.txt").write_text("1:person, people\n2:car\n")
    assert [r.names for r in R.class_list(spark, str(tmp_path / "cls.txt")).orderBy("class_id").collect()] == [["person", "people"], ["car"]]
    lines = one(spark, [("5", 0, "[/EN#12/people Two men] near [/EN#13/other a car] .")], "image_id string, sentence_id int, line string")
    s = R.entity_sentences(lines)
    r = s.first()
    assert r.sentence == "Two men near a car ." and [(p.id, p.phrase, p.at) for p in r.phrases] == [("12", "Two men", 0), ("13", "a car", 3)]
    (tmp_path / "a.xml").write_text("<annotation><filename>5</filename><object><name>12</name><bndbox><xmin>2</xmin><ymin>3</ymin><xmax>4</xmax><ymax>5</ymax></bndbox></object><object><name>13</name><scene>1</scene><nobndbox>1</nobndbox></object></annotation>")
    boxes = R.entity_boxes(spark, str(tmp_path / "a.xml"))
    assert boxes.collect()[0].box == [1.0, 2.0, 3.0, 4.0]
    g = R.grounded_sentences(s, boxes).first()
    assert g.sentence == "<ph_st>Two men<ph_ed> near a car ." and g.boxes_seq == [[0]]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "rec.json").write_text(json.dumps(["Find <expr>.", "Where?"]))
    assert [(r.name, r.idx, r.text) for r in R.templates(spark, str(tmp_path / "t")).orderBy("idx").collect()][0] == ("rec", 0, "Find <expr>.")
    det = one(spark, [(1, 2, [0.0, 0.0, 1.0, 1.0], 0.5), (1, 3, [0.0, 0.0, 1.0, 1.0], 0.25)], "image_id long, category_id int, bbox array<double>, score double")
    R.write_results(det, str(tmp_path / "out"))
    assert sorted(r.category_id for r in R.read_results(spark, str(tmp_path / "out")).collect()) == [2, 3]
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "rgb_3.jpg").write_bytes(b"x")
    (tmp_path / "img" / "depth_3.png").write_bytes(b"y")
    p = R.paired_depth(R.pictures(spark, str(tmp_path / "img"), "rgb*"), R.pictures(spark, str(tmp_path / "img"), "depth*"), R.first_digits)
    assert p.count() == 1
    assert R.offline(spark, "x", str(tmp_path / "missing"), lambda: det).count() == 2
    assert spark.range(1).select(R.base64_bytes(F.lit("aGk=")).alias("b")).first().b == bytearray(b"hi")
    assert R.city_suffix("gtFine", "semantic") == "gtFine_labelIds.png"
    sq = one(spark, [("a.png", [[1, 1, 0], [1, 1, 0]])], "path string, rgb array<array<int>>")
    assert R.panoptic_ids(sq).first().segment == 257
    lv = one(spark, [("a.png", [0, 3, 3, 255])], "path string, values array<int>")
    assert [r.label for r in R.label_values(lv).collect()] == [3]


def test_rounds_survive_odd_input(spark):
    turn = S.TURN
    rows = [([],), (None,), ([("gpt", "x", None, None, None, None)],), ([("human", None, None, None, None, None), ("gpt", None, None, None, None, None), ("human", "q", None, None, None, None)],)]
    out = one(spark, rows, f"turns array<{turn}>").select(C.rounds_of(F.col("turns")).alias("r")).collect()
    assert [None if r.r is None else len(r.r) for r in out] == [0, None, 0, 1]
