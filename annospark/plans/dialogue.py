"""Queries over conversations: compiling, templates, tokens, parsing, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BOXES, TASK_COMMAND
from ..functions import text as T
from ..operators import conversation as C
from ..operators import encoding as E
from ..operators import validation as V
from ..runtime import table


def samples(spark: SparkSession, d: str) -> DataFrame:
    """``sample_id``, ``source``, ``turns``, ``system``, ``boxes`` of each sample, each key once."""
    t = table(spark, d, "samples", "sample_id", "source", "targets", "system_tasks", "conversations").dropDuplicates(["sample_id"])
    turns = F.transform("conversations", lambda c: F.struct(c["sender"].alias("role"), c["value"].alias("value"), c["boxes_seq"].alias("boxes_seq")))
    system = F.transform("system_tasks", lambda s: F.struct(s["task"]["task_name"].alias("task_name"), s["task"]["element"].alias("element"), s["task"]["use_unit"].alias("use_unit"), s["unit"].alias("unit")))
    return t.select("sample_id", "source", turns.alias("turns"), system.alias("system"), F.col("targets.boxes").alias("boxes"))


def _rounds(spark: SparkSession, d: str) -> DataFrame:
    """``sample_id``, ``round_idx``, ``input``, ``output``, ``seq`` of every round."""
    return samples(spark, d).select("sample_id", F.posexplode(C.rounds_of(F.col("turns"))).alias("round_idx", "r")).select("sample_id", "round_idx", "r.input", "r.output", "r.seq")


def conversation_compile(spark: SparkSession, d: str) -> DataFrame:
    """Rounds with compiled question, answer and task command."""
    s = samples(spark, d).select("sample_id", F.posexplode(C.compiled(F.col("turns"), F.col("system"))).alias("round_idx", "r"))
    return s.select("sample_id", "round_idx", "r.input", "r.output", "r.system")


def chat_template(spark: SparkSession, d: str) -> DataFrame:
    """Chat text of every round."""
    s = samples(spark, d).select("sample_id", F.posexplode(C.prompted(C.compiled(F.col("turns"), F.col("system"), use_cot=False))).alias("round_idx", "r"))
    return s.select("sample_id", "round_idx", F.md5("r.input").alias("input_md5"), F.length("r.input").alias("n_chars"), "r.need_eos")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("sample_id", "boxes", F.posexplode("turns").alias("turn_idx", "t")).select("sample_id", "turn_idx", "boxes", F.col("t.role").alias("role"), F.col("t.value").alias("value"), F.col("t.boxes_seq").alias("seq"))


def stage1_box_text(spark: SparkSession, d: str) -> DataFrame:
    """Boxes written as numbers into the text."""
    t = _turns(spark, d).where(F.size(F.flatten("seq")) > 0)
    return t.select("sample_id", "turn_idx", C.stage1_text(F.col("value"), F.col("boxes"), F.col("seq")).alias("value"))


def placeholder_order(spark: SparkSession, d: str) -> DataFrame:
    """T5: placeholders and tags of each turn in order."""
    t = _turns(spark, d).where("value is not null")
    return t.select("sample_id", "turn_idx", F.array_join(T.placeholder_order(F.col("value"), ("<image>", BOXES, "<REF>", "<Phrase>", "<Unit>")), "").alias("tags"))


def placeholder_check(spark: SparkSession, d: str) -> DataFrame:
    """turns whose placeholders and targets differ, and questions with one image slot."""
    t = _turns(spark, d).where("value is not null")
    return t.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(~V.placeholders_match(F.col("value"), F.col("seq"))).alias("n_mismatch"), F.count_if(V.slots_ok(F.col("value"), ("<image>",))).alias("n_one_image"))


def quarantine_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows per reason for which a sample is set aside."""
    s = samples(spark, d).withColumn("reason", F.coalesce(V.first_reason(V.sample_checks()), F.lit("ok")))
    return s.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def cot_strip(spark: SparkSession, d: str) -> DataFrame:
    """Compiled answers without their task block are the answers."""
    r = _rounds(spark, d)
    whole = C.answer_text(F.col("output"), F.col("seq"))
    return r.groupBy(F.size(F.coalesce("seq", F.array())).alias("n_phrases")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length(T.strip_task(whole)) == F.length(C.referenced(F.col("output"), F.col("seq"))) + F.when(F.col("output") != "", 1).otherwise(0)).alias("n_same"))


def cot_triplets(spark: SparkSession, d: str) -> DataFrame:
    """Name, unit and number of the task block of each compiled answer."""
    r = _rounds(spark, d).where(F.contains("output", F.lit("<REF>")))
    block = F.regexp_replace("output", "<REF>", BOXES)
    return r.select("sample_id", "round_idx", F.posexplode(T.plain_triples(C.thought(block))).alias("pos", "t")).select("sample_id", "round_idx", "pos", "t.name", "t.unit", "t.n")


def answer_grammar(spark: SparkSession, d: str) -> DataFrame:
    """Phrases, units and references written in answers."""
    r = _rounds(spark, d).where(F.contains("output", F.lit("<Phrase>")))
    return r.select("sample_id", "round_idx", F.posexplode(T.answer_units(F.col("output"))).alias("pos", "t")).select("sample_id", "round_idx", "pos", "t.name", "t.unit", "t.n")


def caption_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Answers without tags, groups and breaks."""
    return _rounds(spark, d).select("sample_id", "round_idx", T.fix_punctuation(T.caption_text(F.col("output"))).alias("caption"))


def decode_groups(spark: SparkSession, d: str) -> DataFrame:
    """References grouped with their phrase and unit."""
    r = _rounds(spark, d).where(F.contains("output", F.lit("<REF>")))
    return r.select("sample_id", "round_idx", F.posexplode(E.reference_groups(F.col("output"))).alias("pos", "g")).select("sample_id", "round_idx", "pos", "g.phrase", "g.unit", "g.n")


def _encoded(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    """Ids and labels of each sample; ``whole`` leaves out samples without turns before anything is encoded."""
    s = samples(spark, d).where(F.col("turns").isNotNull() if whole else F.lit(True)).select("sample_id", C.prompted(C.compiled(F.col("turns"), F.col("system"), use_cot=False)).alias("rounds"))
    return s.select("sample_id", E.encoded(F.col("rounds")).alias("e")).select("sample_id", "e.ids", "e.labels")


def token_encode_labels(spark: SparkSession, d: str) -> DataFrame:
    """Lengths and sums of ids and labels of each sample."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    e = _encoded(spark, d)
    return e.select("sample_id", F.size("ids").alias("n_ids"), total("ids").alias("sum_ids"), F.size(E.supervised(F.col("labels"))).alias("n_learned"), total(E.supervised(F.col("labels"))).alias("sum_learned"), F.size(E.prompt_ids(F.col("ids"), F.col("labels"))).alias("n_prompt"))


def batch_padding(spark: SparkSession, d: str) -> DataFrame:
    """Rows of padded batches; every batch is as long as its longest row."""
    b = E.padded_batches(_encoded(spark, d, whole=True).select("sample_id", "ids", "labels"), "sample_id", 16)
    live = F.aggregate("attention", F.lit(0), lambda s, x: s + x)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("ids")).alias("width"), F.min(F.size("labels")).alias("label_width"), F.sum(live).alias("n_tokens"), F.max(live).alias("longest"))


def feature_splice(spark: SparkSession, d: str) -> DataFrame:
    """Lengths after image features take the place of their mark."""
    e = _encoded(spark, d).select("sample_id", "ids", E.with_features(F.col("ids"), F.col("labels"), 576).alias("f"))
    vis = F.size(F.filter("f.kinds", lambda x: x == 6))
    return e.select("sample_id", F.size("ids").alias("n_before"), F.size("f.ids").alias("n_after"), vis.alias("n_image"))


def label_trim(spark: SparkSession, d: str) -> DataFrame:
    """Group sizes when a third of the references is lost from the tail."""
    r = _rounds(spark, d).where(F.contains("output", F.lit("<REF>")))
    sizes = F.transform(E.reference_groups(F.col("output")), lambda g: g["n"])
    total = F.aggregate(sizes, F.lit(0), lambda s, x: s + x)
    left = F.ceil(total * 2 / 3).cast("int")
    return r.select("sample_id", "round_idx", F.array_join(F.transform(E.trimmed_groups(sizes, left), lambda x: x.cast("string")), ",").alias("kept"), left.alias("n_left"))


def session_history(spark: SparkSession, d: str) -> DataFrame:
    """ST1: dialogue history with resets when it grows beyond a limit."""
    t = _turns(spark, d).select(F.col("sample_id").alias("session"), F.col("turn_idx").cast("long").alias("pos"), "value")
    return C.session_windows(t, 300)


QUERIES = {
    f.__name__: f
    for f in (conversation_compile, chat_template, stage1_box_text, placeholder_order, placeholder_check, quarantine_split, cot_strip, cot_triplets, answer_grammar, caption_cleanup, decode_groups, token_encode_labels, batch_padding, feature_splice, label_trim, session_history)
}

_TURNS = """s_ as (select * from (select *, row_number() over (partition by sample_id) as rn_ from samples) where rn_ = 1),
  turns_ as (select sample_id, system_tasks, targets.boxes as boxes, i - 1 as turn_idx, conversations[i].sender as role, conversations[i].value as value, conversations[i].boxes_seq as seq
    from (select *, unnest(range(1, len(conversations) + 1)) as i from s_))"""
_HUMAN = """case when contains(coalesce(value, ''), '<image>') then regexp_replace('<image>' || chr(10) || regexp_replace(replace(value, '<image>', ''), '^\\s+|\\s+$', '', 'g'), '^\\s+|\\s+$', '', 'g') else coalesce(value, '') end"""
_ROUNDS = f"""{_TURNS},
  begun_ as (select *, sum(case when role = 'human' then 1 else 0 end) over (partition by sample_id order by turn_idx rows unbounded preceding) as nh from turns_ where role is not null),
  kept_ as (select *, sum(case when role = 'gpt' then 1 else 0 end) over (partition by sample_id order by turn_idx rows unbounded preceding) - case when role = 'gpt' then 1 else 0 end as rnd from begun_ where nh > 0),
  ask_ as (select sample_id, rnd, string_agg({_HUMAN}, '' order by turn_idx) as input from kept_ where role = 'human' group by sample_id, rnd),
  rounds_ as (select g.sample_id, cast(g.rnd as int) as round_idx, coalesce(a.input, '') as input, coalesce(g.value, '') as output, g.seq, g.system_tasks from kept_ g left join ask_ a on a.sample_id = g.sample_id and a.rnd = g.rnd where g.role = 'gpt')"""
_SYSTEM = """case when st is null then null else 'Task Command:' || chr(10) || '- task name: ' || coalesce(st.task.task_name, 'None') || chr(10) || '- answer element: ' ||
   array_to_string(case when coalesce(st.task.use_unit, false) then list_append(coalesce(st.task.element, []), 'unit') else coalesce(st.task.element, []) end, ', ') || chr(10) ||
   case when coalesce(st.task.use_unit, false) and st.unit is not null then '- unit: ' || array_to_string(list_transform(st.unit, lambda u: '<Unit>' || u || '</Unit>'), ', ') || chr(10) else '- unit: None' end end"""
_MARKS = """flatten(list_transform(coalesce(seq, []), lambda q: list_transform(range(1, len(q) + 1), lambda i: case when i = 1 then '(<Unit>box</Unit>' else '' end || '[' || (i - 1) || ']<REF>' || case when i = len(q) then ')' else '' end)))"""
_REFERENCED = f"""case when coalesce(len(seq), 0) > 0 then array_to_string(list_transform(range(1, len(string_split(output, '<boxes>')) + 1), lambda k: case when k > 1 then coalesce(({_MARKS})[k - 1], '') else '' end || string_split(output, '<boxes>')[k]), '') else output end"""
_PHRASES = """list_filter(list_transform(regexp_extract_all(output, '(?s)<Phrase>.*?</Phrase>[^<]*(?:<boxes>[^<]*)*', 0), lambda p: struct_pack(name := replace(regexp_extract(p, '(?s)<Phrase>(.*?)</Phrase>', 1), '<boxes>', ''), n := (len(regexp_replace(p, '(?s)^<Phrase>.*?</Phrase>', '')) - len(replace(regexp_replace(p, '(?s)^<Phrase>.*?</Phrase>', ''), '<boxes>', ''))) // 7)), lambda z: z.n > 0)"""
_THOUGHT = f"""case when contains(output, '<boxes>') then '<Task>' || chr(10) || 'Unit decode (True). Class name, target unit and number:' || chr(10) || array_to_string(list_transform({_PHRASES}, lambda z: '- Name: ' || z.name || ' Unit: box Num: ' || z.n || chr(10)), '') || '</Task>' || chr(10) else '<Task>' || chr(10) || 'Unit decode (False).' || chr(10) || '</Task>' || chr(10) end"""

SQL = {
    "conversation_compile": f"""with {_ROUNDS}, e_ as (select *, system_tasks[round_idx + 1] as st from rounds_)
        select sample_id, round_idx, replace(input, '<boxes>', '[VPT]') as input, case when output = '' then '' else {_THOUGHT} || {_REFERENCED} end as output, {_SYSTEM} as system from e_""",
    "chat_template": f"""with {_ROUNDS}, e_ as (select *, system_tasks[round_idx + 1] as st from rounds_), y_ as (select *, {_SYSTEM} as sys from e_),
        t_ as (select sample_id, round_idx, case when round_idx = 0 then $${TASK_COMMAND["prefix"]}$$ else '' end || case when coalesce(sys, '') <> '' then sys || chr(10) else '' end || 'USER: ' || replace(input, '<boxes>', '[VPT]') || ' ASSISTANT:' as x from y_)
        select sample_id, round_idx, md5(x) as input_md5, len(x) as n_chars, true as need_eos from t_""",
    "stage1_box_text": f"""with {_TURNS}, w_ as (select *, list_transform(seq, lambda q: '[' || array_to_string(list_transform(q, lambda i: array_to_string(list_transform(case when i >= 0 then boxes[i + 1] end, lambda v: printf('%.3f', v)), ',')), ';') || ']') as m from turns_ where len(flatten(seq)) > 0)
        select sample_id, turn_idx, array_to_string(list_transform(range(1, len(string_split(value, '<boxes>')) + 1), lambda k: case when k > 1 then coalesce(m[k - 1], '') else '' end || string_split(value, '<boxes>')[k]), '') as value from w_""",
    "placeholder_order": f"""with {_TURNS} select sample_id, turn_idx, array_to_string(regexp_extract_all(value, '<image>|<boxes>|<REF>|<Phrase>|<Unit>', 0), '') as tags from turns_ where value is not null""",
    "placeholder_check": f"""with {_TURNS}, c_ as (select role, (len(value) - len(replace(value, '<boxes>', ''))) // 7 as nb, coalesce(len(flatten(seq)), 0) as nt, (len(value) - len(replace(value, '<image>', ''))) // 7 as ni from turns_ where value is not null)
        select role, count(*) as n, sum(case when nb <> nt then 1 else 0 end) as n_mismatch, sum(case when ni = 1 then 1 else 0 end) as n_one_image from c_ group by role""",
    "quarantine_split": f"""with {_ROUNDS}, nr_ as (select sample_id, count(*) as n_rounds from rounds_ group by sample_id),
        tc_ as (select sample_id, bool_and((len(coalesce(value, '')) - len(replace(coalesce(value, ''), '<boxes>', ''))) // 7 = coalesce(len(flatten(seq)), 0)) as ph, bool_and(coalesce(list_bool_and(list_transform(flatten(seq), lambda i: i >= 0 and i < coalesce(len(boxes), 0))), true)) as ix from turns_ group by sample_id),
        k_ as (select s.sample_id, len(s.conversations) as nt, coalesce(list_bool_and(list_transform(s.targets.boxes, lambda b: len(b) = 4 and b[3] >= b[1] and b[4] >= b[2])), true) as bx, t.ph, t.ix, coalesce(len(s.system_tasks), 0) as ns, coalesce(n.n_rounds, 0) as nr,
          len(list_distinct(list_filter(flatten(list_transform(coalesce(s.system_tasks, []), lambda e: coalesce(e.unit, []))), lambda u: u is not null))) <= 1 as un
          from s_ s left join tc_ t on t.sample_id = s.sample_id left join nr_ n on n.sample_id = s.sample_id)
        select case when coalesce(nt, 0) < 2 then 'no turns' when not bx then 'bad box' when not ph then 'placeholders' when not ix then 'index' when ns <> nr then 'system entries' when not un then 'units' else 'ok' end as reason, count(*) as n from k_ group by 1""",
    "cot_strip": f"""with {_ROUNDS} select coalesce(len(seq), 0) as n_phrases, count(*) as n, count(*) as n_same from rounds_ group by 1""",
    "cot_triplets": f"""with {_ROUNDS}, p_ as (select sample_id, round_idx, regexp_extract_all(output, '(?s)<Phrase>.*?</Phrase>.*?(?:\\)|$)', 0) as ps from rounds_ where contains(output, '<REF>')),
        q_ as (select sample_id, round_idx, unnest(range(1, len(ps) + 1)) as i, ps from p_)
        select sample_id, round_idx, cast(i - 1 as int) as pos, regexp_extract(ps[i], '(?s)<Phrase>(.*?)</Phrase>', 1) as name, 'box' as unit, (len(ps[i]) - len(replace(ps[i], '<REF>', ''))) // 5 as n from q_ where contains(ps[i], '<REF>')""",
    "answer_grammar": f"""with {_ROUNDS}, p_ as (select sample_id, round_idx, regexp_extract_all(output, '<Phrase>(.*?)</Phrase>\\(<Unit>(.*?)</Unit>(.*?)\\)', 0) as ps from rounds_ where contains(output, '<Phrase>')),
        q_ as (select sample_id, round_idx, unnest(range(1, len(ps) + 1)) as i, ps from p_)
        select sample_id, round_idx, cast(i - 1 as int) as pos, regexp_extract(ps[i], '<Phrase>(.*?)</Phrase>', 1) as name, regexp_extract(ps[i], '<Unit>(.*?)</Unit>', 1) as unit, len(regexp_extract_all(ps[i], '\\[\\d+\\]<REF>', 0)) as n from q_""",
    "caption_cleanup": f"""with {_ROUNDS}, a_ as (select sample_id, round_idx, regexp_replace(regexp_replace(regexp_replace(output, '<Task>.*?</Task>', '', 'gs'), '\\n+', '', 'g'), '</?Phrase>', '', 'g') as t from rounds_)
        select sample_id, round_idx, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\s*\\([^)]*\\)\\s*', ' ', 'g'), '\\s{{2,}}', ' ', 'g'), '^ +| +$', '', 'g'), '\\s+([,.])', '\\1', 'g') as caption from a_""",
    "decode_groups": f"""with {_ROUNDS}, p_ as (select sample_id, round_idx, regexp_extract_all(output, '(?s)(?:<Phrase>.*?</Phrase>[^<]*)?(?:<Unit>.*?</Unit>[^<]*)?<REF>(?:[^<]*<REF>)*', 0) as ps from rounds_ where contains(output, '<REF>')),
        q_ as (select sample_id, round_idx, unnest(range(1, len(ps) + 1)) as i, ps from p_)
        select sample_id, round_idx, cast(i - 1 as int) as pos, nullif(regexp_extract(ps[i], '(?s)<Phrase>(.*?)</Phrase>', 1), '') as phrase, nullif(regexp_extract(ps[i], '(?s)<Unit>(.*?)</Unit>', 1), '') as unit, (len(ps[i]) - len(replace(ps[i], '<REF>', ''))) // 5 as n from q_""",
}

_ENCODED = f"""with {_ROUNDS}, e_ as (select *, system_tasks[round_idx + 1] as st from rounds_), y_ as (select *, {_SYSTEM} as sys from e_),
  x_ as (select sample_id, round_idx, case when round_idx = 0 then $${TASK_COMMAND["prefix"]}$$ else '' end || case when coalesce(sys, '') <> '' then sys || chr(10) else '' end || 'USER: ' || replace(input, '<boxes>', '[VPT]') || ' ASSISTANT:' as q, case when output = '' then '' else {_REFERENCED} end as a from y_),
  w_ as (select sample_id, round_idx, list_filter(string_split_regex(regexp_replace(q, '(<image>|\\[VPT\\]|</?[A-Za-z]+>)', ' \\1 ', 'g'), '\\s+'), lambda z: z <> '') as q, list_filter(string_split_regex(regexp_replace(a, '(<image>|\\[VPT\\]|</?[A-Za-z]+>)', ' \\1 ', 'g'), '\\s+'), lambda z: z <> '') as a from x_),
  i_ as (select sample_id, round_idx, list_transform(q, lambda z: case when z = '<image>' then -200 when z = '[VPT]' then -300 else cast('0x' || substring(md5(z), 1, 6) as bigint) % 30000 + 1000 end) as q, list_transform(a, lambda z: case when z = '<image>' then -200 when z = '[VPT]' then -300 else cast('0x' || substring(md5(z), 1, 6) as bigint) % 30000 + 1000 end) as a from w_),
  f_ as (select sample_id, flatten(list(list_concat([1], q, a, [2]) order by round_idx)) as ids, flatten(list(list_concat(list_transform(list_concat([1], q), lambda z: -100), a, [2]) order by round_idx)) as labels from i_ group by sample_id),
  all_ as (select s_.sample_id, list_slice(coalesce(f_.ids, []), 1, 2048) as ids, list_slice(coalesce(f_.labels, []), 1, 2048) as labels from s_ left join f_ on s_.sample_id = f_.sample_id where s_.conversations is not null)"""
SQL["token_encode_labels"] = f"""{_ENCODED} select sample_id, cast(len(ids) as int) as n_ids, cast(coalesce(list_sum(ids), 0) as bigint) as sum_ids, cast(len(list_filter(labels, lambda z: z <> -100)) as int) as n_learned, cast(coalesce(list_sum(list_filter(labels, lambda z: z <> -100)), 0) as bigint) as sum_learned,
  cast(case when len(list_filter(labels, lambda z: z <> -100)) = 0 then len(ids) else list_position(list_transform(labels, lambda z: z <> -100), true) - 1 end as int) as n_prompt from all_"""
SQL["feature_splice"] = f"""{_ENCODED} select sample_id, cast(len(ids) as int) as n_before, cast(len(ids) + 575 * len(list_filter(ids, lambda z: z = -200)) as int) as n_after, cast(576 * len(list_filter(ids, lambda z: z = -200)) as int) as n_image from all_"""
SQL["label_trim"] = f"""with {_ROUNDS}, p_ as (select sample_id, round_idx, list_transform(regexp_extract_all(output, '(?s)(?:<Phrase>.*?</Phrase>[^<]*)?(?:<Unit>.*?</Unit>[^<]*)?<REF>(?:[^<]*<REF>)*', 0), lambda z: (len(z) - len(replace(z, '<REF>', ''))) // 5) as ns from rounds_ where contains(output, '<REF>')),
  l_ as (select *, cast(ceil(list_sum(ns) * 2 / 3) as int) as n_left from p_)
  select sample_id, round_idx, array_to_string(list_filter(list_transform(range(1, len(ns) + 1), lambda k: greatest(0, least(ns[k], n_left - coalesce(list_sum(list_slice(ns, 1, k - 1)), 0)))), lambda z: z > 0), ',') as kept, n_left from l_"""
SQL["batch_padding"] = f"""{_ENCODED}, r_ as (select len(ids) as n, floor((row_number() over (order by md5('42:' || sample_id), sample_id) - 1) / 16) as batch_id from all_)
  select cast(batch_id as bigint) as batch_id, count(*) as n_rows, cast(max(n) as int) as width, cast(max(n) as int) as label_width, cast(sum(n) as bigint) as n_tokens, cast(max(n) as int) as longest from r_ group by 1"""
SQL["session_history"] = f"""with recursive {_TURNS}, l_ as (select sample_id as session, turn_idx as pos, len(coalesce(value, '')) as n from turns_),
  h_ as (select session, pos, n as used, 0 as resets from l_ where pos = 0 union all select l_.session, l_.pos, case when h_.used + l_.n > 300 then l_.n else h_.used + l_.n end, case when h_.used + l_.n > 300 and h_.used > 0 then h_.resets + 1 else h_.resets end from h_ join l_ on l_.session = h_.session and l_.pos = h_.pos + 1)
  select session, pos, cast(used as bigint) as used, cast(resets as int) as resets from h_"""
