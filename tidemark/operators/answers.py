"""Questions of all 23 templates with their gold answers, the answers that other boxes allow, and the grading of replies.

A question is a template asked of an image, if the label boxes answer it. Replies are a plain test input: the answer that
the boxes of a condition allow, spelled, rounded, changed, left out or given another unit by a hash of the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions.shared import apart
from tidemark.operators import templates as T
from tidemark.operators.perturb import _U
from tidemark.sources import entities as E

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Template, level, type of its answer, unit, does the answer depend on the boxes.
KINDS = [
    ("l1_total_count", 1, "int", "ships", True),
    ("l1_quadrant_count", 1, "int", "ships", True),
    ("l1_edge_count", 1, "int", "ships", True),
    ("l1_rect_count", 1, "int", "ships", True),
    ("l1_scene", 1, "category", "none", False),
    ("l1_brightness", 1, "float", "none", False),
    ("l2_nearest_ratio", 2, "float", "percent", True),
    ("l2_longest_length", 2, "float", "px", True),
    ("l2_count_over_length", 2, "int", "ships", True),
    ("l2_longest_neighbor", 2, "float", "px", True),
    ("l2_longest_shortest_distance", 2, "float", "px", True),
    ("l3_quadrant_most_ships", 3, "category", "none", True),
    ("l3_empty_quadrants", 3, "int", "none", True),
    ("l3_quadrant_most_long", 3, "category", "none", True),
    ("l3_quadrant_brightest", 3, "category", "none", False),
    ("l3_quadrant_noisiest", 3, "category", "none", False),
    ("l4_scene_branch", 4, "float", "px", True),
    ("l4_count_branch", 4, "float", "px", True),
    ("l4_quadrant_branch", 4, "float", "px", True),
    ("l4_maxlen_branch", 4, "int", "ships", True),
    ("l4_noise_branch", 4, "int", "ships", True),
    ("l5_noisy_quadrant", 5, "int", "ships", True),
    ("l5_scene_quadrant", 5, "int", "ships", True),
]
#: Spellings of each unit; no unit at all counts as none.
UNITS = {
    "px": ["px", "pixel", "pixels", "픽셀"],
    "ships": ["ships", "ship", "척", "vessels"],
    "percent": ["percent", "%", "pct", "퍼센트"],
    "none": ["none", "", "null", "unitless", "count"],
}
#: Relative and absolute tolerance of float answers.
REL, ABS = 0.05, 1e-12
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
#: Conditions that are asked here, by the boxes that they give.
INPUTS = ((1, "label"), (2, "detected"))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _per_image(spark: SparkSession, sf_dir: str, source: str, boxes: DataFrame | None = None) -> DataFrame:
    """image_id and one array of all templates' answers, in the order of KINDS, named after the source; boxes: those of a source by another name."""
    one = lambda t, kind: F.struct(
        (F.lit(None) if kind == "category" else T.TEMPLATES[t].columns()[1]).cast("double").alias("num"),
        (T.TEMPLATES[t].columns()[1] if kind == "category" else F.lit(None)).cast("string").alias("cat"),
    )
    return T.wide(spark, sf_dir, source if boxes is None else boxes).select("image_id", "scene_group", "split", F.array(*(one(t, kind) for t, _, kind, _, _ in KINDS)).alias(source))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a question: its template's columns, gold_num or gold_cat, and the answer on the detected boxes.

    Both sources meet image by image, before the templates are told apart, so no question is shuffled.
    """
    both = _per_image(spark, sf_dir, "label").join(_per_image(spark, sf_dir, "detected").select("image_id", "detected"), "image_id")
    kinds = F.array(*(F.struct(F.lit(t).alias("template"), F.lit(level).alias("level"), F.lit(kind).alias("answer_type"), F.lit(unit).alias("unit"), F.lit(dep).alias("box_dependent")) for t, level, kind, unit, dep in KINDS))
    each = both.select("image_id", "scene_group", "split", F.explode(F.arrays_zip(kinds.alias("k"), "label", "detected")).alias("x"))
    q = each.select(
        F.concat_ws("-", "x.k.template", "image_id").alias("qid"), "image_id", "scene_group", "split", "x.k.*",
        F.col("x.label.num").alias("gold_num"), F.col("x.label.cat").alias("gold_cat"), F.col("x.detected.num").alias("detected_num"), F.col("x.detected.cat").alias("detected_cat"),
    )
    return q.where("gold_num is not null or gold_cat is not null")


def _sql_on(template: str, source: str) -> str:
    """The template's SQL with the boxes of another source in the labels' place."""
    boxes = E.SQL[source].replace(f"{source} as (", "label as (", 1)
    return T.ORACLE_SQL[template].replace(E.SQL["label"], boxes)


def _answers_sql(source: str) -> str:
    part = lambda t, kind: f"select '{t}' as template, image_id, {'cast(null as double), answer_cat' if kind == 'category' else 'answer, cast(null as varchar)'} from ({_sql_on(t, source)})"
    return f"{source}_answers(template, image_id, num, cat) as (" + "\n union all ".join(part(t, kind) for t, _, kind, _, _ in KINDS) + ")"


_RECORDS = f"""{E.with_entities("images")}, kinds as (select * from (values {", ".join(str(k) for k in KINDS)}) t(template, level, answer_type, unit, box_dependent)),
{_answers_sql("label")},
{_answers_sql("detected")},
records as (select template || '-' || image_id as qid, image_id, scene_group, split, template, level, answer_type, unit, box_dependent, g.num as gold_num, g.cat as gold_cat, d.num as detected_num, d.cat as detected_cat
  from label_answers g join detected_answers d using (template, image_id) join kinds using (template) join images using (image_id) where g.num is not null or g.cat is not null)"""


@query(f"{_RECORDS} select * from records")
def question_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir)


# ---- replies


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions under each condition with num or cat, the answer that its boxes allow, and a reply: said, said_unit."""
    q = records(spark, sf_dir)
    dep = F.col("box_dependent")
    inputs = F.explode(F.array(*(F.struct(F.lit(c).alias("cond"), F.lit(s).alias("input")) for c, s in INPUTS)))
    q = q.withColumn("c", inputs).select("*", "c.*").drop("c")
    own = dep & (F.col("input") == "detected")
    q = q.withColumn("num", F.when(own, F.col("detected_num")).otherwise(F.col("gold_num"))).withColumn("cat", F.when(own, F.col("detected_cat")).otherwise(F.col("gold_cat")))
    q = apart(q, **{f"{what}_u": G.uniform(F.lit(what), F.col("cond"), F.col("qid")) for what in ("reply", "spelling", "unit")})
    u, v, w = (F.col(f"{what}_u") for what in ("reply", "spelling", "unit"))
    num = F.coalesce("num", F.lit(0.0))
    num = F.when(u < 100, num * 1.08 + 1).when(u < 150, num * 1.03).otherwise(num)
    q = apart(q, cents=F.floor(num * 100 + 0.5))
    cents = F.col("cents")
    whole, rest = F.floor(cents / 100).cast("long"), cents % 100
    whole_text = F.when((whole >= 1000) & (v % 3 == 0), F.concat(F.floor(whole / 1000), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    number = F.when((rest == 0) & (v % 2 == 0), F.concat(F.lit(" "), whole_text)).otherwise(F.concat(whole_text, F.lit("."), F.lpad(rest.cast("string"), 2, "0")))
    cat = F.when(u < 100, "middle").otherwise(F.coalesce("cat", F.lit("nowhere")))
    word = F.when(v % 4 == 1, F.upper(cat)).when(v % 4 == 2, F.replace(cat, F.lit("_"), F.lit(" "))).when(v % 4 == 3, F.concat(F.lit(" "), F.replace(cat, F.lit("_"), F.lit("-")))).otherwise(cat)
    said = F.when(u >= 50, F.when(F.col("answer_type") == "category", word).when(v < 20, "about a dozen").otherwise(number))
    spelled = F.get(reduce(lambda e, k: e.when(F.col("unit") == k, F.array(*map(F.lit, UNITS[k]))), UNITS, F.when(F.lit(False), F.array(F.lit("")))), w % 4)
    said_unit = F.when(w < 60, F.when(F.col("unit") == "px", "ships").otherwise("px")).when(w < 80, "furlongs").when((w < 120) & (F.col("unit") == "none"), F.lit(None)).otherwise(F.concat(F.lit(" "), F.upper(spelled)))
    return apart(q, said=said, said_unit=said_unit).drop("reply_u", "spelling_u", "unit_u", "cents")


def as_number(said: Column) -> Column:
    """The finite number that a text says, thousands' commas allowed; null if it says none."""
    plain = F.replace(F.trim(said), F.lit(","), F.lit(""))
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def as_category(said: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(said)), "[ -]", "_")


def as_unit(said: Column) -> Column:
    """The unit's name; null for a spelling that isn't known, none where nothing is said."""
    key = F.lower(F.trim(said))
    known = reduce(lambda e, k: e.when(key.isin(UNITS[k]), k), UNITS, F.when(said.isNull(), "none"))
    return known


def value_matches(said: Column, num: Column, cat: Column, kind: Column, number: Column | None = None) -> Column:
    """Whole numbers exactly, other numbers within the tolerance, categories by their normalised names; number: as_number of said, if it is there."""
    x = as_number(said) if number is None else number
    off = F.abs(x - num)
    right = F.when(kind == "category", as_category(said) == as_category(cat)).when(kind == "int", (x == num) & (x == F.floor(x))).otherwise(off <= REL * F.abs(num) + ABS)
    return F.coalesce(right, F.lit(False))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with correct, unit_only_fix, answer_format_ok, input_error, agent_error and cell.

    A reply that is missing is wrong and the agent's fault; where the boxes allow no answer nothing is held against the agent.
    """
    kind, said, gold_num, gold_cat = F.col("answer_type"), F.col("said"), F.col("gold_num"), F.col("gold_cat")
    r = apart(replies(spark, sf_dir), u=as_unit(F.col("said_unit")), x=as_number(said))
    unit_ok = F.coalesce(F.col("u") == F.col("unit"), F.lit(False))
    r = apart(r, value_ok=value_matches(said, gold_num, gold_cat, kind, F.col("x")), agrees=value_matches(said, F.col("num"), F.col("cat"), kind, F.col("x")))
    value_ok = F.col("value_ok")
    readable = F.when(kind == "category", said.isNotNull()).otherwise(F.col("x").isNotNull())
    nothing = F.col("num").isNull() & F.col("cat").isNull()
    # the allowed answer is judged as a reply would be, by the same tolerance
    allowed = F.when(kind == "category", F.col("cat") == gold_cat).when(kind == "int", F.col("num") == gold_num).otherwise(F.abs(F.col("num") - gold_num) <= REL * F.abs(gold_num) + ABS)
    r = r.select(
        "qid", "cond", "template", "level", "scene_group", "said",
        (value_ok & unit_ok).alias("correct"), (value_ok & ~unit_ok).alias("unit_only_fix"), (said.isNotNull() & F.col("u").isNotNull() & readable).alias("answer_format_ok"),
        (F.col("box_dependent") & ~F.coalesce(allowed, F.lit(False))).alias("input_error"),
        F.when(said.isNull(), True).when(nothing, False).otherwise(~(F.col("agrees") & unit_ok)).alias("agent_error"),
    )
    both = F.col("input_error") & F.col("agent_error")
    cell = F.when(F.col("correct"), F.when(both, "lucky_correct").otherwise("correct")).when(both, "both").when(F.col("input_error"), "input_only").otherwise("agent_only")
    return r.withColumn("cell", cell)


_N = lambda x: f"case when regexp_matches(replace(trim({x}), ',', ''), '{NUMBER}') then try_cast(replace(trim({x}), ',', '') as double) end"
_C = lambda x: f"regexp_replace(lower(trim({x})), '[ -]', '_', 'g')"
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
_MATCH = lambda num, cat: f"coalesce(case answer_type when 'category' then {_C('said')} = {_C(cat)} when 'int' then x = {num} and x = floor(x) else abs(x - {num}) <= {REL} * abs({num}) + {ABS} end, false)"
_GRADED = f"""{_RECORDS}, i0 as (select r.*, cond, case when box_dependent and input = 'detected' then detected_num else gold_num end as num, case when box_dependent and input = 'detected' then detected_cat else gold_cat end as cat,
    {_U("'reply'", "cond", "qid")} as ru, {_U("'spelling'", "cond", "qid")} as rv, {_U("'unit'", "cond", "qid")} as rw from records r cross join (values {", ".join(str(i) for i in INPUTS)}) t(cond, input)),
i1 as (select *, cast(floor(case when ru < 100 then coalesce(num, 0) * 1.08::double + 1 when ru < 150 then coalesce(num, 0) * 1.03::double else coalesce(num, 0) end * 100 + 0.5) as bigint) as cents, case when ru < 100 then 'middle' else coalesce(cat, 'nowhere') end as w0 from i0),
i2 as (select *, case when cents // 100 >= 1000 and rv % 3 = 0 then (cents // 100000) || ',' || lpad(cast(cents // 100 % 1000 as varchar), 3, '0') else cast(cents // 100 as varchar) end as wt from i1),
i3 as (select *, case when ru >= 50 then case when answer_type = 'category' then case rv % 4 when 1 then upper(w0) when 2 then replace(w0, '_', ' ') when 3 then ' ' || replace(w0, '_', '-') else w0 end
    when rv < 20 then 'about a dozen' when cents % 100 = 0 and rv % 2 = 0 then ' ' || wt else wt || '.' || lpad(cast(cents % 100 as varchar), 2, '0') end end as said,
  case when rw < 60 then case when unit = 'px' then 'ships' else 'px' end when rw < 80 then 'furlongs' when rw < 120 and unit = 'none' then null
    else ' ' || upper((case unit {" ".join(f"when '{k}' then [{_LIST(v)}]" for k, v in UNITS.items())} end)[rw % 4 + 1]) end as said_unit from i2),
i4 as (select *, {_N("said")} as x, case when said_unit is null then 'none' {" ".join(f"when lower(trim(said_unit)) in ({_LIST(v)}) then '{k}'" for k, v in UNITS.items())} end as u from i3),
i5 as (select *, {_MATCH("gold_num", "gold_cat")} as value_ok, coalesce(u = unit, false) as unit_ok, {_MATCH("num", "cat")} as agrees from i4),
i6 as (select qid, cond, template, level, scene_group, value_ok and unit_ok as correct, value_ok and not unit_ok as unit_only_fix,
  said is not null and u is not null and (answer_type = 'category' or x is not null) as answer_format_ok,
  box_dependent and not coalesce(case answer_type when 'category' then cat = gold_cat when 'int' then num = gold_num else abs(num - gold_num) <= {REL} * abs(gold_num) + {ABS} end, false) as input_error,
  case when said is null then true when num is null and cat is null then false else not (agrees and unit_ok) end as agent_error from i5),
answers as (select *, case when correct then case when input_error and agent_error then 'lucky_correct' else 'correct' end when input_error and agent_error then 'both' when input_error then 'input_only' else 'agent_only' end as cell from i6)"""


@query(f"{_GRADED} select qid, cond, correct, unit_only_fix, answer_format_ok, input_error, agent_error, cell from answers")
def grade_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reply's grade by its question's type and unit, and whose error it is."""
    return graded(spark, sf_dir).select("qid", "cond", "correct", "unit_only_fix", "answer_format_ok", "input_error", "agent_error", "cell")


_SHARE = "floor(count(*) filter (correct) / count(*) * 10000 + 0.5) / 10000.0"


@query(f"{_GRADED} select cond, template, level, count(*) as n, count(*) filter (correct) as correct, count(*) filter (unit_only_fix) as unit_only_fix, count(*) filter (not answer_format_ok) as bad_format, {_SHARE} as accuracy from answers group by all")
def accuracy_by_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """23 rows a condition; counted before the shuffle, so only the groups travel."""
    n, right = F.count("*"), F.count_if("correct")
    return graded(spark, sf_dir).groupBy("cond", "template", "level").agg(n.alias("n"), right.alias("correct"), F.count_if("unit_only_fix").alias("unit_only_fix"), F.count_if(~F.col("answer_format_ok")).alias("bad_format"), G.floor4(right / n).alias("accuracy"))


@query(f"{_GRADED} select cond, level, cell, count(*) as n from answers group by all")
def answer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose error it is, by level and condition."""
    return graded(spark, sf_dir).groupBy("cond", "level", "cell").agg(F.count("*").alias("n"))
