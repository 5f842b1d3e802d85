"""A question set under joint caps, filled in rounds.

Candidates are all 23 templates on all eligible images of a split, in an order by hash. Caps hold at once for a template (its
quota), an image, a scene group, equal answers of a template and zeros of a template. In a round every template proposes its
next candidates that no full cap shuts out, as many as it still lacks; each cap lets in the first of them up to what it has
left, and a candidate that all its caps let in stays for good. The best proposal of all always stays, so rounds come to an end,
when no template has a candidate to propose: then the set can't be added to without breaking a cap.

A round scans the candidates once; templates' next ones are cut off before the shuffle, and all that is compared after that are
as many rows as the quotas add up to. Templates that fall short are reported, never padded.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions.shared import cut, filed, once
from tidemark.operators import answers, reference, tools
from tidemark.operators import templates as T
from tidemark.sources import entities as E

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Questions an image, times the mean that a group may have, shares of equal answers and of zeros, boxes of an eligible image.
PER_IMAGE, GROUP_FACTOR, SAME, ZERO, FEWEST, MOST = 2, 3, 0.5, 0.2, 2, 15
#: Questions of each template in the test split.
QUOTAS = {
    "l1_total_count": 14, "l1_quadrant_count": 14, "l1_edge_count": 12, "l1_rect_count": 12, "l1_scene": 10, "l1_brightness": 10,
    "l2_nearest_ratio": 18, "l2_longest_length": 18, "l2_count_over_length": 18, "l2_longest_neighbor": 18, "l2_longest_shortest_distance": 18,
    "l3_quadrant_most_ships": 22, "l3_empty_quadrants": 20, "l3_quadrant_most_long": 12, "l3_quadrant_brightest": 18, "l3_quadrant_noisiest": 18,
    "l4_scene_branch": 16, "l4_count_branch": 18, "l4_quadrant_branch": 18, "l4_maxlen_branch": 20, "l4_noise_branch": 18,
    "l5_noisy_quadrant": 6, "l5_scene_quadrant": 12,
}
SPLIT, PREFIX = "test", "T"
#: The order of a template's candidates, and of proposals at a cap.
ORDER = ("pri", "template", "image_id")
CANDIDATE = "template string, image_id long, scene_group int, balance string, zero boolean, pri string"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def branches() -> dict:
    """The branch that a template takes on an image, by the columns of templates.wide."""
    noisy = T._at_largest("n", "noise")
    inshore = F.col("scene") == "inshore"
    return {
        "l4_scene_branch": inshore, "l4_count_branch": F.col("n_boxes") >= T.BRANCH_BOXES, "l4_quadrant_branch": F.col(f"n_{G.QUADRANTS[0]}") >= T.BRANCH_QUADRANT, "l4_maxlen_branch": F.col("max_side") >= 55,
        "l4_noise_branch": F.col("noise_full") > T.BRANCH_NOISE, "l5_noisy_quadrant": noisy >= 2, "l5_scene_quadrant": inshore,
    }


def _eligible(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """The split's images with a fitting number of boxes, written."""
    many = E.raw_boxes(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("many")).where(F.col("many").between(FEWEST, MOST))
    return filed(E.images(spark, sf_dir).where(F.col("split") == split).join(many.select("image_id"), "image_id", "left_semi"))


def candidates(spark: SparkSession, sf_dir: str, split: str = SPLIT) -> DataFrame:
    """template, level, answer_type, image_id, scene_group, gold_num, gold_cat, balance, zero, pri: the templates that an eligible image answers.

    balance is what must not be equal too often: the branch where there is one, else the answer. Answers are told for eligible images alone.
    """
    images = once(spark, sf_dir, _eligible, split)
    boxes = E.labels(spark, sf_dir).join(images.select("image_id"), "image_id", "left_semi")
    if boxes.where(" or ".join(f"{c} is null" for c in reference.BOX)).isEmpty():
        wide = reference._wide(boxes.withColumn("of", F.lit(1)), tools.with_stats(images, E.table(spark, sf_dir, "embeddings")), 1)
    else:
        # boxes without a place go by the tools that take them
        wide = T.wide(spark, sf_dir, boxes).join(images.select("image_id"), "image_id", "left_semi")
    took = branches()

    def one(t, level, kind):
        value = T.TEMPLATES[t].columns()[1]
        num, cat = (F.lit(None), value) if kind == "category" else (value, F.lit(None))
        num, cat = num.cast("double"), cat.cast("string")
        cents = F.floor(num * 10000 + 0.5).cast("long").cast("string")
        balance = F.when(took[t], "then").otherwise("else") if t in took else cat if kind == "category" else cents
        return F.struct(F.lit(t).alias("template"), F.lit(level).alias("level"), F.lit(kind).alias("answer_type"), num.alias("gold_num"), cat.alias("gold_cat"), balance.alias("balance"))

    each = wide.select("image_id", "scene_group", F.explode(F.array(*(one(t, level, kind) for t, level, kind, _, _ in answers.KINDS))).alias("x")).select("image_id", "scene_group", "x.*")
    each = each.where("gold_num is not null or gold_cat is not null")
    return each.withColumns({"zero": F.coalesce(F.col("gold_num") == 0, F.lit(False)), "pri": F.md5(F.concat_ws("|", "template", "image_id").cast("binary"))})


def caps(quotas: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """template, quota, most equal answers (a quota under three has no such cap), most zeros."""
    share = lambda q, s: max(1, math.ceil(q * s))
    return [(t, q, share(q, SAME) if q >= 3 else q, share(q, ZERO)) for t, q in quotas.items()]


def group_cap(quotas: dict[str, int], groups: int) -> int:
    return max(1, math.ceil(GROUP_FACTOR * sum(quotas.values()) / max(1, groups)))


def assign(found: DataFrame, quotas: dict[str, int], per_image: int = PER_IMAGE) -> DataFrame:
    """The candidates taken, as they came, with `round` from 1; found has the columns of CANDIDATE and may have more.

    (template, image_id) is unique; a null answer to balance counts as one more value. What is taken grows by rounds and
    is written after each.
    """
    spark = found.sparkSession
    bound = F.broadcast(spark.createDataFrame(caps(quotas), "template string, quota int, same_cap int, zero_cap int"))
    able = filed(found.join(bound, "template").where("quota > 0").withColumn("balance", F.coalesce("balance", F.lit(""))))
    groups = able.select("scene_group").distinct().count()
    # key of a cap, what it allows, the rows that it counts
    limits = [
        (["image_id"], F.lit(per_image), F.lit(True)), (["scene_group"], F.lit(group_cap(quotas, groups)), F.lit(True)),
        (["template", "balance"], F.col("same_cap"), F.lit(True)), (["template"], F.col("zero_cap"), F.col("zero")),
    ]
    taken, number = able.where("false").withColumn("round", F.lit(0)), 0
    most = max(quotas.values(), default=0)
    while True:
        number += 1
        # all that is taken is as many rows as the quotas add up to
        free = able.join(F.broadcast(taken.select("template", "image_id")), ["template", "image_id"], "left_anti")
        for key, cap, counts in limits:
            full = taken.where(counts).groupBy(*key).agg(F.count("*").alias("used"), F.max(cap).alias("cap")).where("used >= cap").select(*key, F.lit(True).alias("full"))
            free = free.join(F.broadcast(full), key, "left").where(F.col("full").isNull() | ~counts).drop("full")
        used = taken.groupBy("template").agg(F.count("*").alias("used"))
        nth = F.row_number().over(W.partitionBy("template").orderBy("pri", "image_id"))
        asked = free.withColumn("nth", nth).where(F.col("nth") <= most)
        asked = cut(asked.join(F.broadcast(used), "template", "left").where(F.col("nth") <= F.col("quota") - F.coalesce("used", F.lit(0))).drop("nth", "used"))
        if asked.isEmpty():
            return taken.drop("quota", "same_cap", "zero_cap")
        passed = asked.withColumn("ok", F.lit(True))
        for key, cap, counts in limits:
            used = taken.where(counts).groupBy(*key).agg(F.count("*").alias("used"))
            before = F.sum(counts.cast("int")).over(W.partitionBy(*key).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0))
            passed = passed.withColumn("nth", before).join(used, key, "left").withColumn("ok", F.col("ok") & (~counts | (F.col("nth") <= cap - F.coalesce("used", F.lit(0))))).drop("nth", "used")
        taken = cut(taken.unionByName(passed.where("ok").drop("ok").withColumn("round", F.lit(number))))


def generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test split's questions with their places in their template's order; written once for all tables over them."""
    return once(spark, sf_dir, _generate)


def _generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(candidates(spark, sf_dir), QUOTAS)


_TOOK = {
    "l4_scene_branch": "scene = 'inshore'", "l4_count_branch": f"n_boxes >= {T.BRANCH_BOXES}", "l4_quadrant_branch": f"n_top_left >= {T.BRANCH_QUADRANT}", "l4_maxlen_branch": "max_side >= 55",
    "l4_noise_branch": f"noise_full > {T.BRANCH_NOISE}", "l5_noisy_quadrant": f"{T._pick('n', f'({T._most("noise")})')} >= 2", "l5_scene_quadrant": "scene = 'inshore'",
}
_FACTS = f"{E.with_entities('images', 'label')}{T.with_tools('facts', 'stats')}".replace("with ", "with recursive ", 1)
_CAPS = "caps as (select * from (values " + ", ".join(str(c) for c in caps(QUOTAS)) + ") t(template, quota, same_cap, zero_cap))"
_KINDS = "kinds as (select * from (values " + ", ".join(f"('{t}', {level}, '{kind}', {i})" for i, (t, level, kind, _, _) in enumerate(answers.KINDS)) + ") t(template, level, answer_type, place))"
_LIMITS = [("image_id", str(PER_IMAGE), "true"), ("scene_group", "group_cap", "true"), ("template, balance", "same_cap", "true"), ("template", "zero_cap", "zero")]
_SAME = lambda key, a, b: " and ".join(f"{a}.{k} = {b}.{k}" for k in key.split(", "))
_SET = f"""{_FACTS}, {_KINDS}, {_CAPS}, {answers._answers_sql("label")},
branch as ({" union all ".join(f"select '{t}' as template, image_id, case when {c} then 'then' else 'else' end as took from facts {T._JOIN}" for t, c in _TOOK.items())}),
cand as materialized (select a.template, a.image_id, scene_group, num as gold_num, cat as gold_cat, coalesce(b.took, a.cat, cast(floor(num * 10000 + 0.5)::bigint as varchar)) as balance, coalesce(num = 0, false) as zero, md5(a.template || '|' || a.image_id) as pri, quota, same_cap, zero_cap
  from label_answers a join facts f using (image_id) join caps using (template) left join branch b on b.template = a.template and b.image_id = a.image_id
  where f.split = '{SPLIT}' and n_boxes between {FEWEST} and {MOST} and (num is not null or cat is not null)),
bounds as materialized (select greatest(1, ceil({GROUP_FACTOR} * {sum(QUOTAS.values())}::double / greatest(1, count(distinct scene_group))))::bigint as group_cap from cand),
filled(round, born, template, image_id, scene_group, balance, zero) as (select 0, 0, null::varchar, null::bigint, null::int, null::varchar, null::boolean
  union all (with been as (select * from filled), latest as (select max(round) as now from been),
    free as (select c.*, group_cap, {", ".join(f"(select count(*) from been t where {_SAME(key, 't', 'c')}{' and t.zero' if counts == 'zero' else ''}) as used_{i}" for i, (key, _, counts) in enumerate(_LIMITS))}, (select count(*) from been t where t.template = c.template) as used
      from cand c, bounds where not exists (select 1 from been t where t.template = c.template and t.image_id = c.image_id)),
    asked as (select * from (select *, row_number() over (partition by template order by pri, image_id) as nth from free where {" and ".join(f"(used_{i} < {cap}{'' if counts == 'true' else f' or not {counts}'})" for i, (_, cap, counts) in enumerate(_LIMITS))}) where nth <= quota - used),
    passed as (select * from (select *, {", ".join(f"sum(({counts})::int) over (partition by {key} order by pri, template, image_id rows unbounded preceding) as nth_{i}" for i, (key, _, counts) in enumerate(_LIMITS))} from asked)
      where {" and ".join(f"(nth_{i} <= {cap} - used_{i}{'' if counts == 'true' else f' or not {counts}'})" for i, (_, cap, counts) in enumerate(_LIMITS))})
    select now + 1, born, template, image_id, scene_group, balance, zero from been, latest where exists (select 1 from passed)
    union all select now + 1, now + 1, template, image_id, scene_group, balance, zero from passed, latest)),
taken as (select f.born as round, c.* from filled f join cand c on c.template = f.template and c.image_id = f.image_id where f.round = (select max(round) from filled)),
qids as (select '{PREFIX}-L' || level || '-' || printf('%03d', row_number() over (partition by level order by place, pri, image_id)) as qid, t.*, level, answer_type from taken t join kinds using (template))"""


@query(f"{_SET} select qid, template, level, answer_type, image_id, scene_group, gold_num, gold_cat, round from qids")
def generated_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions, numbered by level in the order of their templates; as many rows as the quotas add up to at most."""
    place = reduce(lambda e, i: e.when(F.col("template") == answers.KINDS[i][0], F.lit(i)), range(len(answers.KINDS)), F.when(F.lit(False), F.lit(0)))
    nth = F.row_number().over(W.partitionBy("level").orderBy(place, "pri", "image_id"))
    return generate(spark, sf_dir).select(F.format_string(f"{PREFIX}-L%d-%03d", "level", nth).alias("qid"), "template", "level", "answer_type", "image_id", "scene_group", "gold_num", "gold_cat", "round")


@query(
    f"""{_SET}, equal as (select template, max(n) as most_equal from (select template, balance, count(*) as n from taken group by all) group by template)
  select c.template, c.quota, count(t.image_id) as n, c.quota - count(t.image_id) as short, count(*) filter (t.zero) as zeros, c.zero_cap, coalesce(max(most_equal), 0) as most_equal, c.same_cap from caps c left join taken t using (template) left join equal using (template) group by c.template, c.quota, c.zero_cap, c.same_cap"""
)
def generation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each template's questions against its caps, and how many it is short of."""
    g = generate(spark, sf_dir)
    by = g.groupBy("template", "balance").agg(F.count("*").alias("c"), F.count_if("zero").alias("z"))
    by = by.groupBy("template").agg(F.sum("c").alias("n"), F.sum("z").alias("zeros"), F.max("c").alias("most_equal"))
    bound = spark.createDataFrame(caps(QUOTAS), "template string, quota int, same_cap int, zero_cap int")
    return bound.join(by, "template", "left").fillna(0).select("template", "quota", "n", (F.col("quota") - F.col("n")).alias("short"), "zeros", "zero_cap", "most_equal", "same_cap")


@query(
    f"""{_SET} select 'most of an image' as what, coalesce((select max(n) from (select count(*) as n from taken group by image_id)), 0) as found, {PER_IMAGE}::bigint as cap
  union all select 'most of a group', coalesce((select max(n) from (select count(*) as n from taken group by scene_group)), 0), group_cap from bounds
  union all select 'questions', (select count(*) from taken), {sum(QUOTAS.values())} union all select 'asked twice', (select count(*) from (select 1 from taken group by template, image_id having count(*) > 1)), 0"""
)
def generation_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the whole set may have at most, and has."""
    g = generate(spark, sf_dir)
    most = lambda *key: g.groupBy(*key).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("found"))
    # every eligible image answers how many boxes it has, so the candidates' groups are theirs
    groups = once(spark, sf_dir, _eligible, SPLIT).select("scene_group").distinct().count()
    parts = {
        "most of an image": (most("image_id"), PER_IMAGE), "most of a group": (most("scene_group"), group_cap(QUOTAS, groups)), "questions": (g.agg(F.count("*").alias("found")), sum(QUOTAS.values())),
        "asked twice": (g.groupBy("template", "image_id").count().where("count > 1").agg(F.count("*").alias("found")), 0),
    }
    return reduce(DataFrame.unionByName, (df.select(F.lit(what).alias("what"), "found", F.lit(cap).cast("long").alias("cap")) for what, (df, cap) in parts.items()))
