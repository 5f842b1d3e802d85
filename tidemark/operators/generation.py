"""Question slots: which thresholds are clear of the data, which images have unambiguous answers, quotas and balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import tools
from tidemark.operators.tool_queries import _LISTS, LABEL, lists
from tidemark.operators.tools import with_tools
from tidemark.sources import entities as E
from tidemark.sources.entities import table, with_entities

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Margin around a threshold in tenths and in pixels, grid of thresholds, questions an image, quota.
MARGIN, PIXELS, GRID, PER_IMAGE, QUOTA = 10, 2, (20, 60, 5), 2, 40


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


FACTS = f"{with_entities('images', 'label')}{with_tools('facts')}"
_CLEAR = f"(abs(x - t) >= {PIXELS} and {MARGIN} * abs(x - t) >= t)"
_CHOICES = f"{LABEL}, lists as ({_LISTS}), grid as (select unnest(range({GRID[0]}, {GRID[1] + 1}, {GRID[2]})) as t), choices as (select image_id, t from lists, grid where len(list_filter(xs, lambda x: not {_CLEAR})) = 0)"


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, t: thresholds of the grid that no length of the image comes near."""
    grid = F.explode(F.sequence(F.lit(GRID[0]), F.lit(GRID[1]), F.lit(GRID[2]))).alias("t")
    each = lists(spark, sf_dir).select("image_id", "xs", grid)
    gap = lambda x: F.abs(x - F.col("t"))
    return each.where(F.forall("xs", lambda x: (gap(x) >= PIXELS) & (MARGIN * gap(x) >= F.col("t")))).select("image_id", "t")


@query(f"{_CHOICES} select image_id, t from choices")
def threshold_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choices(spark, sf_dir)


@query(f"{_CHOICES} select image_id, t from (select *, row_number() over (partition by image_id order by md5(image_id || '|' || t), t) as r from choices) where r = 1")
def slot_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clear threshold an image, drawn by hash."""
    key = F.md5(F.concat_ws("|", "image_id", "t").cast("binary"))
    return choices(spark, sf_dir).groupBy("image_id").agg(F.min_by("t", F.struct(key, "t")).alias("t"))


@query(f"{LABEL}, lists as ({_LISTS}) select image_id, len([x for x in xs if x = list_max(xs)]) = 1 as longest_alone, len([x for x in xs if x = list_min(xs)]) = 1 as shortest_alone from lists")
def unique_extreme(spark: SparkSession, sf_dir: str) -> DataFrame:
    alone = lambda top: F.size(F.filter("xs", lambda x: x == top)) == 1
    return lists(spark, sf_dir).select("image_id", alone(F.array_max("xs")).alias("longest_alone"), alone(F.array_min("xs")).alias("shortest_alone"))


@query(f"with {tools.SQL['stats']} select vec_id, max(brightness) filter (r = 1) as top, max(brightness) filter (r = 2) as second, max(brightness) filter (r = 1) - max(brightness) filter (r = 2) >= 0.02 * max(brightness) filter (r = 1) as clear from (select *, row_number() over (partition by vec_id order by brightness desc, region) as r from stats where region <> 'full') group by vec_id")
def argmax_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the brightest quadrant leads by two per cent; four values an image, sorted in place."""
    q = tools.pixel_stats(table(spark, sf_dir, "embeddings")).where("region <> 'full'")
    two = q.groupBy("vec_id").agg(F.sort_array(F.collect_list("brightness"), False).alias("b")).select("vec_id", F.get("b", 0).alias("top"), F.get("b", 1).alias("second"))
    return two.withColumn("clear", F.col("top") - F.col("second") >= 0.02 * F.col("top"))


@query(f"{FACTS} select image_id, n_boxes >= 3 as enough, coalesce(max_side > min_side, false) as sides_differ, greatest(n_top_left, n_top_right, n_bottom_left, n_bottom_right) >= 2 as dense, n_boxes between 2 and 15 as eligible from facts")
def question_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tools.facts(E.images(spark, sf_dir), E.labels(spark, sf_dir))
    return f.select("image_id", (F.col("n_boxes") >= 3).alias("enough"), F.coalesce(F.col("max_side") > F.col("min_side"), F.lit(False)).alias("sides_differ"), (F.greatest(*(f"n_{q}" for q in G.QUADRANTS)) >= 2).alias("dense"), F.col("n_boxes").between(2, 15).alias("eligible"))


_GEN = f"""{FACTS}, cand as (select image_id, scene_group, k as template, case k when 0 then n_boxes when 1 then n_edge when 2 then n_long else n_top_left end as answer from (select *, unnest([0, 1, 2, 3]) as k from facts) where n_boxes between 2 and 15),
capped as (select * from (select *, row_number() over (partition by image_id order by md5(image_id || '|' || template), template) as r from cand) where r <= {PER_IMAGE}),
gen as (select template, image_id, answer, q from (select *, row_number() over (partition by template order by md5(template || '|' || image_id), image_id) as q from capped) where q <= {QUOTA})"""


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """template, image_id, answer, q: at most PER_IMAGE templates an image, QUOTA questions a template, both by hash.

    Both caps are the feature (a question set of a fixed size); ranks are cut before each shuffle.
    """
    f = tools.facts(E.images(spark, sf_dir), E.labels(spark, sf_dir)).where(F.col("n_boxes").between(2, 15))
    answers = F.explode(F.array(*(F.struct(F.lit(k).alias("template"), F.col(c).alias("answer")) for k, c in enumerate(("n_boxes", "n_edge", "n_long", "n_top_left"))))).alias("x")
    cand = f.select("image_id", answers).select("image_id", "x.template", "x.answer")
    key = lambda *c: F.md5(F.concat_ws("|", *c).cast("binary"))
    per = F.row_number().over(W.partitionBy("image_id").orderBy(key("image_id", "template"), "template"))
    q = F.row_number().over(W.partitionBy("template").orderBy(key("template", "image_id"), "image_id"))
    capped = cand.withColumn("r", per).where(F.col("r") <= PER_IMAGE)
    return capped.withColumn("q", q.cast("long")).where(F.col("q") <= QUOTA).select("template", "image_id", "answer", "q")


@query(f"{_GEN} select * from gen")
def generate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, sf_dir)


@query(f"{_GEN} select template, count(*) as n, count(*) filter (answer = 0) as zeros, (select max(c) from (select count(*) as c from gen g where g.template = gen.template group by answer)) as most_equal from gen group by template")
def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = generated(spark, sf_dir).groupBy("template", "answer").agg(F.count("*").alias("c"))
    return by.groupBy("template").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("answer") == 0, F.col("c")).otherwise(0)).alias("zeros"), F.max("c").alias("most_equal"))


@query(f"{_GEN} select 'too many for an image' as problem, count(*) as n from (select image_id from gen group by image_id having count(*) > {PER_IMAGE}) union all select 'asked twice', count(*) from (select 1 from gen group by template, image_id having count(*) > 1) union all select 'negative answer', count(*) from gen where answer < 0")
def validate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule's number of violations."""
    g = generated(spark, sf_dir)
    bad = {
        "too many for an image": g.groupBy("image_id").count().where(F.col("count") > PER_IMAGE),
        "asked twice": g.groupBy("template", "image_id").count().where("count > 1"),
        "negative answer": g.where("answer < 0"),
    }
    out = None
    for problem, df in bad.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(problem).alias("problem"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_TEXTS = ("How many ships are there?", "How many ships lie at the edge?", "How many ships are long?", "How many ships lie in the top left?")


@query(f"{_GEN} select 'D-' || (template + 1) || '-' || printf('%03d', q) as qid, [{', '.join(repr(t) for t in _TEXTS)}][template + 1] || ' (image ' || image_id || ')' as question, cast(answer as varchar) || ' count' as gold from gen")
def render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*(F.lit(t) for t in _TEXTS)), F.col("template") + 1)
    return generated(spark, sf_dir).select(F.format_string("D-%d-%03d", F.col("template") + 1, F.col("q")).alias("qid"), F.concat(text, F.lit(" (image "), "image_id", F.lit(")")).alias("question"), F.concat(F.col("answer").cast("string"), F.lit(" count")).alias("gold"))


@query(
    f"""{FACTS}, scan as (select image_id, count(*) as a from label group by image_id), regions as (select image_id, sum(n) as b from (select image_id, x1 + x2 < 800 as l, y1 + y2 < 800 as t, count(*) as n from label group by all) group by image_id)
  select count(*) as images, count(*) filter (coalesce(a, 0) <> coalesce(b, 0))::int as differ from images left join scan using (image_id) left join regions using (image_id)"""
)
def plan_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two plans of one question, a count by region added up and a scan, give the same answers for all images."""
    images, labels = E.images(spark, sf_dir).select("image_id"), E.labels(spark, sf_dir)
    scan = labels.groupBy("image_id").agg(F.count("*").alias("a"))
    regions = labels.groupBy("image_id", G.quadrant().alias("q")).agg(F.count("*").alias("n")).groupBy("image_id").agg(F.sum("n").alias("b"))
    both = images.join(scan, "image_id", "left").join(regions, "image_id", "left").fillna(0)
    return both.agg(F.count("*").alias("images"), F.count_if(F.col("a") != F.col("b")).cast("int").alias("differ"))


@query("select doc_id, nullif(regexp_extract(substr(text, 1, 400), '^\\[(high|medium|low)\\]', 1), '') as confidence from (select doc_id, '[' || ['high', 'medium', 'low', 'other'][doc_id % 4 + 1] || '] ' || text as text from documents)")
def confidence_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.element_at(F.array(*(F.lit(x) for x in ("high", "medium", "low", "other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    tagged = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("["), tag, F.lit("] "), "text").alias("text"))
    return tagged.select("doc_id", F.nullif(F.regexp_extract("text", r"^\[(high|medium|low)\]", 1), F.lit("")).alias("confidence"))


@query("select region_from.n_name as nation, count(distinct c_custkey) as customers from customer join nation region_from on c_nationkey = n_nationkey where n_regionkey in (select r_regionkey from region) group by 1")
def groups_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene groups by their names."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey", "left_semi")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(F.countDistinct("c_custkey").alias("customers"))
