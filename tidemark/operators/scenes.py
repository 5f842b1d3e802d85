"""Scenes: images by the scene in their file name, groups joined by images of the same content, and examples of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import classify as C
from tidemark.operators.data_prep import merged
from tidemark.operators.perturb import _U
from tidemark.sources.entities import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: The group whose origin isn't known, kinds of a clear wrong call.
UNKNOWN, WRONG_CALLS = "G0137", ("wrong_tool", "wrong_args", "missing_call")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, name, tag, digest: images as their files are named; a few have the content of others."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y = k % 800, k % 600
    name = F.when(k % 3 == 0, F.format_string("P%04d.jpg", c)).otherwise(F.format_string("P%04d_%d_%d_%d_%d.jpg", c, x, x + 800, y, y + 800))
    content = F.when(k % 16 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(k.cast("string"))
    return table(spark, sf_dir, "orders").select(k.alias("image_id"), name.alias("name"), F.when(F.col("o_orderstatus") == "F", "inshore").otherwise("offshore").alias("tag"), F.md5(content.cast("binary")).alias("digest"))


def scene_rows(images: DataFrame) -> DataFrame:
    """image_id, group, own (the group by name), method, tag, crop; a name that doesn't parse gives no scene and no row.

    Images of one content are tied to the smallest group that holds it, one edge an image, and the groups so joined go
    under the smallest name.
    """
    part = lambda i: F.regexp_extract("name", r"^P(\d+)(?:_(\d+)_(\d+)_(\d+)_(\d+))?\.jpg$", i)
    own = images.withColumn("scene", part(1)).where("scene <> ''").withColumn("own", F.concat(F.lit("G"), "scene"))
    own = own.withColumn("crop", F.when(part(2) != "", F.concat_ws(" ", *(part(i) for i in range(2, 6)))))
    first = own.groupBy("digest").agg(F.min("own").alias("a"), F.max("own").alias("most")).where("a < most").select("digest", "a")
    edges = own.join(first, "digest").where("a <> own").select("a", F.col("own").alias("b")).distinct()
    roots = merged(own.select(F.col("own").alias("node")).distinct(), edges)
    method = F.when(F.col("root") != F.col("own"), "byte_identical_link").when(F.col("crop").isNotNull(), "filename_scene_and_crop").otherwise("filename_scene_only")
    return own.join(roots, F.col("own") == F.col("node")).select("image_id", F.col("root").alias("group"), "own", method.alias("method"), "tag", "crop")


_SCENES = """with recursive named as (select o_orderkey as image_id, 'G' || printf('%04d', o_custkey) as own, case when o_orderstatus = 'F' then 'inshore' else 'offshore' end as tag,
  case when o_orderkey % 3 <> 0 then (o_orderkey % 800) || ' ' || (o_orderkey % 800 + 800) || ' ' || (o_orderkey % 600) || ' ' || (o_orderkey % 600 + 800) end as crop,
  case when o_orderkey % 16 = 0 then strftime(o_orderdate, '%Y-%m-%d') else cast(o_orderkey as varchar) end as content from orders),
e as (select distinct a.own as a, b.own as b from named a join named b on a.content = b.content and a.own <> b.own),
walk as (select own as node, own as seen from named union select w.node, e.b from walk w join e on e.a = w.seen),
roots as (select node, min(seen) as root from walk group by node),
scenes as (select image_id, root as "group", own, case when root <> own then 'byte_identical_link' when crop is not null then 'filename_scene_and_crop' else 'filename_scene_only' end as method, tag, crop from named join roots on own = node)"""


@query(f"{_SCENES} select * from scenes")
def scene_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene_rows(named(spark, sf_dir))


@query(
    f"""{_SCENES} select "group", count(*) as n_images, count(*) filter (tag = 'inshore') as n_inshore, coalesce(bool_or(own = '{UNKNOWN}'), false) as origin_unknown,
  coalesce(string_agg(distinct own, ' ' order by own) filter (own <> "group"), '') as merged_from from scenes group by 1"""
)
def scene_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a group, with the names that were merged into it: counts by name first, so names and not images are gathered."""
    by_name = scene_rows(named(spark, sf_dir)).groupBy("group", "own").agg(F.count("*").alias("n"), F.count_if(F.col("tag") == "inshore").alias("i"))
    others = F.sort_array(F.collect_list(F.when(F.col("own") != F.col("group"), F.col("own"))))
    return by_name.groupBy("group").agg(F.sum("n").alias("n_images"), F.sum("i").alias("n_inshore"), F.bool_or(F.col("own") == UNKNOWN).alias("origin_unknown"), F.array_join(others, " ").alias("merged_from"))


@query(f"{_SCENES} select method, count(*) as n_images, floor(count(*) / (select count(*) from scenes) * 10000 + 0.5) / 10000.0 as fraction from scenes group by method")
def scene_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = scene_rows(named(spark, sf_dir)).groupBy("method").agg(F.count("*").alias("n_images"))
    total = n.agg(F.sum("n_images").alias("total"))  # three methods, one row
    return n.join(F.broadcast(total), F.lit(True)).select("method", "n_images", G.floor4(F.col("n_images") / F.col("total")).alias("fraction"))


@query(
    f"""{C._FIRST}, real as (select qid, count(*) as n, max(case when stage = 2 and kind in {WRONG_CALLS} then turn end) as t from devs where not harmless group by qid),
  pool as (select f.*, n, (select count(*) from ca where ca.qid = f.qid) as calls from first f join real using (qid) join rec using (qid)
    where {_U("'sample'", "qid")} >= 50 and not (has_answer and answer = reachable and unit = '{C.UNIT}')
      and (f.stage <> 2 or exists (select 1 from devs d where d.qid = f.qid and d.stage = 2 and not d.harmless and d.turn = f.turn and d.kind in {WRONG_CALLS})))
  select stage, qid, kind, n as deviations, calls from (select *, row_number() over (partition by stage order by n > 1, calls, qid) as r from pool) where r = 1"""
)
def pick_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each stage one run that failed there and isn't in the labelled sample: with a single deviation if there is one,
    then with the fewest calls, then by id. A run for tool selection has a clear wrong call at its first deviation.

    The best run of a stage is a minimum, so six rows are kept by each task.
    """
    devs = C.all_deviations(spark, sf_dir).where("not harmless")
    d = F.col("d")
    first = devs.groupBy("qid").agg(F.count("*").alias("deviations"), F.min(F.struct("turn", "stage", "kind")).alias("d"), F.collect_set(F.when((F.col("stage") == 2) & F.col("kind").isin(*WRONG_CALLS), F.col("turn"))).alias("wrong_at"))
    right = F.col("has_answer") & (F.col("answer_value") == F.col("reachable")) & (F.col("answer_unit") == C.UNIT)
    wrong = C.runs(spark, sf_dir).where(~F.coalesce(right, F.lit(False))).select("qid", F.size("calls").cast("long").alias("calls"))
    pool = first.join(wrong, "qid").where(G.uniform(F.lit("sample"), F.col("qid")) >= 50).where((d["stage"] != 2) | F.array_contains("wrong_at", d["turn"]))
    best = pool.groupBy(d["stage"].alias("stage")).agg(F.min(F.struct((F.col("deviations") > 1).alias("more"), "calls", "qid", d["kind"].alias("kind"), "deviations")).alias("x"))
    return best.select("stage", "x.qid", "x.kind", "x.deviations", "x.calls")
