"""Agreement of two raters, stratified samples and apportionment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import bootstrap
from tidemark.functions import geometry as G
from tidemark.functions.ordering import numbered
from tidemark.sources import entities as E
from tidemark.sources.entities import table, with_entities

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SAMPLE, PER_STRATUM, DRAWS = 300, 20, 200
#: Keys of a table that one task puts in order.
BUCKET_KEYS = 100_000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def hashed(*key):
    return F.md5(F.concat_ws("|", *key).cast("binary"))


@query("select quality as a, toxic as b, count(*) as n from labels group by all")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("a"), F.col("toxic").alias("b")).agg(F.count("*").alias("n"))


_KAPPA = "select n, po, pe, case when pe <> 1 then floor((po - pe) / (1 - pe) * 10000 + 0.5) / 10000.0 end as kappa from (select n, same / n as po, (cast(a1 as double) * b1 + cast(n - a1 as double) * (n - b1)) / n / n as pe from (select count(*) as n, count(*) filter (quality = toxic) as same, count(*) filter (quality = 1) as a1, count(*) filter (toxic = 1) as b1 from labels))"


def kappa_columns():
    n, a, b = F.col("n"), F.col("a1").cast("double"), F.col("b1")
    po, pe = F.col("same") / n, (a * b + (n - F.col("a1")).cast("double") * (n - b)) / n / n
    return po, pe


@query(_KAPPA)
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed and expected agreement from one pass of counts; null where the raters can't but agree."""
    s = table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == F.col("toxic")).alias("same"), F.count_if(F.col("quality") == 1).alias("a1"), F.count_if(F.col("toxic") == 1).alias("b1"))
    po, pe = kappa_columns()
    s = s.select("n", po.alias("po"), pe.alias("pe"))
    k = (F.col("po") - F.col("pe")) / (1 - F.col("pe"))
    return s.select("n", "po", "pe", F.when(F.col("pe") != 1, F.floor(k * 10000 + 0.5) / 10000.0).alias("kappa"))


@query("select coalesce(lang, 'all') as lang, count(*) as n, count(*) filter (quality = toxic) as agree from labels join documents using (doc_id) group by rollup(lang)")
def agreement_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return joined.rollup("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == F.col("toxic")).alias("agree")).select(F.coalesce("lang", F.lit("all")).alias("lang"), "n", "agree")


@query("select 'matched' as kind, count(*) as n from labels where doc_id in (select doc_id from documents) union all select 'without document', count(*) from labels where doc_id not in (select doc_id from documents)")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, ids = table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id")
    one = lambda how, kind: labels.join(ids, "doc_id", how).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one("left_semi", "matched").unionByName(one("left_anti", "without document"))


@query("select a, b, n, r from (select *, row_number() over (order by n desc, a, b) as r from (select quality as a, toxic as b, count(*) as n from labels where quality <> toxic group by quality, toxic)) where r <= 4")
def disagreement_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "labels").where("quality <> toxic").groupBy(F.col("quality").alias("a"), F.col("toxic").alias("b")).agg(F.count("*").alias("n"))
    # a cell for each pair of codes
    return cells.withColumn("r", F.row_number().over(W.orderBy(F.desc("n"), "a", "b")).cast("long")).where("r <= 4")


_STRATA = "strata as (select scene || '|' || scene_group % 4 as stratum, count(*) as n from images group by 1)"
_APPORTION = f"{_STRATA}, exact as (select stratum, n, {SAMPLE} * n // t as base, {SAMPLE} * n % t as rest from strata, (select sum(n) as t from strata)), apportioned as (select stratum, cast(base + cast(row_number() over (order by rest desc, stratum) <= {SAMPLE} - sum(base) over () as int) as bigint) as seats from exact)"


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.images(spark, sf_dir).withColumn("stratum", F.concat_ws("|", "scene", F.col("scene_group") % 4))


@query(f"{with_entities('images')}, {_APPORTION} select stratum, seats from apportioned")
def apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest remainder in whole numbers; windows over as many rows as there are strata."""
    w = W.partitionBy()
    n = strata(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("n")).withColumn("t", F.sum("n").over(w))
    e = n.withColumn("base", F.expr(f"{SAMPLE} * n div t")).withColumn("rest", F.expr(f"{SAMPLE} * n % t"))
    extra = F.row_number().over(W.orderBy(F.desc("rest"), "stratum")) <= SAMPLE - F.sum("base").over(w)
    return e.select("stratum", (F.col("base") + extra.cast("int")).alias("seats"))


@query(f"{with_entities('images')}, {_APPORTION} select image_id, stratum from (select image_id, i.scene || '|' || i.scene_group % 4 as stratum, row_number() over (partition by i.scene || '|' || i.scene_group % 4 order by md5(image_id::varchar), image_id) as r from images i) join apportioned using (stratum) where r <= seats")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(W.partitionBy("stratum").orderBy(hashed("image_id"), "image_id"))
    ranked = strata(spark, sf_dir).select("image_id", "stratum", r.alias("r")).where(F.col("r") <= SAMPLE)
    return ranked.join(F.broadcast(apportion(spark, sf_dir)), "stratum").where("r <= seats").select("image_id", "stratum")


@query(f"{with_entities('images')} select image_id, round_no from (select image_id, row_number() over (partition by scene || '|' || scene_group % 4 order by md5(image_id::varchar), image_id) as round_no from images) where round_no <= {PER_STRATUM}")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image of each stratum a round; the rank is cut before the shuffle as well as after."""
    r = F.row_number().over(W.partitionBy("stratum").orderBy(hashed("image_id"), "image_id"))
    return strata(spark, sf_dir).select("image_id", r.cast("long").alias("round_no")).where(F.col("round_no") <= PER_STRATUM)


@query(f"{with_entities('images')} select image_id, level from (select image_id, image_id % 5 + 1 as level, row_number() over (partition by image_id % 5 order by case when image_id % 10 < 8 then 0 else 1 end, md5(image_id::varchar), image_id) as r from images) where r <= 12")
def pilot_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed share of each level, questions that need boxes first."""
    i = F.col("image_id")
    w = W.partitionBy(i % 5).orderBy(F.when(i % 10 < 8, 0).otherwise(1), hashed("image_id"), "image_id")
    return E.images(spark, sf_dir).select("image_id", (i % 5 + 1).alias("level"), F.row_number().over(w).alias("r")).where("r <= 12").drop("r")


@query(f"{with_entities('images')} select image_id % 5 + 1 as level, scene, count(*) as n, count(*) filter (image_id % 10 < 8) as box_dependent from images group by all")
def question_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("image_id")
    return E.images(spark, sf_dir).groupBy((i % 5 + 1).alias("level"), "scene").agg(F.count("*").alias("n"), F.count_if(i % 10 < 8).alias("box_dependent"))


@query("select 'T-' || (o_orderkey % 5 + 1) || '-' || printf('%06d', row_number() over (partition by o_orderkey % 5 order by o_orderkey)) as qid, o_orderkey as image_id from orders")
def assign_qids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    # keys are unique, so a bucket has no more rows than it spans keys
    rows = numbered(table(spark, sf_dir, "orders").select((k % 5 + 1).alias("level"), k), ["level"], F.floor(k / BUCKET_KEYS), [k], "r")
    return rows.select(F.format_string("T-%d-%06d", "level", "r").alias("qid"), k.alias("image_id"))


@query("with e as (select user_id, ts, event_type, lag(event_type) over (partition by user_id order by ts, event_type, value) as before from events) select user_id, count(*) as changes from e where before is not null and before <> event_type group by user_id")
def server_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often what is seen changes from one record to the next."""
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_type", "value"))
    e = table(spark, sf_dir, "events").select("user_id", "event_type", before.alias("before"))
    return e.where("before is not null and before <> event_type").groupBy("user_id").agg(F.count("*").alias("changes"))


@query(
    f"""with rows as (select row_number() over (order by doc_id, quality, toxic) - 1 as k, quality, toxic from labels), g as (select count(*) as g from rows),
  draws as (select b, ('0x' || substr(md5(b || '|' || j), 1, 8))::bigint % g as k from g, unnest(range(0, {DRAWS})) t(b), unnest(range(0, g)) u(j)),
  c as (select b, count(*) as n, count(*) filter (quality = toxic) as same, count(*) filter (quality = 1) as a1, count(*) filter (toxic = 1) as b1 from draws join rows using (k) group by b),
  e as (select same / n as po, (cast(a1 as double) * b1 + cast(n - a1 as double) * (n - b1)) / n / n as pe from c),
  v as (select row_number() over (order by (po - pe) / (1 - pe)) as r, (po - pe) / (1 - pe) as kappa from e where pe <> 1)
  select floor(max(kappa) filter (r = {int(0.025 * DRAWS) + 1}) * 1000000 + 0.5) / 1000000.0 as low, floor(max(kappa) filter (r = {int(0.975 * DRAWS) + 1}) * 1000000 + 0.5) / 1000000.0 as high, count(*) as used from v"""
)
def kappa_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap by rows, order statistics as bounds. A draw is a place among the rows in the order of their ids, and takes that row.

    Draws meet the rows in a join on the place and are summed by replicate before they travel on.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    g = labels.count()
    # rows without an id come last
    last = F.coalesce(F.floor(F.col("doc_id") / BUCKET_KEYS), F.lit(2**62))
    rows = numbered(labels, [], last, [F.asc_nulls_last(c) for c in ("doc_id", "quality", "toxic")], "r").select((F.col("r") - 1).alias("k"), "quality", "toxic")
    k = bootstrap.drawn(F.col("b"), F.col("j"), F.lit(max(1, g)))
    draws = spark.range(DRAWS * g).select((F.col("id") % DRAWS).alias("b"), F.floor(F.col("id") / DRAWS).alias("j")).select("b", k.alias("k"))
    c = draws.join(rows, "k").groupBy("b").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == F.col("toxic")).alias("same"), F.count_if(F.col("quality") == 1).alias("a1"), F.count_if(F.col("toxic") == 1).alias("b1"))
    po, pe = kappa_columns()
    v = c.select(po.alias("po"), pe.alias("pe")).where("pe <> 1").select(((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))
    xs = v.agg(F.sort_array(F.collect_list("kappa")).alias("x"))  # DRAWS numbers
    at = lambda p: F.floor(F.get("x", int(p * DRAWS)) * 1000000 + 0.5) / 1000000.0
    return xs.select(at(0.025).alias("low"), at(0.975).alias("high"), F.size("x").cast("long").alias("used"))
