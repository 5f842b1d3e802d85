"""Splits of scene groups dealt by stratum, the best of a thousand deals.

Groups lie in the order of their strata (share of inshore images, size), by hash within one. A deck has each split as often as
it should have groups, evenly interleaved, so that any run of groups gets about its shares. A seed says how groups are shuffled
within strata and where the deck begins. All seeds are dealt in one job, groups times seeds rows, and the one with the smallest
gaps counts: of each split's share of images against its share of groups, and of its inshore share against all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions.shared import cut
from tidemark.sources import entities as E
from tidemark.sources.entities import with_entities

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Splits, shares of groups (validation, evaluation, dev of evaluation), edges of the inshore share, seeds.
SPLITS = ("det_train", "det_val", "dev", "test")
VAL, EVAL, DEV, EDGES, SEEDS = 0.10, 0.25, 0.30, (0.0, 0.15, 0.40), 1000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def targets(n: int) -> dict[str, int]:
    """How many of n groups each split gets."""
    evaluation = round(EVAL * n)
    dev, val = round(DEV * evaluation), round(VAL * n)
    return dict(zip(SPLITS, (n - val - evaluation, val, dev, evaluation - dev), strict=True))


def groups(images: DataFrame) -> DataFrame:
    """scene_group, n, inshore, stratum of images (scene_group, scene); a group is big if it has more images than the middle one."""
    own = images.groupBy("scene_group").agg(F.count("*").alias("n"), F.count_if(F.col("scene") == "inshore").alias("inshore"))
    # as many rows as groups
    sizes = own.agg(F.sort_array(F.collect_list("n")).alias("sizes")).select(F.get("sizes", F.floor(F.size("sizes") / 2).cast("int")).alias("middle"))
    ratio = F.col("inshore") / F.col("n")
    bins = sum((ratio > e).cast("int") for e in EDGES)
    return own.join(F.broadcast(sizes), F.lit(True)).select("scene_group", "n", "inshore", F.concat(F.lit("ins"), bins, F.when(F.col("n") > F.col("middle"), "_big").otherwise("_small")).alias("stratum"))


def deck(spark: SparkSession, n: int) -> DataFrame:
    """place (from 0), split: as many rows as groups."""
    own = spark.createDataFrame([(k, c) for k, c in targets(n).items() if c], "split string, c int")
    each = own.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    place = F.row_number().over(W.orderBy((F.col("i") + 0.5) / F.col("c"), "split")) - 1
    return each.select(place.alias("place"), "split")


def deal(found: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """seed, scene_group, n, inshore, stratum, split of every seed's deal; found: as groups gives it."""
    spark = found.sparkSession
    found = cut(found)
    n = found.count()
    each = found.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    order = F.row_number().over(W.partitionBy("seed").orderBy("stratum", F.md5(F.concat_ws("|", "seed", "scene_group").cast("binary")), "scene_group")) - 1
    place = ((order + G.chance("shift", F.col("seed")) % max(1, n)) % max(1, n)).cast("int")
    return each.withColumn("place", place).join(F.broadcast(deck(spark, n)), "place").drop("place")


def scores(dealt: DataFrame) -> DataFrame:
    """seed, score: the squared gaps of all splits that have a group, to nine decimals."""
    per = dealt.groupBy("seed", "split").agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("inshore").alias("i"))
    whole = W.partitionBy("seed")
    share = F.col("n") / F.sum("n").over(whole) - F.col("g") / F.sum("g").over(whole)
    ins = F.col("i") / F.col("n") - F.sum("i").over(whole) / F.sum("n").over(whole)
    gaps = per.select("seed", F.floor((share * share + ins * ins) * 1e12 + 0.5).cast("long").alias("gap"))
    return gaps.groupBy("seed").agg((F.floor(F.sum("gap") / 1000 + 0.5) / 1e9).alias("score"))


def best(dealt: DataFrame) -> DataFrame:
    """The rows of the seed with the smallest score, the first of equal ones."""
    dealt = cut(dealt)
    first = scores(dealt).agg(F.min(F.struct("score", "seed"))["seed"].alias("seed"))
    return dealt.join(F.broadcast(first), "seed")


_DEAL = f"""{with_entities("images")}, own as (select scene_group, count(*) as n, count(*) filter (scene = 'inshore') as inshore from images group by scene_group),
grp as (select *, 'ins' || ({" + ".join(f"(inshore / n > {e})::int" for e in EDGES)}) || case when n > (select list_sort(list(n))[len(list(n)) // 2 + 1] from own) then '_big' else '_small' end as stratum from own),
num as (select count(*) as g, round_even({EVAL} * count(*), 0)::int as ev, round_even({VAL} * count(*), 0)::int as val from grp), tgt as (select g, ev, val, round_even({DEV} * ev, 0)::int as dev from num),
want as (select unnest(['{"', '".join(SPLITS)}']) as split, unnest([g - val - ev, val, dev, ev - dev]) as c from tgt),
deck as (select row_number() over (order by (i + 0.5) / c, split) - 1 as place, split from (select split, c, unnest(range(c)) as i from want)),
dealt as (select d.*, k.split from (select *, (row_number() over (partition by seed order by stratum, md5(seed || '|' || scene_group), scene_group) - 1 + ('0x' || substr(md5('shift|' || seed), 1, 8))::bigint % (select count(*) from grp)) % (select count(*) from grp) as place
  from grp, (select unnest(range({SEEDS})) as seed)) d join deck k using (place)),
per as (select seed, split, count(*) as g, sum(n) as n, sum(inshore) as i from dealt group by all),
gaps as (select seed, floor((power(n / sum(n) over w - g / sum(g) over w, 2) + power(i / n - sum(i) over w / sum(n) over w, 2)) * 1e12 + 0.5)::bigint as gap from per window w as (partition by seed)),
scores as (select seed, floor(sum(gap) / 1000 + 0.5) / 1e9 as score from gaps group by seed),
best as (select * from dealt where seed = (select seed from scores order by score, seed limit 1))"""


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(deal(groups(E.images(spark, sf_dir))))


@query(f"{_DEAL} select seed, score from scores")
def split_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(deal(groups(E.images(spark, sf_dir))))


@query(f"{_DEAL} select scene_group, stratum, split from best")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir).select("scene_group", "stratum", "split")


@query(f"{_DEAL} select split, count(*) as groups, sum(n)::bigint as images, sum(inshore)::bigint as inshore, floor(sum(inshore) / sum(n) * 10000 + 0.5) / 10000 as inshore_ratio, count(distinct stratum) as strata from best group by split")
def stratified_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each split has, in the best deal."""
    return chosen(spark, sf_dir).groupBy("split").agg(F.count("*").alias("groups"), F.sum("n").alias("images"), F.sum("inshore").alias("inshore"), G.floor4(F.sum("inshore") / F.sum("n")).alias("inshore_ratio"), F.countDistinct("stratum").alias("strata"))
