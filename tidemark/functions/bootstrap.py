"""Bootstrap over groups: one matrix of resample counts, multiplied with the groups' sums of any number of statistics.

A replicate draws as many groups as there are, with replacement, by a hash of its number and the draw's. How often it drew
each group is a row of a sparse matrix (b, k, m). A statistic is a ratio of two sums over questions, of which only the sums by
group are needed: terms (stat, k, num, den). Their product over k gives every statistic of every replicate, so statistics share
their draws and differences of them are paired. Questions never travel; terms are groups times statistics and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REPLICATES = 10_000
LEVELS = (0.025, 0.975)
#: Replicates that a task draws.
PART = 250


def drawn(number: Column, draw: Column, of: Column) -> Column:
    """The number under `of` that a replicate's draw takes."""
    text = F.concat_ws("|", number, draw).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % of


def counts(spark: SparkSession, groups: int, replicates: int = REPLICATES) -> DataFrame:
    """b, k, m: how often replicate b drew group k; groups never drawn have no row."""
    tasks = max(1, min(replicates // PART, int(spark.sparkContext.defaultParallelism) * 4))
    number = spark.range(0, replicates if groups else 0, 1, tasks).withColumnRenamed("id", "b")
    each = number.select("b", F.explode(F.sequence(F.lit(0), F.lit(max(0, groups - 1)))).alias("j"))
    return each.select("b", drawn(F.col("b"), F.col("j"), F.lit(max(1, groups))).alias("k")).groupBy("b", "k").agg(F.count("*").alias("m"))


def replicated(terms: DataFrame, groups: int, replicates: int = REPLICATES) -> DataFrame:
    """stat, b, num, den of each replicate."""
    bound = F.broadcast(terms.select("stat", F.col("k").cast("long").alias("k"), "num", "den"))
    both = counts(terms.sparkSession, groups, replicates).join(bound, "k")
    return both.groupBy("stat", "b").agg(F.sum(F.col("m") * F.col("num")).alias("num"), F.sum(F.col("m") * F.col("den")).alias("den"))


def intervals(sums: DataFrame, group: str = "scene_group", replicates: int = REPLICATES) -> DataFrame:
    """stat, num, den, value, low, high from sums (stat, group, num, den), null values for a statistic over nothing.

    sums holds every group of every statistic once. low and high are percentiles, by linear interpolation, over the
    replicates that have a denominator. Groups are numbered in their order; null is a group of its own.
    """
    # as many rows as groups
    numbers = sums.select(group).distinct().withColumn("k", F.row_number().over(W.orderBy(group)) - 1)
    n = numbers.count()
    terms = sums.join(F.broadcast(numbers.withColumnRenamed(group, "of_group")), sums[group].eqNullSafe(F.col("of_group"))).select("stat", "k", F.col("num").cast("double").alias("num"), F.col("den").cast("double").alias("den"))
    whole = terms.groupBy("stat").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    ratios = replicated(terms, n, replicates).where("den <> 0").groupBy("stat").agg(*(F.percentile(F.col("num") / F.col("den"), F.lit(p)).alias(c) for p, c in zip(LEVELS, ("low", "high"), strict=True)))
    some = F.col("den") != 0
    return whole.join(ratios, "stat", "left").select("stat", "num", "den", F.when(some, F.col("num") / F.col("den")).alias("value"), *(F.when(some, F.col(c)).alias(c) for c in ("low", "high")))


def intervals_sql(sums: str, group: str = "scene_group", replicates: int = REPLICATES) -> str:
    """The same as common table expressions that end in `intervals`; sums: the name of a table (stat, group, num, den)."""
    return f"""numbers as (select {group}, row_number() over (order by {group}) - 1 as k from (select distinct {group} from {sums})), many as (select count(*) as g from numbers),
matrix as (select b, ('0x' || substr(md5(b || '|' || j), 1, 8))::bigint % g as k from many, unnest(range(0, {replicates})) t(b), unnest(range(0, g)) u(j)),
terms as (select stat, k, num::double as num, den::double as den from {sums} s join numbers n on s.{group} is not distinct from n.{group}),
reps as (select stat, b, sum(m * num) as num, sum(m * den) as den from (select b, k, count(*) as m from matrix group by all) join terms using (k) group by stat, b),
bounds as (select stat, {", ".join(f"quantile_cont(num / den, {p}) as {c}" for p, c in zip(LEVELS, ("low", "high"), strict=True))} from reps where den <> 0 group by stat),
intervals as (select stat, num, den, case when den <> 0 then num / den end as value, case when den <> 0 then low end as low, case when den <> 0 then high end as high
  from (select stat, sum(num) as num, sum(den) as den from terms group by stat) left join bounds using (stat))"""
