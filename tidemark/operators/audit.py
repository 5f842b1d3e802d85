"""What goes to a second reader and what errors come down to: strata with a minimum each, shares of cells, causes and stages,
and the cells in which two readers disagree with their codes and places.

Strata, cells and codes are as many as there are kinds of errors, so what is shared out among them is a small table; rows are
ranked inside their stratum and cut at the cap before they are dealt, so a stratum with most of the rows is no large task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions.ordering import numbered
from tidemark.functions.shared import cut, filed
from tidemark.operators import runs
from tidemark.operators.runs import _GRADED
from tidemark.sources.entities import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Wrong runs in a sample, of each stratum at least, conditions whose errors are told apart, largest cells of disagreement, examples of each.
CAP, LEAST, ASKED, TOP, SHOWN = 120, 5, (1, 2, 4, 5), 4, 2
#: Hex digits of an md5 by which rows are counted before they are ranked.
DIGITS = 3
#: Cells, kinds of input errors.
CELLS, CAUSES = ("correct", "lucky_correct", "input_only", "agent_only", "both"), ("miss", "fp", "multiple", "composite")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def allotted(sizes: DataFrame, cap: int, least: int) -> DataFrame:
    """stratum, n, take: how many of each stratum's n rows a sample of cap rows takes.

    Everything if there are no more rows than cap. Else each stratum has `least` rows (all, if it has fewer), or the largest
    smaller minimum that fits the cap; if not even one row each fits, the largest strata have one. What is left of the cap is
    shared out by the rows that are left, by largest remainder; ties: the larger stratum, then its name. Strata without rows
    take none. All in whole numbers; sizes is one row a stratum and small.
    """
    w = W.partitionBy()
    fits = [F.when(F.sum(F.least(F.lit(m), F.col("n"))).over(w) <= cap, F.lit(m)).otherwise(0) for m in range(1, least + 1)]
    d = sizes.select("stratum", F.col("n").cast("long").alias("n")).withColumns({"total": F.sum("n").over(w), "m": F.greatest(F.lit(0), F.lit(0), *fits)})
    place = F.row_number().over(W.orderBy(F.desc("n"), "stratum"))
    d = d.withColumn("first", F.when(F.col("m") > 0, F.least("m", "n")).otherwise(F.when((F.col("n") > 0) & (place <= cap), 1).otherwise(0)).cast("long"))
    d = d.withColumn("spare", cap - F.sum("first").over(w)).withColumn("room", F.col("n") - F.col("first")).withColumn("rooms", F.greatest(F.sum("room").over(w), F.lit(1)))
    d = d.withColumns({"base": F.expr("spare * room div rooms"), "rest": F.expr("spare * room % rooms")})
    extra = F.row_number().over(W.orderBy(F.desc("rest"), F.desc("n"), "stratum")) <= F.col("spare") - F.sum("base").over(w)
    return d.select("stratum", "n", F.when(F.col("total") <= cap, F.col("n")).otherwise(F.col("first") + F.col("base") + extra.cast("long")).alias("take"))


def _allotted_sql(cap: int, least: int) -> str:
    fits = ", ".join(f"case when sum(least({m}, n)) over () <= {cap} then {m} else 0 end" for m in range(1, least + 1))
    return f"""minimum as (select *, sum(n) over () as total, greatest(0, 0, {fits}) as m, row_number() over (order by n desc, stratum) as place from sizes),
firsts as (select *, case when m > 0 then least(m, n) when n > 0 and place <= {cap} then 1 else 0 end as first from minimum),
rooms as (select *, ({cap} - sum(first) over ())::bigint as spare, n - first as room, greatest(sum(n - first) over (), 1)::bigint as rooms from firsts),
allotted as (select stratum, n, case when total <= {cap} then n else first + spare * room // rooms + (row_number() over (order by spare * room % rooms desc, n desc, stratum) <= spare - sum(spare * room // rooms) over ())::int end::bigint as take from rooms)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded runs with their stage ('none' without an agent's error) and cause ('none' without an error of the detections). A scan of the images' numbers."""
    g = runs.with_cause(spark, sf_dir)
    return g.withColumn("stage", F.when(F.col("agent_error"), F.col("stage")).otherwise("none"))


_JUDGED = f"""{_GRADED}, causes as ({runs.ORACLE_SQL["input_cause"][len(_GRADED):]}),
told_runs as (select g.* exclude (stage), case when agent_error then g.stage else 'none' end as stage, coalesce(c.cause, 'none') as cause from graded g left join causes c using (run_id))"""
_WRONG = f"{_JUDGED}, wrong as (select run_id, cell || '|' || stage || '|' || cause as stratum from told_runs where not correct), sizes as (select stratum, count(*) as n from wrong group by stratum), {_allotted_sql(CAP, LEAST)}"


def wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id and stratum (cell, stage, cause) of the wrong runs."""
    return judged(spark, sf_dir).where(~F.col("correct")).select("run_id", F.concat_ws("|", "cell", "stage", "cause").alias("stratum"))


def sampled(rows: DataFrame, key: str, cap: int, least: int) -> DataFrame:
    """key, stratum of the rows that allotted takes of each stratum, those with the smallest md5 of their key; rows: key (a text, unique) and stratum.

    Rows are counted by stratum and the first digits of the md5; only those up to the digits in which a stratum's share is full
    are sorted. Keys and strata are filed, so that what they are made of is told once; rows aren't shuffled.
    """
    rows = filed(rows.select(key, "stratum"))
    dealt = rows.select(key, "stratum", F.md5(F.col(key).cast("binary")).alias("place")).withColumn("digits", F.substring("place", 1, DIGITS))
    by = cut(dealt.groupBy("stratum", "digits").agg(F.count("*").alias("n")))
    shares = allotted(by.groupBy("stratum").agg(F.sum("n").alias("n")), cap, least)
    before = F.coalesce(F.sum("n").over(W.partitionBy("stratum").orderBy("digits").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # digits that begin before a share is full: as many as all shares add up to at most
    asked = by.withColumn("before", before).drop("n").join(F.broadcast(shares), "stratum").where(F.col("before") < F.col("take")).select("stratum", "digits", "take")
    r = F.row_number().over(W.partitionBy("stratum").orderBy("place", key))
    return dealt.join(F.broadcast(asked), ["stratum", "digits"]).withColumn("r", r).where("r <= take").select(key, "stratum")


@query(f"{_WRONG} select stratum, n, take from allotted")
def audit_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strata of the wrong runs and what a sample takes of each."""
    return allotted(wrong(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("n")), CAP, LEAST)


@query(f"{_WRONG} select run_id, stratum from (select *, row_number() over (partition by stratum order by md5(run_id), run_id) as r from wrong) join allotted using (stratum) where r <= take")
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wrong runs that go to a second reader (the cap is the feature)."""
    return sampled(wrong(spark, sf_dir), "run_id", CAP, LEAST)


_PARTS = {"cell": ("cell", CELLS, "true"), "cause": ("cause", CAUSES, "input_error"), "stage": ("stage", runs.STAGES, "agent_error"), "failure": ("fail_kind", runs.FAIL_KINDS, "fail_kind is not null")}
_SHARE = lambda a, b: f"case when {b} > 0 then floor({a} / {b}::double * 10000 + 0.5) / 10000.0 end"


@query(
    f"{_JUDGED}, grid as (select * from (values "
    + ", ".join(f"('{part}', '{name}')" for part, (_, names, _) in _PARTS.items() for name in (*names, "all"))
    + ") t(part, name)), long as ("
    + " union all ".join(f"select cond, '{part}' as part, {col} as name from told_runs where cond in {ASKED} and {of}" for part, (col, _, of) in _PARTS.items())
    + f"""), runs_of as (select cond, count(*) as total from told_runs where cond in {ASKED} group by cond), n as (select cond, part, name, count(*) as runs from long group by all union all select cond, part, 'all', count(*) from long group by cond, part),
  filled as (select r.cond, g.part, g.name, coalesce(n.runs, 0) as runs, total from grid g cross join runs_of r left join n on n.cond = r.cond and n.part = g.part and n.name = g.name)
  select cond, part, name, runs, {_SHARE("runs", "total")} as share_of_all, {_SHARE("runs", "max(runs) filter (name = 'all') over (partition by cond, part)")} as share_of_part from filled"""
)
def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four conditions by cell, cause of the input error, stage of the agent's first deviation and kind of failure; empty ones and sums (`all`) too.

    One aggregation by condition tells all of them; a part without a run has null as its share.
    """
    j = judged(spark, sf_dir).where(F.col("cond").isin(*ASKED))
    n = lambda e: F.count_if(F.coalesce(F.expr(e), F.lit(False)))
    counts = {(part, name): n(of if name == "all" else f"{of} and {col} = '{name}'") for part, (col, names, of) in _PARTS.items() for name in (*names, "all")}
    by = j.groupBy("cond").agg(F.count("*").alias("total"), *(e.alias(f"{part}_{name}") for (part, name), e in counts.items()))
    one = lambda part, name: F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), F.col(f"{part}_{name}").alias("runs"), F.col(f"{part}_all").alias("of"))
    each = by.select("cond", "total", F.explode(F.array(*(one(*k) for k in counts))).alias("x")).select("cond", "total", "x.*")
    share = lambda of: F.when(F.col(of) > 0, G.floor4(F.col("runs") / F.col(of)))
    return each.select("cond", "part", "name", "runs", share("total").alias("share_of_all"), share("of").alias("share_of_part"))


# ---- two readers


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, a, b, code (the language, '?' if there is none), rank: labelled documents in an order by hash; a and b are the two readers' labels."""
    found = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("a"), F.col("toxic").alias("b")).join(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("code")), "doc_id")
    found = found.withColumn("shuffled", F.md5(F.col("doc_id").cast("string").cast("binary")))
    return numbered(found, [], F.substring("shuffled", 1, 3), ["shuffled", "doc_id"], "rank").drop("shuffled")


_RANKED = f"""with ranked as (select doc_id, quality as a, toxic as b, coalesce(lang, '?') as code, row_number() over (order by md5(doc_id::varchar), doc_id) as rank from labels join documents using (doc_id)),
off as (select * from ranked where a <> b), cells as (select a, b, n from (select *, row_number() over (order by n desc, a, b) as r from (select a, b, count(*) as n from off group by a, b)) where r <= {TOP})"""


def largest_cells(off: DataFrame) -> DataFrame:
    """a, b, n of the TOP largest cells; ties: the smaller labels."""
    r = F.row_number().over(W.orderBy(F.desc("n"), "a", "b"))
    return off.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("r", r).where(F.col("r") <= TOP).drop("r")


@query(f"{_RANKED} select a, b, cells.n, code, count(*) as code_n, row_number() over (partition by a, b order by count(*) desc, code) as place from off join cells using (a, b) group by a, b, cells.n, code")
def disagreement_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest cells of disagreement with a histogram of their codes."""
    off = ranked(spark, sf_dir).where("a <> b")
    by = off.groupBy("a", "b", "code").agg(F.count("*").alias("code_n"))
    place = F.row_number().over(W.partitionBy("a", "b").orderBy(F.desc("code_n"), "code"))
    return by.join(F.broadcast(largest_cells(off)), ["a", "b"]).select("a", "b", "n", "code", "code_n", place.cast("long").alias("place"))


@query(f"{_RANKED} select a, b, doc_id, rank, row_number() over (partition by a, b order by rank) <= {SHOWN} as shown from off join cells using (a, b)")
def disagreement_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the largest cells with its place in the order; those with the smallest places in a cell are its examples.

    Examples are found by their rank, cut before the shuffle, so that a cell with most of the rows isn't sorted by one task.
    """
    off = cut(ranked(spark, sf_dir).where("a <> b"))
    own = off.join(F.broadcast(largest_cells(off)), ["a", "b"]).select("a", "b", "doc_id", "rank")
    first = own.withColumn("r", F.row_number().over(W.partitionBy("a", "b").orderBy("rank"))).where(F.col("r") <= SHOWN).select("rank", F.lit(True).alias("first"))
    return own.join(F.broadcast(first), "rank", "left").select("a", "b", "doc_id", "rank", F.coalesce("first", F.lit(False)).alias("shown"))
