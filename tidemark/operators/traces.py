"""Recorded calls compared with expected plans: which calls match, what kind of deviation is left, which comes first.

A question's plan calls a tool for each step. The recorded trace is the plan with one edit chosen by hash: a call left
out, a call made twice, a changed argument, or none. A question's calls are arrays of one row, its key is all that is
shuffled, and what is left unmatched is told by array expressions; no trace is folded in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions.shared import apart
from tidemark.operators.perturb import _U
from tidemark.sources import entities as E
from tidemark.sources.entities import with_entities

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: The tools a plan's steps call in turn.
TOOLS = ("detect", "spatial", "metadata", "stats", "calc")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _tool(step: Column) -> Column:
    return F.element_at(F.array(*(F.lit(t) for t in TOOLS)), ((F.col("qid") + step) % 5 + 1).cast("int"))


def _arg(step: Column) -> Column:
    return ((F.col("qid") + 7 * step) % 4).cast("int")


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, step, tool, arg: two to six calls for each question."""
    i = F.col("image_id")
    steps = E.images(spark, sf_dir).select(i.alias("qid"), F.explode(F.sequence(F.lit(1), (i % 5 + 2).cast("int"))).alias("step"))
    return steps.select("qid", "step", _tool(F.col("step")).alias("tool"), _arg(F.col("step")).alias("arg"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, plan (step, tool, arg) and trace (turn, tool, arg, after the edit) as arrays: one row a question.

    An image that is there several times has each step as often.
    """
    # a key is little to shuffle and much to work on, so the number of tasks doesn't follow the bytes
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    images = E.images(spark, sf_dir).select(F.col("image_id").alias("qid")).repartition(tasks, "qid")
    asked = images.groupBy("qid").agg(F.count("*").cast("int").alias("copies"))
    asked = apart(asked, edit=G.uniform(F.lit("edit"), F.col("qid")) % 5, at=G.uniform(F.lit("at"), F.col("qid")) % 6 + 1)
    n = (F.col("qid") % 5 + 2).cast("int")
    steps = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda s: F.array_repeat(s, F.col("copies"))))
    plan = F.transform(steps, lambda s: F.struct(s.alias("step"), _tool(s).alias("tool"), _arg(s).alias("arg")))
    asked = apart(asked.where(n > 0), plan=plan)
    edit = F.col("edit")

    def edited(p: Column) -> Column:
        call = lambda tool, arg: F.array(F.struct(p["step"].alias("step"), tool.alias("tool"), arg.alias("arg")))
        hit = F.when(edit == 1, F.array(p, p)).when(edit == 2, call(p["tool"], p["arg"] + 10)).when(edit == 3, call(F.lit("other"), p["arg"]))
        return F.when(p["step"] != F.col("at"), F.array(p)).otherwise(F.coalesce(hit, F.slice(F.array(p), 1, 0)))

    calls = F.when((edit == 4) | (F.col("at") > n), F.col("plan")).otherwise(F.flatten(F.transform("plan", edited)))
    trace = F.transform(calls, lambda c, i: F.struct((i + 1).alias("turn"), c["tool"].alias("tool"), c["arg"].alias("arg")))
    return asked.select("qid", "plan", trace.alias("trace"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, turn, tool, arg: the plan's calls after the edit."""
    return questions(spark, sf_dir).select("qid", F.explode("trace").alias("c")).select("qid", "c.*")


_PLANS = f"""{with_entities("images")}, plans as (select qid, step, ['{"', '".join(TOOLS)}'][(qid + step) % 5 + 1] as tool, cast((qid + 7 * step) % 4 as int) as arg from (select image_id as qid, cast(unnest(range(1, image_id % 5 + 3)) as int) as step from images)),
edits as (select *, {_U("'edit'", "qid")} % 5 as kind, step = {_U("'at'", "qid")} % 6 + 1 as hit from plans),
traces as (select qid, cast(row_number() over (partition by qid order by step, copy) as int) as turn, tool, arg from (
  select qid, step, case when kind = 3 and hit then 'other' else tool end as tool, case when kind = 2 and hit then arg + 10 else arg end as arg, unnest(range(1, case when kind = 1 and hit then 3 else 2 end)) as copy from edits where not (kind = 0 and hit)))"""


@query(f"{_PLANS} select * from plans")
def expected_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans(spark, sf_dir)


@query(f"{_PLANS} select * from traces")
def trace_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir)


@query(f"{_PLANS} select qid, count(*) as gold_calls, greatest(2 * count(*), count(*) + 3) as budget from plans group by qid")
def gold_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return plans(spark, sf_dir).groupBy("qid").agg(n.alias("gold_calls"), F.greatest(2 * n, n + 3).alias("budget"))


KEY = ("qid", "tool", "arg")


def bag(df: DataFrame, order: str) -> DataFrame:
    """Equal calls are told apart by their rank, so that a join on key and rank takes each once."""
    return df.withColumn("k", F.row_number().over(W.partitionBy(*KEY).orderBy(order)))


def call_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, tool, arg, k, step, turn: step is null for an extra call, turn for a missing one."""
    return bag(plans(spark, sf_dir), "step").join(bag(traces(spark, sf_dir), "turn"), [*KEY, "k"], "full_outer")


_SIDES = f"""{_PLANS}, pb as (select *, row_number() over (partition by qid, tool, arg order by step) as k from plans), tb as (select *, row_number() over (partition by qid, tool, arg order by turn) as k from traces),
sides as (select coalesce(pb.qid, tb.qid) as qid, coalesce(pb.tool, tb.tool) as tool, coalesce(pb.arg, tb.arg) as arg, step, turn from pb full outer join tb on pb.qid = tb.qid and pb.tool = tb.tool and pb.arg = tb.arg and pb.k = tb.k)"""


@query(f"{_SIDES} select qid, count(*) filter (step is not null and turn is not null) as matched, count(*) filter (turn is null) as missing, count(*) filter (step is null) as extra from sides group by qid")
def call_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = F.col("step").isNotNull(), F.col("turn").isNotNull()
    return call_sides(spark, sf_dir).groupBy("qid").agg(F.count_if(s & t).alias("matched"), F.count_if(~t).alias("missing"), F.count_if(~s).alias("extra"))


def _left(own: Column, other: Column, field: str) -> Column:
    """What is left of own, in its order, when each takes one of other that is equal by a field."""
    same = lambda c: lambda d: d[field] == c[field]
    return F.filter(own, lambda c, i: c[field].isNull() | (F.size(F.filter(F.slice(own, 1, i + 1), same(c))) > F.size(F.filter(other, same(c)))))


def _keys(calls: Column, side: str) -> Column:
    """A text for each call, the same for equal ones; a call without a tool or an argument equals none."""
    return F.transform(calls, lambda c, i: F.when(c["tool"].isNotNull() & c["arg"].isNotNull(), F.concat_ws("|", c["arg"].cast("string"), c["tool"])).otherwise(F.concat_ws(" ", F.lit(side), i)))


def _ranked(keys: Column) -> Column:
    """Texts that are there several times are told apart by their rank."""
    rank = lambda k, i: F.concat_ws(" ", F.size(F.filter(F.slice(keys, 1, i + 1), lambda x: x == k)), k)
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.transform(keys, lambda k: F.concat_ws(" ", F.lit(1), k))).otherwise(F.transform(keys, rank))


def unmatched(rows: DataFrame, plan: str, trace: str, name: str) -> DataFrame:
    """rows with an array of turn and kind: a leftover of each side with the same tool is a wrong argument, otherwise any two are a wrong tool."""
    rows = apart(rows, keys_plan=_keys(F.col(plan), "plan"), keys_trace=_keys(F.col(trace), "trace"))
    rows = apart(rows, ranked_plan=_ranked(F.col("keys_plan")), ranked_trace=_ranked(F.col("keys_trace")))
    left = lambda own, other, side: F.filter(own, lambda _, i: ~F.array_contains(other, F.get(f"ranked_{side}", i)))
    rows = apart(rows, left_plan=left(F.col(plan), F.col("ranked_trace"), "plan"), left_trace=left(F.col(trace), F.col("ranked_plan"), "trace"))
    m, x = F.col("left_plan"), F.col("left_trace")
    rows = apart(rows, rest_plan=_left(m, x, "tool"), rest_trace=_left(x, m, "tool"))
    m, rest = F.size("rest_plan"), F.col("rest_trace")
    dev = lambda turn, kind: F.struct(turn.cast("int").alias("turn"), kind.alias("kind"))
    args = F.transform(F.filter(x, lambda c: ~F.exists(rest, lambda r: r["turn"] == c["turn"])), lambda c: dev(c["turn"], F.lit("wrong_args")))
    tools = F.transform(rest, lambda c, i: dev(c["turn"], F.when(i < m, "wrong_tool").otherwise("extra_call")))
    calls = F.array_repeat(dev(F.lit(99), F.lit("missing_call")), F.greatest(m - F.size(rest), F.lit(0)))
    return rows.withColumn(name, F.flatten(F.array(args, tools, calls))).drop(*(f"{x}_{side}" for x in ("keys", "ranked", "left", "rest") for side in ("plan", "trace")))


def deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, turn, kind of what is left unmatched."""
    return unmatched(questions(spark, sf_dir), "plan", "trace", "devs").select("qid", F.explode("devs").alias("d")).select("qid", "d.*")


_DEV = f"""{_SIDES}, mi as (select qid, tool, step, row_number() over (partition by qid, tool order by step) as k from sides where turn is null), ex as (select qid, tool, turn, row_number() over (partition by qid, tool order by turn) as k from sides where step is null),
bytool as (select coalesce(mi.qid, ex.qid) as qid, step, turn from mi full outer join ex on mi.qid = ex.qid and mi.tool = ex.tool and mi.k = ex.k),
m2 as (select qid, step, row_number() over (partition by qid order by step) as j from bytool where turn is null), x2 as (select qid, turn, row_number() over (partition by qid order by turn) as j from bytool where step is null),
dev as (select qid, turn, 'wrong_args' as kind from bytool where step is not null and turn is not null union all
  select coalesce(m2.qid, x2.qid), coalesce(turn, 99), case when turn is null then 'missing_call' when step is null then 'extra_call' else 'wrong_tool' end from m2 full outer join x2 on m2.qid = x2.qid and m2.j = x2.j)"""


@query(f"{_DEV} select qid, turn, kind from dev")
def stage2_devs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deviations(spark, sf_dir)


@query(f"{_DEV} select qid, turn, kind from (select *, row_number() over (partition by qid order by turn, kind) as r from dev) where r = 1")
def first_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest deviation, by one minimum a question."""
    return deviations(spark, sf_dir).groupBy("qid").agg(F.min(F.struct("turn", "kind")).alias("d")).select("qid", "d.turn", "d.kind")


@query(f"{_DEV} select kind, count(*) as n, count(distinct qid) as questions from dev group by kind")
def classification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deviations(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("qid").alias("questions"))


@query(f"{_PLANS} select qid, max(turn) as last_turn, arg_max(case when arg % 2 = 0 then 'then' else 'else' end, turn) as chosen from traces where tool in ('stats', 'metadata') group by qid")
def gold_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last decision of each trace."""
    d = traces(spark, sf_dir).where("tool in ('stats', 'metadata')")
    return d.groupBy("qid").agg(F.max("turn").alias("last_turn"), F.max_by(F.when(F.col("arg") % 2 == 0, "then").otherwise("else"), "turn").alias("chosen"))


@query(f"{_PLANS} select a.qid, a.turn from traces a where exists (select 1 from traces b where b.qid = a.qid and b.tool = a.tool and b.arg = a.arg and b.turn < a.turn)")
def repeated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(W.partitionBy(*KEY).orderBy("turn"))
    return traces(spark, sf_dir).withColumn("k", k).where("k > 1").select("qid", "turn")


@query(f"{_DEV}, t as (select qid, count(*) as calls from traces group by qid), p as (select qid, count(*) as gold from plans group by qid) select cause, count(*) as n from (select case when calls <= gold then 'within plan' when exists (select 1 from dev where dev.qid = t.qid and kind = 'extra_call') then 'extra call' else 'other' end as cause from t join p using (qid)) group by cause")
def budget_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = traces(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("calls"))
    gold = plans(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("gold"))
    extra = deviations(spark, sf_dir).where("kind = 'extra_call'").select("qid").distinct().withColumn("extra", F.lit(True))
    joined = calls.join(gold, "qid").join(extra, "qid", "left")
    return joined.groupBy(F.when(F.col("calls") <= F.col("gold"), "within plan").when(F.col("extra"), "extra call").otherwise("other").alias("cause")).agg(F.count("*").alias("n"))


@query(f"{_PLANS}, alt as (select qid, 0 as plan, step, tool, arg from plans union all select qid, 1, step, tool, case when step = 1 then arg + 10 else arg end from plans), score as (select qid, plan, count(*) filter (not exists (select 1 from traces t where t.qid = alt.qid and t.tool = alt.tool and t.arg = alt.arg)) as unmatched from alt group by qid, plan) select qid, plan, unmatched from (select *, row_number() over (partition by qid order by unmatched, plan) as r from score) where r = 1")
def best_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two allowed plans the one with fewer unmatched calls, the first of equal ones."""
    p = plans(spark, sf_dir)
    alt = p.withColumn("plan", F.lit(0)).unionByName(p.withColumn("arg", F.when(F.col("step") == 1, F.col("arg") + 10).otherwise(F.col("arg"))).withColumn("plan", F.lit(1)))
    seen = traces(spark, sf_dir).select(*KEY).distinct().withColumn("seen", F.lit(True))
    score = alt.join(seen, [*KEY], "left").groupBy("qid", "plan").agg(F.count_if(F.col("seen").isNull()).alias("unmatched"))
    return score.groupBy("qid").agg(F.min(F.struct("unmatched", "plan")).alias("b")).select("qid", "b.plan", "b.unmatched")
