"""Calls matched with the calls that programs make, loops included: by what they ask, then by the shape of what they ask.

A call is a tool with arguments, as JSON. Its key is what the tool's answer depends on. Calls with equal keys are a bag: the
k-th of one side meets the k-th of the other in a join. A call whose references didn't resolve has no arguments to compare; of
those that are left it meets one whose own arguments have the same shape, with every reference replaced by its path. What is
left after that is told by kind: a wrong argument, a wrong tool, a call too many, a call that is missing, or, if a loop should
have made it, an iteration left out. Of several allowed programs the one with the least left over counts.

Programs are expected calls over real boxes (a loop over the quadrants, one over an image's ships); recorded calls are a plain
test input, the calls of one of the programs with a hash's edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions.shared import cut
from tidemark.operators import tools
from tidemark.operators.perturb import _U
from tidemark.sources import entities as E
from tidemark.sources.entities import with_entities

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries of the spatial tool that depend on the region.
REGION_QUERIES = ("count", "sizes", "nearest_pair", "edge")
EXPECTED = "qid long, plan int, step int, tool string, args string, raw string, in_loop boolean"
CALLS = "qid long, turn int, tool string, args string, raw string"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _skeleton(value: Column) -> Column:
    """A reference's path without the call that it names; other values as they are."""
    return F.when(F.startswith(value, F.lit("$")), F.concat(F.lit("ref:"), F.regexp_extract(value, r"^\$[^.]*\.(.*)$", 1))).otherwise(value)


def _region(value: Column) -> Column:
    """A region's name, or its numbers with whole ones as such; the whole image if there is none."""
    numbers = F.from_json(value, "array<double>")
    told = F.concat(F.lit("["), F.array_join(F.transform(numbers, lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))), ","), F.lit("]"))
    return F.coalesce(F.when(F.startswith(value, F.lit("[")) & numbers.isNotNull(), told), value, F.lit("full"))


#: The arguments that a key is made of.
READ = ("region", "query", "ship_a", "ship_b")


def _key(tool: Column, values: dict[str, Column], shape: bool) -> Column:
    read = lambda name: (_skeleton if shape else lambda v: v)(values[name])
    region, asked = _region(read("region")), F.coalesce(read("query"), F.lit("-"))
    ends = [F.coalesce(read(c), F.lit("-")) for c in ("ship_a", "ship_b")]
    spatial = F.concat_ws("|", tool, asked, F.when(asked.isin(*REGION_QUERIES), region).otherwise("-"), *ends)
    return F.when(tool == "spatial_query", spatial).when(tool.isin("detect_ships", "image_stats"), F.concat_ws("|", tool, region)).otherwise(tool)


def call_key(tool: Column, args: Column, shape: bool = False) -> Column:
    """What a call asks, as text; with shape, its references count by their paths. No arguments count as an empty object."""
    return _key(tool, {name: F.get_json_object(args, f"$.{name}") for name in READ}, shape)


def keyed(rows: DataFrame, args: Column, *keep: str) -> DataFrame:
    """keep, key and shape of each call, by call_key of args and of raw; each text is parsed once, not once for every use."""
    both = rows.select(*keep, "tool", "raw", F.json_tuple(args, *READ).alias(*(f"own_{c}" for c in READ))).select("*", F.json_tuple("raw", *READ).alias(*(f"raw_{c}" for c in READ)))
    of = lambda side: {c: F.col(f"{side}_{c}") for c in READ}
    return both.select(*keep, "tool", _key(F.col("tool"), of("own"), False).alias("key"), _key(F.col("tool"), of("raw"), True).alias("shape"))


def _nth(*by: str, order: str) -> Column:
    return F.row_number().over(W.partitionBy(*by).orderBy(order))


def leftovers(expected: DataFrame, calls: DataFrame) -> DataFrame:
    """qid, plan, tool, step, turn, in_loop, raw of what neither level matches: step is null for a call, turn for an expected one.

    expected: EXPECTED; calls: CALLS, whose args are null where references didn't resolve. Calculations aren't matched here.
    Every program of a question is held against all of its calls. Steps and turns are unique in their question and program.

    Both sides are one table, shuffled once by the question. The k-th of one side has met the k-th of the other if the other
    has k of the value at all, so what is left is told by counts beside it, without a join.
    """
    e = keyed(expected.where("tool <> 'calc'"), F.col("args"), "qid", "plan", "step", "in_loop")
    plans = expected.groupBy("qid").agg(F.collect_set("plan").alias("plans"))
    told = calls.where("tool <> 'calc'")
    c = keyed(told, F.coalesce("args", "raw"), "qid", "turn", "args").withColumn("shape", F.when(F.col("args").isNull(), F.col("shape"))).join(plans, "qid").withColumn("plan", F.explode("plans"))
    both = e.select("qid", "plan", "tool", "key", "shape", "step", F.lit(None).cast("int").alias("turn"), "in_loop").unionByName(c.select("qid", "plan", "tool", "key", "shape", F.lit(None).cast("int").alias("step"), "turn", F.lit(False).alias("in_loop")))
    rest = both.repartition("qid")
    mine = F.col("step").isNotNull()
    for by in ("key", "shape"):
        of = W.partitionBy("qid", "plan", by)
        # the side's own number comes first in its order, so one order serves both sides
        here = of.orderBy("step", "turn").rowsBetween(W.unboundedPreceding, W.currentRow)
        k = F.when(mine, F.count("step").over(here)).otherwise(F.count("turn").over(here))
        other = F.when(mine, F.count("turn").over(of)).otherwise(F.count("step").over(of))
        rest = rest.withColumn("met", F.col(by).isNotNull() & (k <= other)).where(~F.col("met")).drop("met")
    return rest.select("qid", "plan", "tool", "step", "turn", "in_loop")


def closest(expected: DataFrame, left: DataFrame) -> DataFrame:
    """qid, plan, n_left: each question's program with the least left over on both sides, the first of equal ones."""
    n = left.groupBy("qid", "plan").agg(F.count("*").alias("n"))
    scored = expected.select("qid", "plan").distinct().join(n, ["qid", "plan"], "left").fillna(0, ["n"])
    return scored.groupBy("qid").agg(F.min(F.struct("n", "plan")).alias("b")).select("qid", "b.plan", F.col("b.n").alias("n_left"))


def deviations(left: DataFrame, answered: DataFrame) -> DataFrame:
    """qid, stage, turn, kind, step of one program's leftovers; answered: qid, has_answer, final_turn.

    The k-th call and the k-th expected one of the same tool are a wrong argument, any two after that a wrong tool. What is
    missing is told only of questions with an answer, at their last turn, as loop_omission of stage 4 inside a loop.
    """
    e = left.where("turn is null").select("qid", "tool", "step", "in_loop", _nth("qid", "tool", order="step").alias("k"))
    c = left.where("step is null").select("qid", "tool", "turn", _nth("qid", "tool", order="turn").alias("k"))
    tool = cut(e.join(c, ["qid", "tool", "k"], "full_outer"))
    both = F.col("step").isNotNull() & F.col("turn").isNotNull()
    args = tool.where(both).select("qid", F.lit(2).alias("stage"), "turn", F.lit("wrong_args").alias("kind"), "step")
    e = tool.where("turn is null").select("qid", "step", "in_loop", _nth("qid", order="step").alias("k"))
    c = tool.where("step is null").select("qid", "turn", _nth("qid", order="turn").alias("k"))
    rest = e.join(c, ["qid", "k"], "full_outer").join(answered, "qid", "left")
    kind = F.when(both, "wrong_tool").when(F.col("step").isNull(), "extra_call").when(F.col("in_loop"), "loop_omission").otherwise("missing_call")
    told = rest.where(F.col("turn").isNotNull() | F.col("has_answer"))
    return args.unionByName(told.select("qid", F.when(kind == "loop_omission", 4).otherwise(2).alias("stage"), F.coalesce("turn", "final_turn").alias("turn"), kind.alias("kind"), "step"))


# ---- programs over boxes and the recorded calls


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPECTED of two programs an image: sizes and a loop over the quadrants, or the nearest pair; then a loop over all ships but the longest."""
    f = tools.facts(E.images(spark, sf_dir), E.labels(spark, sf_dir)).where("n_boxes > 0").select(F.col("image_id").alias("qid"), F.col("n_boxes").cast("int").alias("n"), F.col("longest").cast("int").alias("longest"))

    def one(step, tool, args, raw=None, loop=False):
        text = lambda x: F.lit(x) if isinstance(x, str) else x
        number = F.lit(step) if isinstance(step, int) else step
        return F.struct(number.cast("int").alias("step"), F.lit(tool).alias("tool"), text(args).alias("args"), text(args if raw is None else raw).alias("raw"), F.lit(loop).alias("in_loop"))

    first = one(1, "detect_ships", '{"region": "full"}')
    quadrants = [one(3 + i, "spatial_query", f'{{"query": "count", "region": "{q}"}}', loop=True) for i, q in enumerate(G.QUADRANTS)]
    starts = {0: [first, one(2, "spatial_query", '{"query": "sizes"}'), *quadrants], 1: [first, one(2, "spatial_query", '{"query": "nearest_pair", "region": "full"}')]}
    ships = F.transform(
        F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: i != F.col("longest")),
        lambda i: one(
            i + 6, "spatial_query", F.format_string('{"query": "distance", "ship_a": %d, "ship_b": %d}', F.col("longest"), i),
            F.format_string('{"query": "distance", "ship_a": "$c2.longest.id", "ship_b": "$c2.ships.%d.id"}', i - 1), True,
        ),
    )
    plans = F.array(*(F.struct(F.lit(p).alias("plan"), F.concat(F.array(*start), ships).alias("steps")) for p, start in starts.items()))
    return f.select("qid", F.explode(plans).alias("p")).select("qid", "p.plan", F.explode("p.steps").alias("s")).select("qid", "plan", "s.*")


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CALLS: one program's calls, some left out, changed, made with another tool, made twice, or with references that don't resolve."""
    return _edited(programs(spark, sf_dir))


def _edited(expected: DataFrame) -> DataFrame:
    p = expected.where(F.col("plan") == F.when(F.col("qid") % 3 == 0, 1).otherwise(0))
    u = G.uniform(F.lit("call"), F.col("qid"), F.col("step"))
    p = p.withColumn("u", u).where("u >= 80")
    other = F.when(F.col("raw").contains("distance"), F.regexp_replace("args", r'"ship_b": (\d+)', '"ship_b": 9$1')).otherwise(F.lit('{"query": "edge", "region": [1.0, 2, 3.5, 4]}'))
    lost = (F.col("u") >= 220) & (F.col("u") < 300) & F.col("raw").contains("$")
    changed = (F.col("u") >= 80) & (F.col("u") < 140)
    wrong = (F.col("u") >= 140) & (F.col("u") < 170)
    args = F.when(lost, F.lit(None)).when(wrong, F.lit("{}")).when(changed, other).otherwise(F.col("args"))
    raw = F.when(lost, F.replace("raw", F.lit("$c2."), F.lit("$c77."))).when(wrong | changed, args).otherwise(F.col("raw"))
    p = p.select("qid", "step", F.when(wrong, "get_metadata").otherwise(F.col("tool")).alias("tool"), args.alias("args"), raw.alias("raw"), F.explode(F.sequence(F.lit(1), F.when((F.col("u") >= 170) & (F.col("u") < 220), 2).otherwise(1))).alias("copy"))
    return p.select("qid", F.row_number().over(W.partitionBy("qid").orderBy("step", "copy")).alias("turn"), "tool", "args", "raw")


def answers(calls: DataFrame) -> DataFrame:
    """qid, has_answer, final_turn."""
    return calls.groupBy("qid").agg((F.max("turn") + 1).alias("final_turn")).withColumn("has_answer", G.uniform(F.lit("silent"), F.col("qid")) % 12 != 0)


_UC = _U("'call'", "qid", "step")
_SIDES = f"""{with_entities("images", "label")}{tools.with_tools("facts")}, f as (select image_id as qid, n_boxes::int as n, longest::int as longest from facts where n_boxes > 0),
quads as (select unnest(range(4))::int as i, unnest(['{"', '".join(G.QUADRANTS)}']) as q),
programs as (select qid, plan, 1 as step, 'detect_ships' as tool, 'detect_ships|full' as key, 'detect_ships|full' as shape, false as in_loop from f, (values (0), (1)) t(plan)
  union all select qid, 0, 2, 'spatial_query', 'spatial_query|sizes|full|-|-', 'spatial_query|sizes|full|-|-', false from f
  union all select qid, 1, 2, 'spatial_query', 'spatial_query|nearest_pair|full|-|-', 'spatial_query|nearest_pair|full|-|-', false from f
  union all select qid, 0, 3 + i, 'spatial_query', 'spatial_query|count|' || q || '|-|-', 'spatial_query|count|' || q || '|-|-', true from f, quads
  union all select qid, plan, (i + 6)::int, 'spatial_query', 'spatial_query|distance|-|' || longest || '|' || i, 'spatial_query|distance|-|ref:longest.id|ref:ships.' || (i - 1) || '.id', true
    from (select *, unnest(range(1, n + 1)) as i from f), (values (0), (1)) t(plan) where i <> longest),
edits as (select *, {_UC} as u, key like '%distance%' as far from programs where plan = case when qid % 3 = 0 then 1 else 0 end),
calls as (select qid, row_number() over (partition by qid order by step, copy)::int as turn, case when u between 140 and 169 then 'get_metadata' else tool end as tool,
    case when u between 80 and 139 then case when far then regexp_replace(key, '([0-9]+)$', '9\\1') when tool = 'detect_ships' then 'detect_ships|[1,2,3.5,4]' else 'spatial_query|edge|[1,2,3.5,4]|-|-' end when u between 140 and 169 then 'get_metadata'
      when u between 220 and 299 and far then 'spatial_query|distance|-|$c77.longest.id|$c77.ships' else key end as key,
    case when u between 220 and 299 and far then shape end as shape from (select *, unnest(range(case when u between 170 and 219 then 2 else 1 end)) as copy from edits where u >= 80)),
e0 as (select *, row_number() over (partition by qid, plan, key order by step) as k from programs), c0 as (select c.*, plan, row_number() over (partition by qid, plan, key order by turn) as k from calls c, (values (0), (1)) t(plan)),
e1 as (select qid, plan, tool, shape, step, in_loop, row_number() over (partition by qid, plan, shape order by step) as j from e0 where not exists (select 1 from c0 where c0.qid = e0.qid and c0.plan = e0.plan and c0.key = e0.key and c0.k = e0.k)),
c1 as (select qid, plan, tool, shape, turn, row_number() over (partition by qid, plan, shape order by turn) as j from c0 where not exists (select 1 from e0 where c0.qid = e0.qid and c0.plan = e0.plan and c0.key = e0.key and c0.k = e0.k)),
leftover as (select qid, plan, tool, step, null::int as turn, in_loop from e1 where not exists (select 1 from c1 where c1.qid = e1.qid and c1.plan = e1.plan and c1.shape = e1.shape and c1.j = e1.j)
  union all select qid, plan, tool, null, turn, false from c1 where not exists (select 1 from e1 where c1.qid = e1.qid and c1.plan = e1.plan and c1.shape = e1.shape and c1.j = e1.j)),
best as (select qid, plan, n as n_left from (select *, row_number() over (partition by qid order by n, plan) as r from (select p.qid, p.plan, count(l.qid) as n from (select distinct qid, plan from programs) p left join leftover l on l.qid = p.qid and l.plan = p.plan group by all)) where r = 1),
answered as (select qid, max(turn) + 1 as final_turn, {_U("'silent'", "qid")} % 12 <> 0 as has_answer from calls group by qid),
own as (select l.* from leftover l join best using (qid, plan)),
bytool as (select coalesce(e.qid, c.qid) as qid, e.step, c.turn, e.in_loop from (select *, row_number() over (partition by qid, tool order by step) as k from own where turn is null) e
  full outer join (select *, row_number() over (partition by qid, tool order by turn) as k from own where step is null) c on e.qid = c.qid and e.tool = c.tool and e.k = c.k),
byany as (select coalesce(e.qid, c.qid) as qid, e.step, c.turn, e.in_loop from (select *, row_number() over (partition by qid order by step) as k from bytool where turn is null) e
  full outer join (select *, row_number() over (partition by qid order by turn) as k from bytool where step is null) c on e.qid = c.qid and e.k = c.k),
devs as (select qid, 2 as stage, turn, 'wrong_args' as kind, step from bytool where step is not null and turn is not null
  union all select b.qid, case when turn is null and in_loop then 4 else 2 end, coalesce(turn, final_turn), case when step is not null and turn is not null then 'wrong_tool' when step is null then 'extra_call' when in_loop then 'loop_omission' else 'missing_call' end, step
    from byany b left join answered using (qid) where turn is not null or has_answer)"""


def matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recorded calls, the closest program of each question, and what it leaves over."""
    expected = cut(programs(spark, sf_dir))
    calls = cut(_edited(expected))
    left = cut(leftovers(expected, calls))
    best = cut(closest(expected, left))
    return calls, best, left.join(best.select("qid", "plan"), ["qid", "plan"], "left_semi")


@query(f"{_SIDES} select qid, plan, n_left from best")
def closest_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir)[1]


@query(f"{_SIDES} select qid, stage, turn, kind, step from devs")
def loop_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question's calls leave over against its closest program, iterations left out included."""
    calls, _, left = matched(spark, sf_dir)
    return deviations(left, answers(calls))


@query(f"{_SIDES} select kind, stage, count(*) as n, count(distinct qid) as questions from devs group by all")
def loop_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loop_deviations(spark, sf_dir).groupBy("kind", "stage").agg(F.count("*").alias("n"), F.countDistinct("qid").alias("questions"))
