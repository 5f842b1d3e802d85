"""Intervals of every table over runs: accuracies, paired differences, noise, contrasts, effects, levels and depths, the detector.

All runs of a question are one row first. Each table is a list of statistics, a number and the questions that it is asked of,
and all of them are summed up by scene group in one pass; the bootstrap works on these sums alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bootstrap
from tidemark.functions.shared import cut, filed
from tidemark.operators import matching, runs
from tidemark.operators.matching import _WITH
from tidemark.operators.runs import _GRADED
from tidemark.sources import entities as E

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Pairs of conditions that are compared, those that are asked of questions that need boxes first.
MAIN = ((1, 2), (1, 6), (1, 7), (1, 8), (2, 9), (2, 10), (2, 11), (1, 3), (1, 4), (2, 5))
BOXED = ((1, 6), (1, 7), (1, 8), (2, 9), (2, 10), (2, 11))
DECOMPOSED = (1, 2, 4, 5)
CONDITIONS = tuple(c for c, *_ in runs.CONDITIONS)
KINDS = ("miss", "fp", "loc")
SUBSETS = {"all": "true", "box_dependent": "box_dependent", "not_box_dependent": "not box_dependent"}


@dataclass(frozen=True)
class Stat:
    """What a row of a table is called, the number and the condition, as expressions over by_question that both engines read."""

    keys: tuple
    num: str
    mask: str


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def by_question(spark: SparkSession, sf_dir: str, conds: tuple[int, ...] = CONDITIONS) -> DataFrame:
    """qid, scene_group, box_dependent, level, gold_calls and, by condition, r (right, 0 or 1), w (the boxes' answer is wrong), a (answer and unit) and e (the agent's error); boxes are made for the inputs of conds alone.

    An image's numbers are one row, so a question's runs are told side by side in it: no run is shuffled.
    """
    return runs.side_by_condition(spark, sf_dir, conds)


_BY_QUESTION = f"""{_GRADED}, byq as materialized (select qid, scene_group, box_dependent, level, gold_calls, {", ".join(f"max(correct::int) filter (cond = {c}) as r{c}, bool_or(reachable <> gold) filter (cond = {c}) as w{c}, max(case when answer is not null then answer || '|' || unit end) filter (cond = {c}) as a{c}, bool_or(agent_error) filter (cond = {c}) as e{c}" for c in CONDITIONS)} from graded group by all)"""


def sums(rows: DataFrame, stats: list[Stat], group: str = "scene_group") -> DataFrame:
    """stat (its place in the list), group, num, den: all statistics in one aggregation by group."""
    masks = list(dict.fromkeys(s.mask for s in stats))
    of = {m: f"n{i}" for i, m in enumerate(masks)}
    found = rows.groupBy(group).agg(*(F.expr(f"count_if({m})").alias(of[m]) for m in masks), *(F.expr(f"sum(case when {s.mask} then {s.num} else 0 end)").alias(f"s{i}") for i, s in enumerate(stats)))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("stat"), F.col(f"s{i}").cast("double").alias("num"), F.col(of[s.mask]).cast("double").alias("den")) for i, s in enumerate(stats))))
    return found.select(group, each.alias("x")).select("x.stat", group, "x.num", "x.den")


def table(rows: DataFrame, stats: list[Stat], names: str, group: str = "scene_group") -> DataFrame:
    """names (their types too), n, num, value, low and high of every statistic; four decimals."""
    spark = rows.sparkSession
    keys = spark.createDataFrame([(i, *s.keys) for i, s in enumerate(stats)], f"stat int, {names}")
    found = bootstrap.intervals(cut(sums(rows, stats, group)), group)
    four = lambda c: (F.floor(F.col(c) * 10000 + 0.5) / 10000.0).alias(c)
    columns = [n.split()[0] for n in names.split(", ")]
    return keys.join(found, "stat", "left").select(*columns, F.coalesce(F.col("den"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.col("num"), F.lit(0)).cast("long").alias("num"), four("value"), four("low"), four("high"))


def table_sql(start: str, rows: str, stats: list[Stat], names: str, group: str = "scene_group") -> str:
    """The same in SQL up to a table `told`."""
    columns = [n.split()[0] for n in names.split(", ")]
    each = "\n  union all ".join(f"select {i} as stat, {group}, sum(case when {s.mask} then {s.num} else 0 end)::double as num, (count(*) filter ({s.mask}))::double as den from {rows} group by {group}" for i, s in enumerate(stats))
    literal = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    keys = ", ".join(f"({i}, {', '.join(map(literal, s.keys))})" for i, s in enumerate(stats))
    four = ", ".join(f"floor({c} * 10000 + 0.5) / 10000 as {c}" for c in ("value", "low", "high"))
    return f"""{start}, sums as ({each}), {bootstrap.intervals_sql("sums", group)},
told as (select {", ".join(columns)}, coalesce(den, 0)::bigint as n, coalesce(num, 0)::bigint as num, {four} from (values {keys}) t(stat, {", ".join(columns)}) left join intervals using (stat))"""


def add(name: str, doc: str, stats: list[Stat], names: str, conds: tuple[int, ...] = CONDITIONS) -> None:
    """Register a table over questions; conds: the conditions that its statistics name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(by_question(spark, sf_dir, conds), stats, names)

    run.__name__, run.__doc__ = name, doc
    QUERIES[name], ORACLE_SQL[name] = run, f"{table_sql(_BY_QUESTION, 'byq', stats, names)} select * from told"


ACCURACY = [Stat((c, s), f"r{c}", m) for s, m in SUBSETS.items() for c in CONDITIONS]
add("accuracy_intervals", "Right answers of every condition, of all questions and of those that do and don't need boxes.", ACCURACY, "cond int, subset string")

DEPTHS = {**{f"gold_calls {k}": f"gold_calls = {k}" for k in range(1, 6)}, "gold_calls 6-9": "gold_calls >= 6"}
PARTS = {**{f"L{k}": f"level = {k}" for k in range(1, 6)}, **DEPTHS}
add("level_intervals", "Right answers by level and by the calls that the gold program makes.", [Stat((c, p), f"r{c}", m) for c in DECOMPOSED for p, m in PARTS.items()], "cond int, part string", DECOMPOSED)

CONTRASTS = {
    "drop of stepwise, 1 - 2": "r1 - r2", "drop of batch, 4 - 5": "r4 - r5", "difference of the drops": "r1 - r2 - r4 + r5",
    "batch - stepwise on labels, 4 - 1": "r4 - r1", "batch - stepwise on detections, 5 - 2": "r5 - r2",
}
add("contrast_intervals", "Drops of both methods, their difference, and the methods against each other.", [Stat((s, q), e, SUBSETS[s]) for s in ("all", "box_dependent") for q, e in CONTRASTS.items()], "subset string, quantity string", DECOMPOSED)

NOISE = {"right, first run": "r1", "right, second run": "r3", "difference, 1 - 3": "r1 - r3", "correctness differs": "cast(r1 <> r3 as int)", "answer differs": "cast(coalesce(a1, '-') <> coalesce(a3, '-') as int)"}
add("noise_intervals", "Two runs of the same questions on the same boxes.", [Stat((s, q), e, m) for s, m in SUBSETS.items() for q, e in NOISE.items()], "subset string, quantity string", (1, 3))

#: The questions that an injection changes or not, and those that the detections get wrong and a correction brings back or not.
EFFECTS = [
    *((f"injection {k}", c, 1, s, f"r{c} - r1", m) for k, c in zip(KINDS, (6, 7, 8), strict=True) for s, m in (("all", "box_dependent"), ("changed", f"box_dependent and w{c}"), ("not changed", f"box_dependent and not w{c}"))),
    *((f"correction {k}", c, 2, s, f"r{c} - r2", m) for k, c in zip(KINDS, (9, 10, 11), strict=True) for s, m in (("all", "box_dependent"), ("recoverable", f"box_dependent and w2 and not w{c}"), ("not recoverable", f"box_dependent and w2 and w{c}"))),
]
add("effect_intervals", "What an injection costs and a correction brings, apart for the questions whose answer it changes.", [Stat((effect, c, before, s), e, m) for effect, c, before, s, e, m in EFFECTS], "effect string, cond int, before int, questions string")

PAIRS = [(a, b, "main", s) for a, b in MAIN for s in ("all", "box_dependent")] + [(a, b, "placebo", "not_box_dependent") for a, b in BOXED]
PAIR_STATS = [Stat((a, b, role, s), f"r{a} - r{b}", SUBSETS[s]) for a, b, role, s in PAIRS]
PAIR_NAMES = "a int, b int, role string, subset string"
_PRIMARY = lambda a, b, s: s == ("box_dependent" if (a, b) in BOXED else "all")
_BOTH = {"both_right": "r{a} = 1 and r{b} = 1", "only_a": "r{a} = 1 and r{b} = 0", "only_b": "r{a} = 0 and r{b} = 1", "both_wrong": "r{a} = 0 and r{b} = 0"}


@query(
    f"""{table_sql(_BY_QUESTION, "byq", PAIR_STATS, PAIR_NAMES)}, four as ({" union all ".join(f"select {a} as a, {b} as b, '{s}' as subset, {_PRIMARY(a, b, s) and role == 'main'} as primary_subset, {', '.join(f'count(*) filter ({SUBSETS[s]} and {e.format(a=a, b=b)}) as {k}' for k, e in _BOTH.items())} from byq" for a, b, role, s in PAIRS)})
  select a, b, role, subset, primary_subset, n, value, low, high, {", ".join(_BOTH)} from told join four using (a, b, subset)"""
)
def paired_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two conditions on the same questions, with how often both, one or none is right."""
    # read twice
    rows = filed(by_question(spark, sf_dir))
    four = rows.agg(*(F.expr(f"count_if({SUBSETS[s]} and {e.format(a=a, b=b)})").alias(f"{k}_{i}") for i, (a, b, _, s) in enumerate(PAIRS) for k, e in _BOTH.items()))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(s).alias("subset"), F.lit(_PRIMARY(a, b, s) and role == "main").alias("primary_subset"), *(F.col(f"{k}_{i}").alias(k) for k in _BOTH)) for i, (a, b, role, s) in enumerate(PAIRS))))
    told = table(rows, PAIR_STATS, PAIR_NAMES)
    return told.join(four.select(each.alias("x")).select("x.*"), ["a", "b", "subset"]).select("a", "b", "role", "subset", "primary_subset", "n", "value", "low", "high", *_BOTH)


#: The detector by images: hits, detections and labels; a rate's denominator is a number, so it is its mask's place.
DETECTOR = {"precision": ("hits", "dets"), "recall": ("hits", "labels"), "f1": ("2 * hits", "dets + labels")}


def detector_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stat, scene_group, num, den of precision, recall and F1 in each split."""
    rows = {"dets": E.detections(spark, sf_dir), "labels": E.labels(spark, sf_dir), "hits": matching.matched(spark, sf_dir)}
    union = None
    for name, df in rows.items():
        one = df.groupBy("image_id").agg(F.count("*").alias("n")).select("image_id", F.lit(name).alias("what"), "n")
        union = one if union is None else union.unionByName(one)
    n = union.join(E.images(spark, sf_dir).select("image_id", "scene_group", "split"), "image_id")
    by = n.groupBy("scene_group", "split").agg(*(F.sum(F.when(F.col("what") == k, F.col("n")).otherwise(0)).alias(k) for k in rows))
    each = F.explode(F.array(*(F.struct(F.concat_ws("|", "split", F.lit(k)).alias("stat"), F.expr(a).alias("num"), F.expr(b).alias("den")) for k, (a, b) in DETECTOR.items())))
    return by.select("scene_group", each.alias("x")).select("x.stat", "scene_group", "x.num", "x.den")


@query(
    f"""{_WITH}, hit as (select image_id, count(*) as hits from matched group by image_id), det as (select image_id, count(*) as dets from detected group by image_id), lab as (select image_id, count(*) as labels from label group by image_id),
  by_group as (select scene_group, split, coalesce(sum(hits), 0) as hits, coalesce(sum(dets), 0) as dets, coalesce(sum(labels), 0) as labels from images left join hit using (image_id) left join det using (image_id) left join lab using (image_id) where dets is not null or labels is not null group by all),
  sums as ({" union all ".join(f"select split || '|{k}' as stat, scene_group, {a} as num, {b} as den from by_group" for k, (a, b) in DETECTOR.items())}), {bootstrap.intervals_sql("sums")}
  select split_part(stat, '|', 1) as split, split_part(stat, '|', 2) as rate, {", ".join(f"floor({c} * 10000 + 0.5) / 10000 as {c}" for c in ("value", "low", "high"))} from intervals"""
)
def detector_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each split, its scene groups drawn anew."""
    found = bootstrap.intervals(cut(detector_sums(spark, sf_dir)))
    part = F.split("stat", r"\|")
    return found.select(part[0].alias("split"), part[1].alias("rate"), *((F.floor(F.col(c) * 10000 + 0.5) / 10000.0).alias(c) for c in ("value", "low", "high")))
