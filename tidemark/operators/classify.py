"""Classification of run records: interpretation, reading, branch and order, calculation, formatting, and the first deviation.

A record holds what a run wrote down, as JSON text: its interpretation, tool calls, readings and decisions. The JSON is
parsed by column expressions, and since all of a run lies in one row, each stage is a projection over its arrays, and so
are the rules that weigh the deviations of a question against each other: no call, reading or deviation is shuffled. The
records are a plain test input, made from the traces and a hash of the question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions.shared import apart
from tidemark.operators import traces as T
from tidemark.operators.perturb import _U

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
CALLS = "array<struct<turn: int, call_id: string, tool: string, arg: int, ref: string, error: string, value: int>>"
READINGS = "array<struct<turn: int, source: string, field: string, value: int>>"
DECISIONS = "array<struct<turn: int, condition_from: string, condition_value: int, chosen: string>>"
INTERPRETATION = "struct<target: string, region: string, filters: string, unit: string>"
DEVS = "array<struct<turn: int, kind: string, harmless: boolean>>"
#: The branch's threshold, the expected unit.
THRESHOLD, UNIT = 25, "count"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _value(turn: Column) -> Column:
    return ((F.col("qid") + 3 * turn) % 50).cast("int")


def with_golds(asked: DataFrame) -> DataFrame:
    """asked, with the gold interpretation, has_branch, gold_branch, reachable and the arguments of the gold calculations."""
    q = F.col("qid")
    return asked.withColumns(
        {
            "gold": F.struct(
                F.when(q % 2 == 1, "count").otherwise("size").alias("target"),
                F.when(q % 4 == 0, "full").otherwise(F.concat(F.lit("r"), q % 4)).alias("region"),
                F.when(q % 5 == 0, "side > 60").alias("filters"),
                F.lit(UNIT).alias("unit"),
            ),
            "has_branch": q % 3 == 0,
            "gold_branch": F.when(_value(F.lit(2)) > THRESHOLD, "then").otherwise("else"),
            "reachable": _value(q % 5 + 2),
            "gold_calcs": F.transform(F.filter("plan", lambda c: c["tool"] == "calc"), lambda c: c["arg"]),
        }
    )


def recorded(asked: DataFrame) -> DataFrame:
    """asked, with interpretation, calls, readings, decisions (JSON text), has_answer, answer_value, answer_unit, format_ok; no row without calls."""
    u = lambda what, *key: G.uniform(F.lit(what), F.col("qid"), *key)
    joined = lambda *parts: F.concat_ws("", *parts)
    q, turns = F.col("qid"), F.size("trace")
    made = F.transform("trace", lambda c: F.struct(c["turn"].alias("turn"), c["tool"].alias("tool"), c["arg"].alias("arg"), (u("order", c["turn"]) % 25 == 0).alias("early")))

    def call(c: Column) -> Column:
        turn, early = c["turn"], c["early"]
        after = joined(F.lit("c"), turn + 1)
        return F.struct(
            turn.alias("turn"),
            joined(F.lit("c"), turn).alias("call_id"),
            c["tool"].alias("tool"),
            c["arg"].alias("arg"),
            F.when(early, joined(F.lit("$"), after, F.lit(".value"))).when((turn > 1) & (u("ref", turn) % 10 != 0), joined(F.lit("$c"), turn - 1, F.lit(".value"))).alias("ref"),
            F.when(early, joined(F.lit("no such call or variable '"), after, F.lit("'"))).alias("error"),
            _value(turn).alias("value"),
        )

    def reading(c: Column) -> Column:
        turn = c["turn"]
        source = F.when(u("lost", turn) % 20 == 0, "$c99").otherwise(joined(F.lit("$c"), turn))
        return F.struct(turn.alias("turn"), source.alias("source"), F.lit("value").alias("field"), (_value(turn) + F.when(u("misread", turn) % 8 == 0, 1).otherwise(0)).alias("value"))

    second = _value(F.lit(2)) + F.when(u("miscondition") % 6 == 0, 1).otherwise(0)
    chosen = F.when((F.col("second") > THRESHOLD) != (u("flip") % 7 == 0), "then").otherwise("else")
    decision = F.struct(F.lit(2).alias("turn"), F.lit("$c2.value").alias("condition_from"), F.col("second").alias("condition_value"), chosen.alias("chosen"))
    agent = F.struct(
        F.when((q % 2 == 1) == (u("target") % 10 != 0), "count").otherwise("size").alias("target"),
        F.when((q % 4 == 0) & ~F.col("astray"), "full").otherwise(F.concat(F.lit("r"), (q + F.when(F.col("astray"), 1).otherwise(0)) % 4)).alias("region"),
        F.when((q % 5 == 0) & (u("filters") % 6 != 0), "side > 60").alias("filters"),
        F.when(u("said") % 5 == 0, "px").otherwise(UNIT).alias("unit"),
    )
    slip = F.when(u("slip") % 9 == 0, 1).otherwise(0)
    rows = apart(asked.where(turns > 0), second=second, astray=u("region") % 9 == 0)
    # one generator for what is compiled, one for what passes through arrays
    rows = apart(
        rows,
        interpretation=F.to_json(agent), decisions=F.coalesce(F.to_json(F.when((q % 3 == 0) & (turns > 1), F.array(decision))), F.lit("[]")),
        has_answer=u("silent") % 15 != 0, answer_value=(_value(turns) + slip).cast("int"),
        answer_unit=F.when(u("px") % 12 == 0, "px").otherwise(UNIT), format_ok=u("malformed") % 30 != 0,
    )
    rows = apart(rows, made=made)
    readings = F.transform(F.filter("made", lambda c: u("read", c["turn"]) % 2 == 0), reading)
    return apart(rows, calls=F.to_json(F.transform("made", call)), readings=F.to_json(readings)).drop("made", "second", "astray")


def parsed(recs: DataFrame) -> DataFrame:
    """The records with their JSON as arrays and structs; text that isn't JSON gives null, and an empty list of calls."""
    kinds = {"interpretation": INTERPRETATION, "calls": CALLS, "readings": READINGS, "decisions": DECISIONS}
    said = recs.withColumnsRenamed({c: f"{c}_text" for c in kinds})
    read = {c: F.from_json(f"{c}_text", kind) for c, kind in kinds.items()}
    # a parser for an empty list would cost as much as for a short one
    read |= {c: F.coalesce(F.when(F.col(f"{c}_text") != "[]", read[c]), F.array().cast(kinds[c])) for c in kinds if c != "interpretation"}
    return apart(said, **read).drop(*(f"{c}_text" for c in kinds))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(recorded(T.questions(spark, sf_dir)).drop("trace"))
    return apart(with_golds(rows), final_turn=F.array_max(F.transform("calls", lambda c: c["turn"])))


def _lookup(call_id: Column, field: Column) -> Column:
    return F.when(field == "value", F.get(F.filter("calls", lambda c: c["call_id"] == call_id), F.lit(0))["value"])


def used_later(call: Column) -> Column:
    """Is a call's result named by a later call, a reading or a decision?"""
    name = F.concat(F.lit("$"), call["call_id"])
    path = F.concat(name, F.lit("."))
    return (
        F.exists("calls", lambda c: (c["turn"] > call["turn"]) & F.coalesce(F.startswith(c["ref"], path), F.lit(False)))
        | F.exists("readings", lambda r: r["source"] == name)
        | F.exists("decisions", lambda d: F.startswith(d["condition_from"], path))
    )


def _dev(turn: Column, kind: Column, harmless: Column) -> Column:
    return F.struct(turn.cast("int").alias("turn"), kind.alias("kind"), harmless.alias("harmless"))


def _found(devs: Column) -> Column:
    return F.filter(devs, lambda d: d["kind"].isNotNull())


def _exploded(rows: DataFrame, devs: Column) -> DataFrame:
    return rows.select("qid", F.explode(_found(devs)).alias("d")).select("qid", "d.turn", "d.kind", "d.harmless")


FIELDS = ("target", "region", "filters", "unit")


def differing(wanted: bool) -> Column:
    """Fields of the interpretation that differ and that the gold program uses, or doesn't use."""
    a, g = F.col("interpretation"), F.col("gold")
    uses = {"target": F.lit(True), "region": g["region"] != "full", "filters": g["filters"].isNotNull(), "unit": F.lit(False)}
    return F.concat_ws(",", *(F.when(~a[f].eqNullSafe(g[f]) & (uses[f] == F.lit(wanted)), f) for f in FIELDS))


def differences(rows: DataFrame) -> DataFrame:
    """qid, used, unused: fields of the interpretation that differ, by whether the gold program uses them."""
    return rows.select("qid", differing(True).alias("used"), differing(False).alias("unused"))


def _stage1() -> Column:
    return F.array(_dev(F.lit(0), F.when(differing(True) != "", "interpretation_mismatch"), F.lit(False)))


def _stage2() -> Column:
    """The deviations of calls; an extra call whose result nothing names, or that failed, does no harm."""
    idle = lambda turn: F.exists("calls", lambda c: (c["turn"] == turn) & (c["error"].isNotNull() | ~used_later(c)))
    missing = lambda d: d["kind"] == "missing_call"
    one = lambda d: _dev(F.when(missing(d), F.col("final_turn")).otherwise(d["turn"]), F.when(~missing(d) | F.col("has_answer"), d["kind"]), (d["kind"] == "extra_call") & idle(d["turn"]))
    return F.transform("unmatched", one)


def _stage3() -> Column:
    """Readings and decisions that name no result, or another value than the result's."""

    actual = lambda r: _lookup(F.ltrim(r["source"], F.lit("$")), r["field"])

    def reading(r: Column) -> Column:
        path = F.concat(r["source"], F.lit("."), r["field"])
        used = F.exists("decisions", lambda d: d["condition_from"] == path) | F.exists("calls", lambda c: c["arg"] == r["value"]) | (F.col("has_answer") & (F.col("answer_value") == r["value"]))
        return _dev(r["turn"], F.when(actual(r).isNull(), "reading_source_missing").otherwise("reading_mismatch"), ~used)

    def decision(d: Column) -> Column:
        path = F.split(F.ltrim(d["condition_from"], F.lit("$")), "\\.")
        value = _lookup(F.get(path, F.lit(0)), F.get(path, F.lit(1)))
        kind = F.when(value.isNull(), "decision_source_missing").when(value != d["condition_value"], "decision_value_mismatch")
        return _dev(d["turn"], kind, value.isNotNull() & (d["chosen"] == F.col("gold_branch")))

    wrong = F.filter("readings", lambda r: F.coalesce(actual(r) != r["value"], actual(r).isNull()))
    return F.flatten(F.array(F.transform(wrong, reading), F.when(F.col("has_branch"), F.transform("decisions", decision)).otherwise(F.array().cast(DEVS))))


def _stage4() -> Column:
    """The last decision against the branch that the received values give; calls that name a call not made yet."""
    last = F.get("decisions", F.size("decisions") - 1)
    wrong = _dev(last["turn"], F.when(F.col("has_branch") & (last["chosen"] != F.col("gold_branch")), "wrong_branch"), F.lit(False))

    def order(c: Column, i: Column) -> Column:
        named = F.regexp_extract(c["error"], "no such call or variable 'c([0-9]+)'", 1)
        return _dev(c["turn"], F.when(c["error"].isNotNull(), F.when((named != "") & (named.cast("int") > i), "order_error")), F.lit(False))

    return F.flatten(F.array(F.array(wrong), F.transform("calls", order)))


def _stage5() -> Column:
    """Calculations against the gold ones, in their order."""
    calcs = F.filter("calls", lambda c: c["tool"] == "calc")

    def one(c: Column, i: Column) -> Column:
        used = used_later(c) | (F.col("has_answer") & c["error"].isNull() & (c["value"] == F.col("answer_value")))
        extra = i >= F.size("gold_calcs")
        differs = c["error"].isNotNull() | (c["arg"] != F.get("gold_calcs", i))
        return _dev(c["turn"], F.when(extra, "extra_calc").when(differs, "calc_mismatch"), F.when(extra | differs, ~used & (extra | c["error"].isNull())))

    skipped = _dev(F.col("final_turn"), F.when(F.col("has_answer") & (F.size(calcs) < F.size("gold_calcs")), "calc_skipped"), F.lit(False))
    return F.flatten(F.array(F.transform(calcs, one), F.array(skipped)))


def _stage6() -> Column:
    right = F.col("answer_value") == F.col("reachable")
    seen = F.exists("calls", lambda c: c["value"] == F.col("reachable")) | F.exists("readings", lambda r: r["value"] == F.col("reachable"))
    kind = F.when(~F.col("format_ok"), "format").when(right & (F.col("answer_unit") != UNIT), "unit").when(~right & seen, "transcription")
    return F.array(_dev(F.col("final_turn"), F.when(F.col("has_answer"), kind), F.lit(False)))


STAGES = {1: _stage1, 2: _stage2, 3: _stage3, 4: _stage4, 5: _stage5, 6: _stage6}


def stage1(rows: DataFrame) -> DataFrame:
    return _exploded(rows, _stage1())


def stage3(rows: DataFrame) -> DataFrame:
    return _exploded(rows, _stage3())


def stage4(rows: DataFrame) -> DataFrame:
    return _exploded(rows, _stage4())


def stage5(rows: DataFrame) -> DataFrame:
    return _exploded(rows, _stage5())


def stage6(rows: DataFrame) -> DataFrame:
    return _exploded(rows, _stage6())


def weighed(rows: DataFrame) -> DataFrame:
    """rows with devs (stage, turn, kind, harmless), after the rules that weigh a question's deviations against each other."""
    rows = T.unmatched(rows, "plan", "calls", "unmatched")
    staged = lambda k, harmless: lambda d: F.struct((F.lit(k) if k else d["stage"]).alias("stage"), d["turn"].alias("turn"), d["kind"].alias("kind"), harmless(d).alias("harmless"))
    found = F.flatten(F.array(*(F.transform(_found(part()), staged(k, lambda d: d["harmless"])) for k, part in STAGES.items())))
    rows = apart(rows, found=found)
    flag = lambda *stages: F.coalesce(F.exists("found", lambda d: d["stage"].isin(*stages) & ~d["harmless"]), F.lit(False))
    kept_to = (~F.col("has_branch") | (F.size("decisions") > 0)) & (~F.col("has_answer") | (F.col("answer_unit") == UNIT))
    rows = apart(rows, off_calls=flag(2), followed=~flag(2, 4) & kept_to)
    excused = lambda d: d["harmless"] | ((d["stage"] == 1) & F.col("followed")) | ((d["kind"] == "wrong_branch") & ~F.col("off_calls"))
    rows = apart(rows, excused=F.transform("found", staged(None, excused)))
    since = F.array_min(F.transform(F.filter("excused", lambda d: (d["kind"] == "wrong_branch") & ~d["harmless"]), lambda d: d["turn"]))
    rows = apart(rows, since=since)
    follows = lambda d: d["harmless"] | (d["stage"].isin(2, 5) & F.coalesce(d["turn"] >= F.col("since"), F.lit(False)))
    return rows.withColumn("devs", F.transform("excused", staged(None, follows))).drop("unmatched", "found", "off_calls", "followed", "excused", "since")


def all_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, stage, turn, kind, harmless."""
    return weighed(runs(spark, sf_dir)).select("qid", F.explode("devs").alias("d")).select("qid", "d.*")


def first_harm(rows: DataFrame) -> DataFrame:
    """Rows with a deviation that did harm, and d, the earliest of these, by turn, then stage."""
    harm = F.transform(F.filter("devs", lambda d: ~d["harmless"]), lambda d: F.struct(d["turn"].alias("turn"), d["stage"].alias("stage"), d["kind"].alias("kind")))
    return apart(weighed(rows), d=F.array_min(harm)).where("d is not null")


def _sql() -> str:
    u = lambda what, *key: _U(f"'{what}'", "qid", *key)
    value = lambda turn: f"cast((qid + 3 * {turn}) % 50 as int)"
    return f"""{T._DEV},
ca as (select qid, turn, tool, arg, {u("order", "turn")} % 25 = 0 as early, case when {u("order", "turn")} % 25 = 0 then turn + 1 when turn > 1 and {u("ref", "turn")} % 10 <> 0 then turn - 1 end as ref, {value("turn")} as value from traces),
rd as (select qid, turn, case when {u("lost", "turn")} % 20 = 0 then 99 else turn end as src, {value("turn")} + case when {u("misread", "turn")} % 8 = 0 then 1 else 0 end as value from traces where {u("read", "turn")} % 2 = 0),
d0 as (select qid, turn, {value("turn")} + case when {u("miscondition")} % 6 = 0 then 1 else 0 end as value from traces where qid % 3 = 0 and turn = 2),
dc as (select *, case when (value > {THRESHOLD}) <> ({u("flip")} % 7 = 0) then 'then' else 'else' end as chosen from d0),
rec as (select qid, max(turn) as final_turn, arg_max(value, turn) + case when {u("slip")} % 9 = 0 then 1 else 0 end as answer, {u("silent")} % 15 <> 0 as has_answer, case when {u("px")} % 12 = 0 then 'px' else '{UNIT}' end as unit, {u("malformed")} % 30 <> 0 as format_ok,
  case when {value("2")} > {THRESHOLD} then 'then' else 'else' end as gold_branch, {value("(qid % 5 + 2)")} as reachable,
  {u("target")} % 10 = 0 as t_diff, {u("region")} % 9 = 0 as r_diff, qid % 5 = 0 and {u("filters")} % 6 = 0 as f_diff, {u("said")} % 5 = 0 as u_diff from ca group by qid),
idiff as (select qid, concat_ws(',', case when t_diff then 'target' end, case when r_diff and qid % 4 <> 0 then 'region' end, case when f_diff then 'filters' end) as used, concat_ws(',', case when r_diff and qid % 4 = 0 then 'region' end, case when u_diff then 'unit' end) as unused from rec),
us as (select qid, turn, exists (select 1 from ca b where b.qid = ca.qid and b.turn > ca.turn and b.ref = ca.turn) or exists (select 1 from rd where rd.qid = ca.qid and rd.src = ca.turn) or exists (select 1 from dc where dc.qid = ca.qid and dc.turn = ca.turn) as used, tool, arg, early, value from ca),
s1 as (select qid, 1 as stage, 0 as turn, 'interpretation_mismatch' as kind, false as harmless from idiff where used <> ''),
s2 as (select dev.qid, 2 as stage, case when kind = 'missing_call' then final_turn else dev.turn end as turn, kind, kind = 'extra_call' and coalesce(not us.used or us.early, false) as harmless from dev join rec on rec.qid = dev.qid left join us on us.qid = dev.qid and us.turn = dev.turn where kind <> 'missing_call' or has_answer),
s3 as (select r.qid, 3 as stage, r.turn, case when c.qid is null then 'reading_source_missing' else 'reading_mismatch' end as kind,
    not (exists (select 1 from dc where dc.qid = r.qid and dc.turn = r.src) or exists (select 1 from ca where ca.qid = r.qid and ca.arg = r.value) or (has_answer and answer = r.value)) as harmless
  from rd r join rec on rec.qid = r.qid left join ca c on c.qid = r.qid and c.turn = r.src where c.qid is null or c.value <> r.value
  union all select d.qid, 3, d.turn, 'decision_value_mismatch', d.chosen = gold_branch from dc d join rec on rec.qid = d.qid join ca c on c.qid = d.qid and c.turn = d.turn where c.value <> d.value),
s4 as (select d.qid, 4 as stage, d.turn, 'wrong_branch' as kind, false as harmless from dc d join rec using (qid) where d.chosen <> gold_branch union all select qid, 4, turn, 'order_error', false from ca where early),
ac as (select *, row_number() over (partition by qid order by turn) as i from us where tool = 'calc'), gc as (select qid, arg, row_number() over (partition by qid order by step) as i from plans where tool = 'calc'),
s5 as (select a.qid, 5 as stage, a.turn, case when g.qid is null then 'extra_calc' else 'calc_mismatch' end as kind, not (a.used or (has_answer and not a.early and a.value = answer)) and (g.qid is null or not a.early) as harmless
  from ac a join rec on rec.qid = a.qid left join gc g on g.qid = a.qid and g.i = a.i where g.qid is null or a.early or a.arg <> g.arg
  union all select qid, 5, final_turn, 'calc_skipped', false from rec where has_answer and (select count(*) from ac where ac.qid = rec.qid) < (select count(*) from gc where gc.qid = rec.qid)),
s6 as (select * from (select qid, 6 as stage, final_turn as turn, case when not format_ok then 'format' when answer = reachable and unit <> '{UNIT}' then 'unit'
    when answer <> reachable and (exists (select 1 from ca where ca.qid = rec.qid and ca.value = reachable) or exists (select 1 from rd where rd.qid = rec.qid and rd.value = reachable)) then 'transcription' end as kind, false as harmless from rec where has_answer) where kind is not null),
a0 as (select u.*, (u.qid % 3 <> 0 or exists (select 1 from dc where dc.qid = u.qid)) and (not has_answer or unit = '{UNIT}') as kept_to from (select * from s1 union all select * from s2 union all select * from s3 union all select * from s4 union all select * from s5 union all select * from s6) u join rec on rec.qid = u.qid),
a1 as (select *, bool_or(stage = 2 and not harmless) over (partition by qid) as calls, not bool_or(stage in (2, 4) and not harmless) over (partition by qid) and kept_to as followed from a0),
a2 as (select qid, stage, turn, kind, harmless or (stage = 1 and followed) or (kind = 'wrong_branch' and not calls) as harmless from a1),
a3 as (select *, min(turn) filter (kind = 'wrong_branch' and not harmless) over (partition by qid) as since from a2),
devs as (select qid, stage, turn, kind, harmless or (stage in (2, 5) and coalesce(turn >= since, false)) as harmless from a3)"""


_ALL = _sql()


@query(f"{_ALL} select qid, used, unused from idiff")
def interpretation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differences(runs(spark, sf_dir))


@query(f"{_ALL} select qid, 'c' || turn as call_id, used from us")
def call_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).select("qid", F.explode("calls").alias("c"), "calls", "readings", "decisions")
    return rows.select("qid", "c.call_id", used_later(F.col("c")).alias("used"))


def _stage(k: int, f) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(runs(spark, sf_dir)).select("qid", "turn", "kind", "harmless")

    QUERIES[f"stage{k}_devs"] = run
    ORACLE_SQL[f"stage{k}_devs"] = f"{_ALL} select qid, turn, kind, harmless from s{k}"


for _k, _f in ((1, stage1), (3, stage3), (4, stage4), (5, stage5), (6, stage6)):
    _stage(_k, _f)


@query(f"{_ALL} select qid, stage, turn, kind, harmless from devs")
def harmless_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_deviations(spark, sf_dir)


_FIRST = f"{_ALL}, first as (select qid, stage, turn, kind from (select *, row_number() over (partition by qid order by turn, stage, kind) as r from devs where not harmless) where r = 1)"


@query(f"{_FIRST} select qid, stage, turn, kind from first")
def deviation_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest deviation that did harm, by turn, then stage."""
    return first_harm(runs(spark, sf_dir)).select("qid", "d.stage", "d.turn", "d.kind")


@query(f"{_FIRST} select stage, kind, count(*) as n from first group by all")
def deviation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deviation_kind(spark, sf_dir).groupBy("stage", "kind").agg(F.count("*").alias("n"))


@query(f"{_FIRST} select f.qid, used, unused, case when has_answer then answer end as answer, coalesce(has_answer and answer = reachable, false) as correct from first f join idiff using (qid) join rec using (qid) where stage = 1")
def interpretation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose first deviation is the interpretation, with the fields that differ."""
    answer = F.when(F.col("has_answer"), F.col("answer_value"))
    rows = first_harm(runs(spark, sf_dir)).where("d.stage = 1")
    return rows.select("qid", differing(True).alias("used"), differing(False).alias("unused"), answer.alias("answer"), F.coalesce(answer == F.col("reachable"), F.lit(False)).alias("correct"))
