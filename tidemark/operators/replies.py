"""Checks of agents' replies, JSON texts, as expressions over parsed variants; a reply that isn't JSON has a problem, not an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.entities import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: What a step, a reading and a decision must have, and the problems' texts.
STEP, READING, DECISION = ("reading", "decision", "action"), ("from", "field", "value"), ("condition_from", "condition_value", "threshold", "cmp", "chosen")
NOT_STEP = "reply must be an object with reading, decision, action"
NOT_LIST = "reading must be a list"
NOT_READING = "reading[%s] needs from, field, value"
NOT_DECISION = "decision must be null or {condition_from, condition_value, threshold, cmp, chosen}"
NOT_ACTION = "action.type must be 'tool' or 'answer'"
NOT_TOOL = "a tool action needs `tool` (string) and `args` (object)"
NOT_ANSWER = "the answer needs `answer` and `unit`"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Test input: parts of replies, good and bad, put together by the numbers of a conversation's turn.
_READINGS = ["[]", '[{"from":"$c1","field":"value","value":3}]', '[{"from":"$c1","field":"value"},{"from":"$c2","field":"n","value":null},7]', '"none"', '{"from":"$c1"}']
_DECISIONS = ["null", '{"condition_from":"$c1.value","condition_value":3,"threshold":2,"cmp":">","chosen":"then"}', '{"condition_from":"$c1.value","condition_value":3,"threshold":2,"cmp":">","chosen":"both"}', '{"chosen":"else"}']
_ACTIONS = ['{"type":"tool","tool":"calc","args":{"op":"add"}}', '{"type":"answer","answer":3,"unit":"ships"}', '{"type":"tool","tool":7,"args":{}}', '{"type":"tool","tool":"calc","args":[1]}', '{"type":"answer","answer":null}', '{"type":"wait"}', '"answer"']


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, reply."""
    k = F.col("conv_id") * 31 + F.col("turn") * 7
    pick = lambda xs, v: F.get(F.array(*(F.lit(x) for x in xs)), (v % len(xs)).cast("int"))
    whole = F.concat(F.lit('{"reading":'), pick(_READINGS, k), F.lit(',"decision":'), pick(_DECISIONS, F.floor(k / 5)), F.lit(',"action":'), pick(_ACTIONS, F.floor(k / 3)), F.lit("}"))
    reply = F.when(k % 29 == 0, F.substring(whole, F.lit(1), F.length(whole) - 2)).when(k % 23 == 0, F.lit('{"reading":[],"action":{}}')).when(k % 19 == 0, F.lit("[1]")).otherwise(whole)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().select("conv_id", "turn", reply.alias("reply"))


def _has(v: Column, *keys: str) -> Column:
    """Is v an object with all the keys, null values counted?"""
    here = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")), F.lit(False))
    for key in keys:
        here = here & F.try_variant_get(v, f"$.{key}", "variant").isNotNull()
    return here


def step_problems(reply: Column) -> Column:
    """The problems of a step's reply, in the order reading, decision, action; an empty list if there are none."""
    v = F.try_parse_json(reply)
    at = lambda path, kind="variant": F.try_variant_get(v, path, kind)
    listed = F.coalesce(F.startswith(F.schema_of_variant(at("$.reading")), F.lit("ARRAY<")), F.lit(False))
    reading = F.when(~listed, F.array(F.lit(NOT_LIST))).otherwise(
        F.filter(F.transform(at("$.reading", "array<variant>"), lambda r, i: F.when(~_has(r, *READING), F.format_string(NOT_READING, i))), lambda p: p.isNotNull())
    )
    ok = F.is_variant_null(at("$.decision")) | (_has(at("$.decision"), *DECISION) & F.coalesce(at("$.decision.chosen", "string").isin("then", "else"), F.lit(False)))
    decision = F.when(~ok, NOT_DECISION)
    kind = F.when(_has(at("$.action"), "type"), at("$.action.type", "string"))
    tool = (F.schema_of_variant(at("$.action.tool")) == "STRING") & _has(at("$.action.args"))
    action = F.when(kind == "tool", F.when(~F.coalesce(tool, F.lit(False)), NOT_TOOL)).when(kind == "answer", F.when(~_has(at("$.action"), "answer", "unit"), NOT_ANSWER)).otherwise(NOT_ACTION)
    found = F.array_compact(F.concat(reading, F.array(decision, action)))
    return F.when(~_has(v, *STEP), F.array(F.lit(NOT_STEP))).otherwise(found)


_ARRAY = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_Q = lambda x: "'" + x.replace("'", "''") + "'"
_KEYS = lambda v, keys: f"coalesce(json_type({v}) = 'OBJECT' and " + " and ".join(f"json_exists({v}, '$.{k}')" for k in keys) + ", false)"
_MADE = f"""made as (select conv_id, turn, case when k % 29 = 0 then substr(whole, 1, length(whole) - 2) when k % 23 = 0 then '{{"reading":[],"action":{{}}}}' when k % 19 = 0 then '[1]' else whole end as reply
  from (select *, '{{"reading":' || ({_ARRAY(_READINGS)})[k % {len(_READINGS)} + 1] || ',"decision":' || ({_ARRAY(_DECISIONS)})[k // 5 % {len(_DECISIONS)} + 1] || ',"action":' || ({_ARRAY(_ACTIONS)})[k // 3 % {len(_ACTIONS)} + 1] || '}}' as whole
    from (select distinct conv_id, turn, conv_id * 31 + turn * 7 as k from conversations)))"""
_PARSED = f"""{_MADE}, v as (select conv_id, turn, try_cast(reply as json) as j from made),
w as (select *, j -> '$.reading' as rd, j -> '$.decision' as dc, j -> '$.action' as ac from v)"""
_DEC = f"(json_type(dc) = 'NULL' or ({_KEYS('dc', DECISION)} and coalesce(dc ->> '$.chosen' in ('then', 'else'), false)))"
_ACT = f"""case when json_type(ac) = 'OBJECT' and ac ->> '$.type' = 'tool' then case when not coalesce(json_type(ac, '$.tool') = 'VARCHAR' and json_type(ac, '$.args') = 'OBJECT', false) then {_Q(NOT_TOOL)} end
  when json_type(ac) = 'OBJECT' and ac ->> '$.type' = 'answer' then case when not {_KEYS('ac', ('answer', 'unit'))} then {_Q(NOT_ANSWER)} end else {_Q(NOT_ACTION)} end"""


@query(
    f"""with {_PARSED}, r as (select conv_id, turn, string_agg('reading[' || i || '] needs from, field, value', '; ' order by i) as rp
    from (select conv_id, turn, unnest(cast(rd as json[])) as x, unnest(range(0, cast(json_array_length(rd) as bigint))) as i from w where json_type(rd) = 'ARRAY') where not {_KEYS('x', READING)} group by all)
  select conv_id, turn, case when not {_KEYS('j', STEP)} then '{NOT_STEP}' else concat_ws('; ', case when json_type(rd) <> 'ARRAY' then '{NOT_LIST}' else rp end, case when not {_DEC} then '{NOT_DECISION}' end, {_ACT}) end as problems from w left join r using (conv_id, turn)"""
)
def reply_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each reply; parsing and checks are one projection."""
    return made(spark, sf_dir).select("conv_id", "turn", F.array_join(step_problems(F.col("reply")), "; ").alias("problems"))
