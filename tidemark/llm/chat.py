"""Chat formatting with a grammar that is parsed back before a text is let out.

    conversation = ("0" | "1") turn*
    turn         = "<s>" text "</s>"                 an assistant's turn, its text under the loss mask
                 | "[INST]" role "\\n" text "[/INST]"  any other turn

Level 0 writes texts as they are. The result is parsed, and if the turns aren't the source's, level 1 writes it anew:
a backslash is doubled, and every control string inside a text or role gets a backslash after its first character;
a reader takes any character after a backslash as it is. Both levels are expressions, with no code outside Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"(<|\[)(/?(?:s>|INST\]))"
TURN = r"(?s)<s>.*?</s>|\[INST\][^\n]*\n.*?\[/INST\]"
#: The conversation that every query adds: its texts hold the template's own control strings.
TRAP_ID, TRAP = -7, "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    """A text without control strings."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    """A role may hold any text; a line break would end the line that names it, so 1F stands for it, and 1F is escaped."""
    return F.replace(F.replace(escape(role), F.lit("\x1f"), F.lit("\\\x1f")), F.lit("\n"), F.lit("\x1f"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\x1f", "$1\n"))


def _turn(role: Column, text: Column) -> Column:
    return F.when(role == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>"))).otherwise(F.concat(F.lit("[INST]"), role, F.lit("\n"), text, F.lit("[/INST]")))


def render(turns: Column, level: int) -> Column:
    """turns: an array of structs (role, text)."""
    put = escape if level else (lambda c: c)
    role = _escape_role if level else (lambda c: c)
    return F.concat(F.lit(str(level)), F.array_join(F.transform(turns, lambda t: _turn(role(t["role"]), put(t["text"]))), ""))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of structs (role, text, loss)."""
    level = F.substring(formatted, 1, 1)

    def one(s: Column) -> Column:
        loss = s.startswith("<s>")
        body = F.when(loss, F.substring(s, F.lit(4), F.length(s) - 7)).otherwise(F.substring(s, F.lit(7), F.length(s) - 13))
        at = F.instr(body, "\n")
        role = F.when(loss, F.lit("assistant")).otherwise(F.substring(body, F.lit(1), at - 1))
        text = F.when(loss, body).otherwise(F.substring(body, at + 1, F.length(body)))
        return F.struct(
            F.when(level == "1", _unescape_role(role)).otherwise(role).alias("role"),
            F.when(level == "1", unescape(text)).otherwise(text).alias("text"),
            loss.alias("loss"),
        )

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), one)


def _same(parsed: Column, turns: Column) -> Column:
    return F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == turns


def conversations(rows: DataFrame) -> DataFrame:
    """One row (conv_id, turns) for each conversation; turns in the order of turn, ties by role and text.

    Null roles and texts count as empty, repeated rows stay, a null conv_id is a conversation like any other. The
    turns of one conversation are one value, as its digest needs them all.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.sort_array(F.collect_list(row))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns (as given), formatted, parsed (read back from formatted) for each conversation.

    Level 0 is taken where it reads back the same and covers the whole text, else level 1. A conversation that
    neither level brings back would end the job with an error.
    """
    found = conversations(rows)
    for level in (0, 1):
        found = found.withColumn(f"level{level}", render(F.col("turns"), level))
    whole = F.length(F.array_join(F.regexp_extract_all("level0", F.lit(TURN), F.lit(0)), "")) == F.length("level0") - 1
    plain = whole & _same(parse(F.col("level0")), F.col("turns"))
    found = found.withColumn("formatted", F.when(plain, F.col("level0")).otherwise(F.col("level1"))).drop("level0", "level1")
    found = found.withColumn("parsed", parse(F.col("formatted")))
    checked = F.when(_same(F.col("parsed"), F.col("turns")), F.col("parsed")).otherwise(F.raise_error(F.lit("a conversation doesn't read back")))
    return found.withColumn("parsed", checked)


def with_trap(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    trap = spark.createDataFrame([(TRAP_ID, 0, "user", TRAP), (TRAP_ID, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(trap)


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted text gets: turns, loss-masked text, and their digests."""
    loss = F.array_join(F.transform(F.filter("parsed", lambda t: t["loss"]), lambda t: t["text"]), "")
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql() -> str:
    escaped = lambda c: rf"regexp_replace(replace({c}, '\', '\\'), '(<|\[)(/?(s>|INST\]))', '\1\\\2', 'g')"
    return rf"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce("text", '') as body from conversations
  union all select {TRAP_ID}, 0, 'user', '{TRAP}' union all select {TRAP_ID}, 1, 'assistant', '{TRAP}'),
conv as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || body || chr(10), '' order by turn, role, body) as turns,
    coalesce(string_agg(body, '' order by turn, role, body) filter (role = 'assistant'), '') as loss,
    bool_or(case when role = 'assistant' then body like '%</s>%' else body like '%[/INST]%' or role like '%' || chr(10) || '%' end) as conflict,
    sum(case when role = 'assistant' then 7 else 14 + length(role) end) as marks,
    sum(length(body)) as plain, sum(length({escaped("body")})) as escaped
  from rows group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256,
  cast(1 + marks + case when conflict then escaped else plain end as bigint) as formatted_chars
from conv"""


ORACLE_SQL = _sql()
