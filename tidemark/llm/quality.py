"""Quality rules by host: failures are added up by domain, rates shrunk by a beta prior, verdicts joined back.

A host is what the table names as a document's source. A rule has a limit that no document may pass, and a narrower one.
For each rule, a host's rate of documents beyond the narrow limit is shrunk to a beta prior fitted to all hosts; where it
is over the prior's mean by more than SURE posterior standard deviations, the narrow limit holds for that host's
documents. A host most of whose documents fail goes as a whole. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, cut

SYMBOLS = "#*$%&|<>"
#: Rules by what is counted, for a share of which no document may hold more, and one with a suspect host may not:
#: symbols a word, exclamation marks a word, repeated lines a line (FEW_LINES are free), repeated words a word.
RULES = {"symbols": ("n_symbols", "n_words", 0.1, 0.03), "marks": ("n_marks", "n_words", 0.5, 0.1), "lines": ("n_dup_lines", "n_lines", 0.3, 0.1), "repeats": ("n_repeat_words", "n_words", 0.5, 0.2)}
FEW_LINES, WORD_CHARS = 2, (2.0, 25.0)
#: A host falls if its shrunken failure rate is over this; it is suspect by a rule as told above.
MAX_HOST_RATE, SURE = 0.5, 1.0


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def _repeat_words(words: Column, size: int = 3) -> Column:
    """Words inside windows of `size` words that occur twice or more: windows are sorted by hash, equal neighbours found."""
    n = F.size(words) - size + 1
    windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(*(F.get(words, i + k) for k in range(size))).alias("h"), i.alias("i")))
    ordered = F.sort_array(windows)

    def spread(s: Column) -> Column:
        same = lambda j: F.coalesce(F.get(s, j)["h"] == F.get(s, j + 1)["h"], F.lit(False))
        twice = F.filter(s, lambda x, j: same(j) | (same(j - 1) & (j > 0)))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        covered = lambda a: F.aggregate(a, F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last")), lambda t, x: F.struct((t["n"] + F.least(F.lit(size), x - t["last"])).alias("n"), x.alias("last")), lambda t: t["n"])
        return covered(at)

    # one value each: an expression used twice would be evaluated at each use
    return F.when(n < 2, F.lit(0)).otherwise(F.element_at(F.transform(F.array(ordered), spread), 1)).cast("long")


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and the counts of each row's whole text; a null text has no words and no lines, a null host is ''."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), t.alias("text"))
    rows = rows.withColumn("words", _words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda s: _without(s, SPACES) != "")
    rows = rows.withColumn("lines", lines)
    return rows.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(_without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - F.length(_without(F.col("text"), "!"))).cast("long").alias("n_marks"),
    )


def rules(measured: DataFrame) -> DataFrame:
    """Add base_failed, failed (the base or any limit) and for each rule near_<rule> (beyond its narrow limit)."""
    beyond = lambda count, of, limit: F.col(count) > F.greatest(F.lit(FEW_LINES if count == "n_dup_lines" else 0), limit * F.col(of))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    length = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    failed = base | ~length.between(*WORD_CHARS)
    for count, of, limit, _ in RULES.values():
        failed = failed | beyond(count, of, limit)
    near = {f"near_{name}": beyond(count, of, limit) for name, (count, of, _, limit) in RULES.items()}
    return measured.withColumns({"base_failed": base, "failed": failed, **near})


def hosts(ruled: DataFrame, sure: float = SURE) -> DataFrame:
    """host, host_docs, host_failed, host_rate and for each rule suspect_<rule>.

    Rates are shrunk to an empirical beta prior by the method of moments; with fewer than two hosts, or hosts that
    don't differ, the prior is the mean with the weight of one document.
    """
    events = {"failed": "failed", **{name: f"near_{name}" for name in RULES}}
    by = ruled.groupBy("host").agg(F.count("*").alias("host_docs"), *(F.sum(F.col(c).cast("long")).alias(f"n_{name}") for name, c in events.items()))
    rates = {name: F.col(f"n_{name}") / F.col("host_docs") for name in events}
    prior = by.agg(*(x for name, r in rates.items() for x in (F.avg(r).alias(f"m_{name}"), F.var_samp(r).alias(f"v_{name}")))).first()
    shrunk, suspect = {}, {}
    for name in events:
        m, v = prior[f"m_{name}"] or 0.0, prior[f"v_{name}"] or 0.0
        k = m * (1 - m) / v - 1 if 0 < v < m * (1 - m) else 1.0
        shrunk[name] = p = (F.col(f"n_{name}") + m * k) / (F.col("host_docs") + k)
        suspect[name] = p - m > sure * F.sqrt(p * (1 - p) / (F.col("host_docs") + k + 1))
    return by.select("host", "host_docs", F.col("n_failed").alias("host_failed"), shrunk["failed"].alias("host_rate"), *(suspect[name].alias(f"suspect_{name}") for name in RULES))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE, sure: float = SURE) -> DataFrame:
    """The measures of every row with base_failed, failed, host_rate and kept.

    A row is kept if it fails no limit, isn't beyond a narrow one by which its host is suspect, and its host's shrunken
    failure rate is at most max_host_rate. Texts without words fail the base; repeated rows are judged and counted each.
    The counts are written once, then read for the hosts and for the verdicts.
    """
    ruled = cut(rules(measures(docs, doc_id, text, host)))
    # written first, so that a host with a third of all rows can be split in the join
    verdicts = cut(hosts(ruled, sure).withColumn("host_falls", F.col("host_rate") > max_host_rate).drop("host_docs", "host_failed"))
    kept = ~F.col("failed") & ~F.col("host_falls")
    for name in RULES:
        kept = kept & ~(F.col(f"near_{name}") & F.col(f"suspect_{name}"))
    return ruled.join(verdicts, "host").withColumn("kept", kept)


def _beyond(count: str, of: str, limit: float) -> str:
    return f"{count} > greatest({FEW_LINES if count == 'n_dup_lines' else 0}, {limit} * {of})"


ORACLE_SQL = rf"""
with base as (
  select doc_id, coalesce(source, '') as host, coalesce("text", '') as body,
    list_filter(regexp_split_to_array(coalesce("text", ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce("text", ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
windows as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as tri
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from base where len(w) > 3)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, tri) as c from windows) where c > 1),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
counted as (
  select b.doc_id, host, cast(len(w) as bigint) as n_words,
    cast(length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words, len(lines) as n_lines,
    length(body) - length(replace(body, '!', '')) as n_marks
  from base b left join covered c using (doc_id)),
ruled as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    n_words < 50 or word_chars / greatest(n_words, 1) not between {WORD_CHARS[0]} and {WORD_CHARS[1]} or 100 * n_repeat_words > 50 * n_words
      or {" or ".join(_beyond(c, of, limit) for c, of, limit, _ in RULES.values())} as near_failed,
    {", ".join(f"{_beyond(c, of, limit)} as near_{name}" for name, (c, of, _, limit) in RULES.items())} from counted),
by_host as (select host, rule, count(*) as n, sum(cast(hit as int)) as f
  from (select host, unnest(['failed', {", ".join(f"'{name}'" for name in RULES)}]) as rule, unnest([near_failed, {", ".join(f"near_{name}" for name in RULES)}]) as hit from ruled) group by host, rule),
prior as (select rule, m, case when v > 0 and v < m * (1 - m) then m * (1 - m) / v - 1 else 1.0 end as k from (select rule, avg(f / n) as m, var_samp(f / n) as v from by_host group by rule)),
shrunk as (select host, rule, n, m, k, (f + m * k) / (n + k) as p from by_host join prior using (rule)),
verdict as (select host, bool_or(rule = 'failed' and p > {MAX_HOST_RATE}) as falls, {", ".join(f"bool_or(rule = '{name}' and p - m > {SURE} * sqrt(p * (1 - p) / (n + k + 1))) as suspect_{name}" for name in RULES)} from shrunk group by host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not near_failed and not falls and not ({" or ".join(f"near_{name} and suspect_{name}" for name in RULES)}) as kept
from ruled join verdict using (host)"""
