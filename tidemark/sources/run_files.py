"""Run records as files: JSON lines by condition, appended and read as one; CSV with a header and a byte order mark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shared import ensure_checkpoint_dir
from tidemark.sources.entities import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
RECORD = "run_id string, cond int, qid long, answer long, note string"
CORRUPT = "_corrupt_record"
MARK = "\ufeff"


def append_records(records: DataFrame, folder: str) -> None:
    """Add rows to the folder condition_<cond> of each condition.

    Each append writes files of its own under Spark's commit protocol, so a line cut off by a lost writer can't run into
    the next record.
    """
    records.withColumn("folder", F.format_string("condition_%02d", "cond")).write.partitionBy("folder").mode("append").json(folder)


def read_records(spark: SparkSession, folder: str, schema: str = RECORD) -> DataFrame:
    """All records of all conditions, with _corrupt_record: the text of a line that doesn't parse, else null. Blank lines have no row."""
    lines = spark.read.text(f"{folder}/*condition_*").where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    return lines.select(parsed.alias("r")).select("r.*")


def load_records(spark: SparkSession, folder: str, schema: str = RECORD) -> DataFrame:
    """The records that parse."""
    return read_records(spark, folder, schema).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header that starts with the byte order mark; texts with quotes, commas and line ends stay whole."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, MARK + first).write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV files with a header, with or without the byte order mark; all columns are texts unless a schema is given.

    CSV doesn't tell an empty text from a missing one: both come back as null."""
    # texts may hold line ends, so a file is read by one task; write as many files as tasks are wanted
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "enforceSchema": True}
    rows = spark.read.options(**options)
    found = rows.schema(schema).csv(path) if schema else rows.csv(path)
    return found.toDF(*(c.removeprefix(MARK) for c in found.columns))


def union_of_tables(*tables: DataFrame) -> DataFrame:
    """Rows of all, under all columns that any has; what a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test input: one record an event, with notes that hold quotes, commas and line ends."""
    e = F.col("event_id")
    note = F.when(e % 4 == 0, 'said "two", then\nthree').when(e % 4 == 1, F.concat(F.lit(" a,b "), e)).when(e % 4 == 2, F.lit("픽셀"))
    return table(spark, sf_dir, "events").select(F.md5(e.cast("string").cast("binary")).alias("run_id"), (e % 11 + 1).cast("int").alias("cond"), e.cast("long").alias("qid"), F.when(e % 7 != 0, F.col("user_id")).cast("long").alias("answer"), note.alias("note"))


_NOTE = """case event_id % 4 when 0 then 'said "two", then' || chr(10) || 'three' when 1 then ' a,b ' || event_id when 2 then '픽셀' end"""
_MADE = f"made as (select md5(cast(event_id as varchar)) as run_id, cast(event_id % 11 + 1 as int) as cond, event_id as qid, case when event_id % 7 <> 0 then user_id end as answer, {_NOTE} as note from events)"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"with {_MADE} select run_id, cond, qid, answer, note from made")
def record_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended in two batches, and a file with cut-off lines, read as one."""
    folder, made = _folder(spark, "records"), _made(spark, sf_dir)
    append_records(made.where("qid % 2 = 0"), folder)
    append_records(made.where("qid % 2 = 1"), folder)
    torn = spark.range(3).select(F.concat(F.lit('{"run_id":"torn'), "id").alias("value"))
    torn.write.text(f"{folder}/condition_torn")
    return load_records(spark, folder)


@query(f"with {_MADE} select run_id, cond, qid, answer, note, case when qid % 2 = 1 then 'odd' end as extra from made")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of different columns written under the union of their columns, and read back."""
    path, made = _folder(spark, "csv"), _made(spark, sf_dir)
    write_csv(union_of_tables(made.where("qid % 2 = 0"), made.where("qid % 2 = 1").withColumn("extra", F.lit("odd"))), path)
    return read_csv(spark, path, f"{RECORD}, extra string")
