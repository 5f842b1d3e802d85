"""Run records as a stream: repeats of a record are dropped, counts are kept up to date, late records have a limit.

Each micro-batch's result is written to the folder that driver and executors share, beside the stream's own checkpoint,
so a restarted query goes on where it was and rewrites at most the batch it was in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shared import ensure_checkpoint_dir

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: How late a record may be; repeats of a record are known for as long.
LATE = "1 day"


def stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def once(records: DataFrame, key: str = "event_id") -> DataFrame:
    """The records without those that came before under the same key, and a watermark on ts."""
    return records.withWatermark("ts", LATE).dropDuplicatesWithinWatermark([key])


def daily(records: DataFrame) -> DataFrame:
    """Tumbling windows of a day by event time, given out once no record for them is taken any more."""
    return once(records).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))


def drained(spark: SparkSession, frame: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """All that is there now, run through the stream, and its results so far: in append mode those of all batches, in
    complete mode the last batch's. A folder given again goes on with its stream."""
    folder = folder or f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{'all' if mode == 'append' else 'last'}/{f'batch={number}' if mode == 'append' else ''}")

    running = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    running.awaitTermination()
    found = spark.read.schema(frame.schema).parquet(f"{folder}/{'all' if mode == 'append' else 'last'}")
    return found.drop("batch")


def running_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and users' total by kind, in complete mode: the state is one row a kind."""
    counted = stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").cast("long").alias("users"))
    return drained(spark, counted, "complete")


def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that are over, by the latest record and the limit for late ones."""
    return drained(spark, daily(stream(spark, sf_dir)), "append").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES |= {"running_summary": running_summary, "daily_windows": daily_windows}
ORACLE_SQL |= {
    "running_summary": "select event_type, count(*) as n, cast(sum(user_id) as bigint) as users from events group by event_type",
    "daily_windows": """select strftime(day, '%Y-%m-%d') as day, event_type, count(distinct event_id) as n from (select date_trunc('day', cast(ts as timestamp)) as day, event_type, event_id from events)
  where day + interval 1 day <= (select max(cast(ts as timestamp)) - interval 1 day from events) group by all""",
}
