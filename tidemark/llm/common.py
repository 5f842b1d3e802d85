"""Helpers shared by the corpus operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shared import cut, ensure_checkpoint_dir

__all__ = ["crc_bucket", "cut", "ensure_checkpoint_dir", "fresh", "in_file_order", "join_counted", "ranked", "read", "slices", "values"]
#: Characters that separate words: space and the ASCII controls tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: Rows of one group that one task ranks.
BUCKET_ROWS = 500_000
#: Keys of a join that are looked up without a shuffle at most, and the rows that such a key has at least.
HOT_KEYS, HOT_ROWS = 1000, 10_000


def values(column: pa.Array, size: int = 256):
    """A column's values as Python objects, of which few are there at a time, however long the texts are."""
    for at in range(0, len(column), size):
        yield from column.slice(at, size).to_pylist()


def slices(batches, size: int = 512):
    """Arrow batches in parts of a few rows, so that what is made of a part is small too; none for an empty batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def in_file_order(docs: DataFrame, part: str, row: str) -> DataFrame:
    """docs, read from the files of one write, with the number of the row's file and the row's number in it.

    Spark numbers files by partition (part-00007-...), then by c000, c001 if a partition's rows fill several.
    """
    name = F.col("_metadata.file_name")
    number = [F.regexp_extract(name, pattern, 1).cast("long") for pattern in (r"^part-(\d+)", r"c(\d+)\.[^-]*$")]
    return docs.select("*", (number[0] * 1_000_000 + number[1]).alias(part), F.col("_metadata.row_index").alias(row))


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], n: str) -> DataFrame:
    """rows joined with table, whose keys are unique and whose column n says how many rows of rows have the key.

    The HOT_KEYS keys with the most rows are broadcast, so rows of a key with a third of all stay where they are, and
    those of the other keys meet in a shuffle in which no key has over a HOT_KEYS-th of all. Both sides are read twice.
    """
    (hot,) = fresh(rows, "hot")
    most = table.where(F.col(n) >= HOT_ROWS).orderBy(F.desc(n), *on).limit(HOT_KEYS).withColumn(hot, F.lit(True))
    marked = rows.join(F.broadcast(most.select(*on, hot)), on, "left")
    there = rows.join(F.broadcast(most.drop(hot)), on)
    return there.unionByName(marked.where(F.col(hot).isNull()).drop(hot).join(table, on))


def ranked(df: DataFrame, group: Column, order: list[Column], name: str, buckets: int | None = None, bucket: Column | None = None) -> DataFrame:
    """Add `name`: the row's rank from 0 within its group.

    Rows of a group are dealt to `buckets` (default: 64, and more beyond BUCKET_ROWS rows each) by a hash of the order columns, ranked there, and moved up by the
    sizes of the buckets before, so a group that holds a third of all rows isn't sorted by one task. The order
    is by bucket, then by `order`. A given `bucket` (long, not null) that rises with the order makes it the order alone.
    df has to be stable (a table or a checkpoint), as it is read twice.
    """
    from pyspark.sql import Window as W

    if buckets is None and bucket is None:
        buckets = max(64, df.count() // BUCKET_ROWS)
    g, b, n = fresh(df, "rank_group", "rank_bucket", "rank_before")
    dealt = df.withColumn(g, group).withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int") if bucket is None else bucket)
    sizes = dealt.groupBy(g, b).count()
    before = sizes.select(g, b, F.coalesce(F.sum("count").over(W.partitionBy(g).orderBy(b).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(n))
    rank = F.row_number().over(W.partitionBy(g, b).orderBy(*order)) - 1
    return dealt.withColumn(name, rank).join(before, [g, b]).withColumn(name, F.col(name) + F.col(n)).drop(g, b, n)
