"""Places of rows in an order, without a task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, group: list[str], bucket: Column, order: list, name: str) -> DataFrame:
    """Add `name`: the row's place from 1 within its group, by bucket, then by order.

    bucket has to rise with the order; each bucket is sorted by itself and moved up by the sizes of those before.
    """
    dealt = df.withColumn("order_bucket", bucket)
    sizes = dealt.groupBy(*group, "order_bucket").count()
    before = F.sum("count").over(W.partitionBy(*group).orderBy("order_bucket").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(*group, "order_bucket", F.coalesce(before, F.lit(0)).alias("order_before"))
    place = F.row_number().over(W.partitionBy(*group, "order_bucket").orderBy(*order))
    placed = dealt.withColumn(name, place).join(sizes, [*group, "order_bucket"])
    return placed.withColumn(name, (F.col(name) + F.col("order_before")).cast("long")).drop("order_bucket", "order_before")
