"""Images, boxes, pixels, questions and runs, derived from the star-schema tables by integer arithmetic.

Every entity has a DataFrame form and the SQL (a common table expression) that the oracle statements start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geometry as G


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, scene, scene_group, split: one row an order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("image_id"),
        F.when(F.col("o_orderstatus") == "F", "inshore").otherwise("offshore").alias("scene"),
        F.coalesce(F.col("c_nationkey"), F.lit(-1)).cast("int").alias("scene_group"),
        F.when(F.coalesce(F.col("c_nationkey"), F.lit(-1)) % 5 < 3, "test").otherwise("dev").alias("split"),
    )


def raw_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, part, supp, x, y, w, h of each line item."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    p, s, n = (F.col(c).cast("long") for c in ("l_partkey", "l_suppkey", "l_linenumber"))
    return l.select(
        F.col("l_orderkey").alias("image_id"),
        p.alias("part"),
        s.alias("supp"),
        ((p * 37 + s * 11) % 760).cast("int").alias("x"),
        ((p * 53 + n * 101) % 760).cast("int").alias("y"),
        (8 + F.col("l_quantity").cast("int")).alias("w"),
        (8 + ((p * 7 + s) % 60)).cast("int").alias("h"),
    )


def _corners(df: DataFrame, *keep: str) -> DataFrame:
    return df.select("image_id", *keep, "x", "y", F.least(F.col("x") + F.col("w"), F.lit(G.SIZE)).alias("x2"), F.least(F.col("y") + F.col("h"), F.lit(G.SIZE)).alias("y2")).withColumnsRenamed({"x": "x1", "y": "y1"})


def numbered(df: DataFrame, *more: str) -> DataFrame:
    """n from 1 in the order (y1, x1, x2, y2) of an image's boxes; equal boxes are interchangeable."""
    order = W.partitionBy("image_id").orderBy("y1", "x1", "x2", "y2", *more)
    return df.withColumn("n", F.row_number().over(order))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x1, y1, x2, y2, n of the label boxes."""
    return numbered(_corners(raw_boxes(spark, sf_dir)))


def unnumbered(spark: SparkSession, sf_dir: str, label: bool = True) -> DataFrame:
    """image_id, label, corners, score (null of labels) of the label boxes, unless left out, and the detections, from one scan: labels with misses, shifts and far copies."""
    raw = raw_boxes(spark, sf_dir).withColumn("score", (5 + (F.col("part") * 13 + F.col("supp") * 7) % 95).cast("int"))
    box = lambda is_label, x, y, score: F.struct(F.lit(is_label).alias("label"), x.cast("int").alias("x"), y.cast("int").alias("y"), score.alias("score"))
    x, y, part = F.col("x"), F.col("y"), F.col("part")
    seen = F.when(part % 7 != 0, box(False, F.when(part % 5 == 0, x + F.floor(F.col("w") / 4).cast("int")).otherwise(x), y, F.col("score")))
    far = F.when(part % 11 == 0, box(False, (x + 390) % 760, (y + 270) % 760, F.col("score")))
    own = [box(True, x, y, F.lit(None).cast("int"))] if label else []
    each = raw.select("image_id", "w", "h", F.explode(F.array(*own, seen, far)).alias("b")).where("b is not null").select("image_id", "w", "h", "b.*")
    return _corners(each, "label", "score")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x1, y1, x2, y2, score (hundredths), n: labels with misses, shifts and far copies."""
    return numbered(unnumbered(spark, sf_dir, False).drop("label"), "score").select("image_id", "x1", "y1", "x2", "y2", "score", "n")


def boxes(spark: SparkSession, sf_dir: str, source: str = "label") -> DataFrame:
    return labels(spark, sf_dir) if source == "label" else detections(spark, sf_dir).drop("score")


SQL = {
    "images": """images as (select o_orderkey as image_id, case when o_orderstatus = 'F' then 'inshore' else 'offshore' end as scene,
  cast(coalesce(c_nationkey, -1) as int) as scene_group, case when coalesce(c_nationkey, -1) % 5 < 3 then 'test' else 'dev' end as split
  from orders left join customer on o_custkey = c_custkey)""",
    "raw_boxes": """raw_boxes as (select l_orderkey as image_id, l_partkey as part, l_suppkey as supp,
  cast((l_partkey * 37 + l_suppkey * 11) % 760 as int) as x, cast((l_partkey * 53 + l_linenumber * 101) % 760 as int) as y,
  8 + cast(l_quantity as int) as w, cast(8 + (l_partkey * 7 + l_suppkey) % 60 as int) as h from lineitem)""",
    "label": """label as (select *, row_number() over (partition by image_id order by y1, x1, x2, y2) as n
  from (select image_id, x as x1, y as y1, least(x + w, 800) as x2, least(y + h, 800) as y2 from raw_boxes))""",
    "detected": """detected as (select *, row_number() over (partition by image_id order by y1, x1, x2, y2, score) as n
  from (select image_id, x as x1, y as y1, least(x + w, 800) as x2, least(y + h, 800) as y2, score from (
    select image_id, case when part % 5 = 0 then x + w // 4 else x end as x, y, w, h, cast(5 + (part * 13 + supp * 7) % 95 as int) as score from raw_boxes where part % 7 <> 0
    union all select image_id, (x + 390) % 760, (y + 270) % 760, w, h, cast(5 + (part * 13 + supp * 7) % 95 as int) from raw_boxes where part % 11 = 0)))""",
}
NEEDS = {"label": ("raw_boxes",), "detected": ("raw_boxes",)}


def with_entities(*names: str) -> str:
    """The WITH clause that defines the named entities and what they need."""
    found: list[str] = []
    for name in names:
        for x in (*NEEDS.get(name, ()), name):
            if x not in found:
                found.append(x)
    return "with " + ",\n".join(SQL[x] for x in found)
