"""Brightness and noise of any rectangle of pixels, by summed-area tables.

A table holds, for each pixel of an image, sums over all pixels above and to the left of it, itself included: their number,
value and square, and the same of the pixels that the mask leaves free. Any rectangle's sums are those at its four corners,
so it costs four look-ups whatever its size. Rows are summed first, then columns, and both by windows that need no more than
the pixels dealt by image once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import tools
from tidemark.sources import entities as E
from tidemark.sources.entities import table, with_entities

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: What is summed: of all pixels number and value, of free ones number, value and square.
SUMS = ("c", "s", "k", "t", "u")
EMPTY, UNKNOWN, NO_REGION, NO_ORDER = "region has no pixels inside the image", "unknown image_id", "unknown region", "x1 must be less than x2 and y1 less than y2"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def summed_areas(pixels: DataFrame) -> DataFrame:
    """vec_id, row, col and SUMS up to there; pixels: vec_id, row, col, p, masked, every pixel of a rectangle once.

    A pixel without a value counts as dark and free of no mask, one whose mask isn't known as free.
    """
    p, free = F.coalesce(F.col("p"), F.lit(0)).cast("long"), ~F.coalesce(F.col("masked"), F.lit(False))
    one = {"c": F.lit(1).cast("long"), "s": p, "k": free.cast("long"), "t": F.when(free, p).otherwise(0), "u": F.when(free, p * p).otherwise(0)}
    dealt = pixels.select("vec_id", "row", "col", *(v.alias(k) for k, v in one.items())).repartition("vec_id")
    along = lambda df, line, order: df.withColumns({k: F.sum(k).over(W.partitionBy("vec_id", line).orderBy(order).rowsBetween(W.unboundedPreceding, 0)) for k in SUMS})
    return along(along(dealt, "row", "col"), "col", "row")


def corner(v: Column, size: int) -> Column:
    """A side rounded half up and clipped to the image."""
    return F.least(F.greatest(F.floor(v + F.lit(0.5)), F.lit(0)), F.lit(size)).cast("int")


def region(name: Column, size: int) -> Column:
    """The rectangle of a region by its name as a struct x1, y1, x2, y2; null for a name that isn't one."""
    half = size // 2
    known = {"full": (0, 0, size, size), **{q: (i % 2 * half, i // 2 * half, size if i % 2 else half, size if i // 2 else half) for i, q in enumerate(G.QUADRANTS)}}
    out = F.when(F.lit(False), F.struct(*(F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2"))))
    for k, box in known.items():
        out = out.when(name == k, F.struct(*(F.lit(float(v)).alias(c) for v, c in zip(box, ("x1", "y1", "x2", "y2"), strict=True))))
    return out


def rectangle_stats(asks: DataFrame, areas: DataFrame, key: list[str], size: int) -> DataFrame:
    """key, brightness, noise, error of each ask: key columns, vec_id, x1, y1, x2, y2 (null: an unknown region); key is unique.

    A rectangle is rounded half up and clipped; it holds x1 <= col < x2. brightness is the mean of all its pixels, noise the
    deviation of its free ones, null if there are none, both to two decimals. What can't be answered has null values and an error.
    """
    sides = asks.withColumns({f"r_{c}": corner(F.col(c), size) for c in ("x1", "y1", "x2", "y2")})
    error = (
        F.when(F.col("x1").isNull() | F.col("y1").isNull() | F.col("x2").isNull() | F.col("y2").isNull(), NO_REGION)
        .when((F.col("x1") >= F.col("x2")) | (F.col("y1") >= F.col("y2")), NO_ORDER)
        .when((F.col("r_x1") >= F.col("r_x2")) | (F.col("r_y1") >= F.col("r_y2")), EMPTY)
    )
    judged = sides.select(*key, "vec_id", error.alias("error"), *(f"r_{c}" for c in ("x1", "y1", "x2", "y2")))
    at = lambda x, y, sign: F.struct((F.col(f"r_{y}") - 1).alias("row"), (F.col(f"r_{x}") - 1).alias("col"), F.lit(sign).alias("sign"))
    corners = judged.where("error is null").select(*key, "vec_id", F.explode(F.array(at("x2", "y2", 1), at("x1", "y2", -1), at("x2", "y1", -1), at("x1", "y1", 1))).alias("at"))
    corners = corners.select(*key, "vec_id", "at.*").where("row >= 0 and col >= 0")
    found = corners.join(areas, ["vec_id", "row", "col"]).groupBy(*key).agg(*(F.sum(F.col("sign") * F.col(c)).alias(c) for c in SUMS))
    noise = F.sqrt((F.col("k") * F.col("u") - F.col("t") * F.col("t")).cast("double")) / F.col("k")
    told = judged.select(*key, "error").join(found, key, "left")
    return told.select(
        *key, F.when(F.col("c") > 0, G.floor2(F.col("s") / F.col("c"))).alias("brightness"), F.when(F.col("k") > 0, G.floor2(noise)).alias("noise"),
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce(F.col("c"), F.lit(0)) == 0, UNKNOWN).alias("error"),
    )


_PIX = tools.SQL["stats"].split("stats as (")[0].rstrip().rstrip(",")
_MASKED = f"{_PIX}, px as (select vec_id, r, c, p, c - vec_id % 6 between 0 and 1 and r - vec_id % 5 between 0 and 1 as masked from pix)"


@query(
    f"""with {_MASKED} select a.vec_id, a.r::int as row, a.c::int as col, count(*) as c, sum(b.p)::bigint as s, count(*) filter (not b.masked) as k, coalesce(sum(b.p) filter (not b.masked), 0)::bigint as t, coalesce(sum(b.p * b.p) filter (not b.masked), 0)::bigint as u
  from px a join px b on b.vec_id = a.vec_id and b.r <= a.r and b.c <= a.c group by all"""
)
def summed_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed_areas(tools.pixels(table(spark, sf_dir, "embeddings")))


def around_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle of the pixel image around each label box, in pixels; image_id + 1 modulo the images and one more names the pixel image, so some aren't there."""
    n = table(spark, sf_dir, "embeddings").count()
    side = lambda c, add: ((F.col(c) + add) / 100.0).alias(c)
    return E.labels(spark, sf_dir).select("image_id", "n", (F.col("image_id") % (n + 1)).alias("vec_id"), side("x1", -30), side("y1", -30), side("x2", 30), side("y2", 30))


_ASKS = f"""asks as (select image_id, n, image_id % ((select count(*) from embeddings) + 1) as vec_id, (x1 - 30) / 100.0::double as x1, (y1 - 30) / 100.0::double as y1, (x2 + 30) / 100.0::double as x2, (y2 + 30) / 100.0::double as y2 from label),
cut as (select *, {", ".join(f"least(greatest(floor({c} + 0.5), 0), {tools.SIDE})::int as r_{c}" for c in ("x1", "y1", "x2", "y2"))} from asks)"""
_STAT = "case when count(p) > 0 then floor(sum(p) / count(p) * 100 + 0.5) / 100.0 end as brightness, case when count(f) > 0 then floor(sqrt((count(f) * sum(f * f) - sum(f) * sum(f))::double) / count(f) * 100 + 0.5) / 100.0 end as noise"


@query(
    f"""{with_entities('label')}, {_MASKED}, {_ASKS} select image_id, n, {_STAT}, case when r_x1 >= r_x2 or r_y1 >= r_y2 then '{EMPTY}' when count(p) = 0 then '{UNKNOWN}' end as error
  from cut a left join (select *, case when not masked then p end as f from px) b on b.vec_id = a.vec_id and r >= r_y1 and r < r_y2 and c >= r_x1 and c < r_x2 group by image_id, n, r_x1, r_y1, r_x2, r_y2"""
)
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brightness and noise around every label box."""
    return rectangle_stats(around_boxes(spark, sf_dir), summed_area(spark, sf_dir), ["image_id", "n"], tools.SIDE)


_NAMES = ("full", *G.QUADRANTS, "edge")


@query(
    f"""{with_entities('images')}, {_MASKED}, asks as (select image_id, image_id % (select count(*) from embeddings) as vec_id, [{", ".join(repr(n) for n in _NAMES)}][image_id % {len(_NAMES)} + 1] as region from images)
  select image_id, region, {_STAT}, case when region = 'edge' then '{NO_REGION}' when count(p) = 0 then '{UNKNOWN}' end as error from asks a left join (select *, case when not masked then p end as f from px) b
  on b.vec_id = a.vec_id and case region when 'full' then true when 'top_left' then r < 4 and c < 4 when 'top_right' then r < 4 and c >= 4 when 'bottom_left' then r >= 4 and c < 4 when 'bottom_right' then r >= 4 and c >= 4 else false end group by image_id, region"""
)
def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One named region an image, one of which isn't a region of pixels."""
    n = max(1, table(spark, sf_dir, "embeddings").count())
    name = F.element_at(F.array(*(F.lit(x) for x in _NAMES)), (F.col("image_id") % len(_NAMES) + 1).cast("int"))
    asks = E.images(spark, sf_dir).select("image_id", (F.col("image_id") % n).alias("vec_id"), name.alias("region")).withColumn("box", region(F.col("region"), tools.SIDE))
    return rectangle_stats(asks.select("image_id", "region", "vec_id", "box.*"), summed_area(spark, sf_dir), ["image_id", "region"], tools.SIDE)
