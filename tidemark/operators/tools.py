"""The box, pair, metadata and pixel tools, each over all images at once. A tool that fails gives nulls for that image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators.spatial import nearest_pair, neighbours

__all__ = ["facts", "first_largest", "nearest_pair", "neighbours", "pairs", "pixel_stats", "pixels", "stats_by_quadrant", "with_stats", "with_tools"]

#: Boxes of at least this long side count as long.
LONG = 45
#: Pixel images stand in the embeddings, 8 x 8 each; images share them in turn.
SIDE = 8


def facts(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row an image, images without boxes included: counts by region, lengths, edge boxes."""
    b = boxes.withColumn("side", G.long_side()).withColumn("q", G.quadrant())
    per = b.groupBy("image_id").agg(
        *told_of_boxes(),
        F.max(F.struct("side", (-F.col("n")).alias("k")))["k"].alias("longest"),
        F.min(F.struct("side", F.col("n").alias("k")))["k"].alias("shortest"),
    )
    per = per.withColumn("longest", -F.col("longest"))
    whole = images.join(per, "image_id", "left")
    counts = [c for c in per.columns if c.startswith(("n_", "long_"))]
    return whole.fillna(0, counts)


def told_of_boxes() -> list[Column]:
    """The aggregates over boxes with their side and quadrant q that need no order: whole numbers alone, so a hash holds them."""
    count = F.count_if
    return [
        F.count("*").alias("n_boxes"),
        *(count(F.col("q") == q).alias(f"n_{q}") for q in G.QUADRANTS),
        *(count((F.col("q") == q) & (F.col("side") >= LONG)).alias(f"long_{q}") for q in G.QUADRANTS),
        *(F.max(F.when(F.col("q") == q, F.col("side"))).alias(f"max_{q}") for q in G.QUADRANTS),
        count(G.near_edge()).alias("n_edge"),
        count(G.inside(100, 100, 500, 500)).alias("n_rect"),
        count(F.col("side") >= LONG).alias("n_long"),
        F.max("side").alias("max_side"),
        F.min("side").alias("min_side"),
    ]


def pairs(boxes: DataFrame) -> DataFrame:
    """All pairs a < b of an image's boxes with d4; for the nearest ones see spatial."""
    a, b = boxes.alias("a"), boxes.alias("b")
    return a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.n") < F.col("b.n"))).select(F.col("a.image_id"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), G.d4("a", "b").alias("d4"))


def pixels(embeddings: DataFrame) -> DataFrame:
    """vec_id, row, col, p, masked: the 64 pixels of each image; the mask is the label box of two by two."""
    level = F.least(F.greatest(F.floor((F.col("v").cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int")
    each = embeddings.select("vec_id", F.posexplode("embedding").alias("i", "v"))
    row, col = F.floor(F.col("i") / SIDE).cast("int"), (F.col("i") % SIDE).cast("int")
    dx, dy = col - F.col("vec_id") % 6, row - F.col("vec_id") % 5
    return each.select("vec_id", row.alias("row"), col.alias("col"), level.alias("p"), (dx.between(0, 1) & dy.between(0, 1)).alias("masked"))


def pixel_stats(embeddings: DataFrame) -> DataFrame:
    """vec_id, region (a quadrant or full), brightness and noise; noise leaves the mask out and is null if nothing is left."""
    q = F.when((F.col("row") < 4) & (F.col("col") < 4), G.QUADRANTS[0]).when(F.col("row") < 4, G.QUADRANTS[1]).when(F.col("col") < 4, G.QUADRANTS[2]).otherwise(G.QUADRANTS[3])
    each = pixels(embeddings).withColumn("region", F.explode(F.array(F.lit("full"), q)))
    free = F.when(~F.col("masked"), F.col("p").cast("long"))
    sums = each.groupBy("vec_id", "region").agg(F.count("*").alias("c"), F.sum(F.col("p").cast("long")).alias("s"), F.count(free).alias("k"), F.sum(free).alias("t"), F.sum(free * free).alias("u"))
    noise = F.sqrt((F.col("k") * F.col("u") - F.col("t") * F.col("t")).cast("double")) / F.col("k")
    return sums.select("vec_id", "region", G.floor2(F.col("s") / F.col("c")).alias("brightness"), F.when(F.col("k") > 0, G.floor2(noise)).alias("noise"))


def stats_by_quadrant(embeddings: DataFrame) -> DataFrame:
    """One row a pixel image: brightness and noise of the whole and of each quadrant."""
    regions = ["full", *G.QUADRANTS]
    wide = pixel_stats(embeddings).groupBy("vec_id").agg(*(F.max(F.when(F.col("region") == r, F.col(c))).alias(f"{c}_{r}") for r in regions for c in ("brightness", "noise")))
    return wide


def with_stats(images: DataFrame, embeddings: DataFrame) -> DataFrame:
    """images with the statistics of their pixel image: the one whose number is the image's modulo their count."""
    return images.withColumn("vec_id", F.col("image_id") % max(1, embeddings.count())).join(stats_by_quadrant(embeddings), "vec_id", "left").drop("vec_id")


def first_largest(columns: list[tuple[str, str]]):
    """The name whose column is largest; the first of equal ones; null if all are."""
    top = F.greatest(*(F.col(c) for c, _ in columns))
    out = None
    for c, name in columns:
        out = F.when(F.col(c) == top, name) if out is None else out.when(F.col(c) == top, name)
    return out


SQL = {
    "facts": f"""boxf as (select image_id, count(*) as n_boxes,
  {", ".join(f"count(*) filter (q = '{q}') as n_{q}, count(*) filter (q = '{q}' and side >= {LONG}) as long_{q}, max(side) filter (q = '{q}') as max_{q}" for q in G.QUADRANTS)},
  count(*) filter (x1 <= 20 or y1 <= 20 or x2 >= 780 or y2 >= 780) as n_edge,
  count(*) filter (x1 + x2 >= 200 and x1 + x2 < 1000 and y1 + y2 >= 200 and y1 + y2 < 1000) as n_rect,
  count(*) filter (side >= {LONG}) as n_long, max(side) as max_side, min(side) as min_side,
  arg_min(n, -side * 1000000 + n) as longest, arg_min(n, side * 1000000 + n) as shortest
  from (select *, greatest(x2 - x1, y2 - y1) as side, case when y1 + y2 < 800 then case when x1 + x2 < 800 then 'top_left' else 'top_right' end
    else case when x1 + x2 < 800 then 'bottom_left' else 'bottom_right' end end as q from label) group by image_id),
facts as (select image_id, scene, scene_group, split, {", ".join(f"coalesce({c}, 0) as {c}" for c in ("n_boxes", "n_edge", "n_rect", "n_long", *(f"{p}_{q}" for q in G.QUADRANTS for p in ("n", "long"))))},
  {", ".join(f"max_{q}" for q in G.QUADRANTS)}, max_side, min_side, longest, shortest from images left join boxf using (image_id))""",
    "pairs": """pairs as (select a.image_id, a.n as na, b.n as nb, cast((a.x1 + a.x2 - b.x1 - b.x2) ** 2 + (a.y1 + a.y2 - b.y1 - b.y2) ** 2 as bigint) as d4
  from label a join label b on a.image_id = b.image_id and a.n < b.n)""",
    "nearest": """nearest as (select image_id, na, nb, d4 from (select *, row_number() over (partition by image_id order by d4, na, nb) as r from pairs) where r = 1)""",
    "neighbours": """neighbours as (select image_id, n, other, d4 from (select *, row_number() over (partition by image_id, n order by d4, other) as r
  from (select image_id, na as n, nb as other, d4 from pairs union all select image_id, nb, na, d4 from pairs)) where r = 1)""",
    "stats": """pix as (select vec_id, (i - 1) // 8 as r, (i - 1) % 8 as c, cast(least(greatest(floor((cast(embedding[i] as double) + 1) * 127.5), 0), 255) as bigint) as p
  from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)),
stats as (select vec_id, region, floor(sum(p) / count(*) * 100 + 0.5) / 100.0 as brightness,
  case when count(f) > 0 then floor(sqrt(cast(count(f) * sum(f * f) - sum(f) * sum(f) as double)) / count(f) * 100 + 0.5) / 100.0 end as noise
  from (select vec_id, p, case when not (c - vec_id % 6 between 0 and 1 and r - vec_id % 5 between 0 and 1) then p end as f,
    unnest(['full', case when r < 4 and c < 4 then 'top_left' when r < 4 then 'top_right' when c < 4 then 'bottom_left' else 'bottom_right' end]) as region from pix) group by vec_id, region),
wide as (select vec_id, """
    + ", ".join(f"max({c}) filter (region = '{r}') as {c}_{r}" for r in ("full", *G.QUADRANTS) for c in ("brightness", "noise"))
    + """ from stats group by vec_id)""",
}
NEEDS = {"nearest": ("pairs",), "neighbours": ("pairs",)}


def with_tools(*names: str) -> str:
    """More common table expressions, to go after sources.entities.with_entities."""
    found: list[str] = []
    for name in names:
        for x in (*NEEDS.get(name, ()), name):
            if x not in found:
                found.append(x)
    return "".join(",\n" + SQL[x] for x in found)
