"""Queries of the sources, geometry predicates, tools and calculator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import tools
from tidemark.operators.tools import with_tools
from tidemark.sources import entities as E
from tidemark.sources.entities import table, with_entities

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


LABEL = with_entities("label")
BOTH = with_entities("images", "label")


@query(f"{BOTH} select image_id, list(struct_pack(n := n, x1 := x1, y1 := y1, x2 := x2, y2 := y2) order by n) filter (n is not null) is not null as has_boxes, count(n) as n_boxes, coalesce(string_agg(x1 || ' ' || y1 || ' ' || x2 || ' ' || y2, ';' order by n), '') as boxes from images left join label using (image_id) group by image_id")
def boxes_by_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = E.labels(spark, sf_dir).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("n", F.concat_ws(" ", "x1", "y1", "x2", "y2").alias("b")))).alias("b"))
    joined = E.images(spark, sf_dir).select("image_id").join(per, "image_id", "left")
    n = F.coalesce(F.size("b"), F.lit(0)).cast("long")
    n = F.when(F.col("b").isNull(), F.lit(0)).otherwise(n).cast("long")
    return joined.select("image_id", F.col("b").isNotNull().alias("has_boxes"), n.alias("n_boxes"), F.coalesce(F.array_join(F.transform("b", lambda x: x["b"]), ";"), F.lit("")).alias("boxes"))


@query(f"{with_entities('raw_boxes')} select image_id, x as x1, y as y1, x + w as x2, y + h as y2, count(*) as n from raw_boxes group by all")
def bbox_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.raw_boxes(spark, sf_dir).groupBy("image_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2")).agg(F.count("*").alias("n"))


_NAME = "case when o_orderkey % 7 = 0 then 'scene' || o_orderkey || '.txt' when o_orderkey % 3 = 0 then printf('P%04d.jpg', o_custkey) else printf('P%04d_%d_%d_%d_%d.jpg', o_custkey, o_orderkey % 800, o_orderkey % 800 + 800, o_orderkey % 600, o_orderkey % 600 + 800) end"


@query(
    f"""with names as (select o_orderkey as image_id, {_NAME} as file_name from orders),
  parts as (select *, regexp_extract(file_name, '^(P[0-9]+)(_[0-9]+_[0-9]+_[0-9]+_[0-9]+)?\\.jpg$', 1) as s, regexp_extract(file_name, '^P[0-9]+_([0-9]+)_([0-9]+)_([0-9]+)_([0-9]+)\\.jpg$', ['a', 'b', 'c', 'd']) as c from names)
  select image_id, file_name, nullif(s, '') as scene_name, try_cast(nullif(c.a, '') as int) as crop_x1, try_cast(nullif(c.b, '') as int) as crop_x2, try_cast(nullif(c.c, '') as int) as crop_y1, try_cast(nullif(c.d, '') as int) as crop_y2 from parts"""
)
def parse_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(k % 7 == 0, F.concat(F.lit("scene"), k, F.lit(".txt"))).when(k % 3 == 0, F.format_string("P%04d.jpg", c)).otherwise(F.format_string("P%04d_%d_%d_%d_%d.jpg", c, k % 800, k % 800 + 800, k % 600, k % 600 + 800))
    names = table(spark, sf_dir, "orders").select(k.alias("image_id"), name.alias("file_name"))
    scene = F.regexp_extract("file_name", r"^(P[0-9]+)(_[0-9]+_[0-9]+_[0-9]+_[0-9]+)?\.jpg$", 1)
    part = lambda i: F.nullif(F.regexp_extract("file_name", r"^P[0-9]+_([0-9]+)_([0-9]+)_([0-9]+)_([0-9]+)\.jpg$", i), F.lit("")).cast("int")
    return names.select("image_id", "file_name", F.nullif(scene, F.lit("")).alias("scene_name"), *(part(i + 1).alias(f"crop_{n}") for i, n in enumerate(("x1", "x2", "y1", "y2"))))


@query(f"{LABEL} select image_id, 's' || n as id, n, x1, y1, x2, y2 from label")
def normalize_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.labels(spark, sf_dir).select("image_id", F.concat(F.lit("s"), "n").alias("id"), "n", "x1", "y1", "x2", "y2")


@query(f"{with_entities('detected')} select image_id, x1, y1, x2, y2, count(*) as n from detected where score >= 60 group by all")
def detected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.detections(spark, sf_dir).where("score >= 60").groupBy("image_id", "x1", "y1", "x2", "y2").agg(F.count("*").alias("n"))


@query("select score, count(*) as n from (select cast(5 + (l_partkey * 13 + l_suppkey * 7) % 95 as int) as score from lineitem) where score >= 50 group by score")
def score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.raw_boxes(spark, sf_dir).select((5 + (F.col("part") * 13 + F.col("supp") * 7) % 95).cast("int").alias("score")).where("score >= 50").groupBy("score").agg(F.count("*").alias("n"))


@query("select distinct l_orderkey + 3 as image_id, 'unknown image' as error from lineitem where l_orderkey + 3 not in (select o_orderkey from orders)")
def unknown_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 3).alias("image_id")).distinct()
    return asked.join(E.images(spark, sf_dir).select("image_id"), "image_id", "left_anti").withColumn("error", F.lit("unknown image"))


@query("select count(*) as lines, count(*) filter (user_id % 17 = 0) as torn, count(*) filter (user_id % 17 <> 0) as good from events")
def torn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON, some cut off; those that don't parse are counted, not raised."""
    whole = F.to_json(F.struct("user_id", "event_type"))
    lines = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 17 == 0, F.substring(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole).alias("line"))
    good = F.from_json("line", "user_id long, event_type string, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNull()
    return lines.select(good.alias("g")).agg(F.count("*").alias("lines"), F.count_if(~F.col("g")).alias("torn"), F.count_if("g").alias("good"))


@query(f"{LABEL} select image_id, n, (x1 + x2) / 2.0 as cx, (y1 + y2) / 2.0 as cy, greatest(x2 - x1, y2 - y1) as long_side, case when y1 + y2 < 800 then 'top' else 'bottom' end || case when x1 + x2 < 800 then '_left' else '_right' end as quadrant from label")
def box_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.labels(spark, sf_dir).select("image_id", "n", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), G.long_side().alias("long_side"), G.quadrant().alias("quadrant"))


@query("select p_partkey as ask, case when p_size % 5 = 0 then 'not a region' when p_size >= p_partkey % 50 then 'x1 must be less than x2' end as error from part")
def region_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-dependent mistakes become a text beside the row, never an exception."""
    left, right = F.col("p_size"), F.col("p_partkey") % 50
    error = F.when(F.col("p_size") % 5 == 0, "not a region").when(left >= right, "x1 must be less than x2")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ask"), error.alias("error"))


@query(f"{LABEL} select image_id, n from label where x1 + x2 >= 400 and x1 + x2 < 1200 and y1 + y2 >= 300 and y1 + y2 < 900")
def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.labels(spark, sf_dir).where(G.inside(200, 150, 600, 450)).select("image_id", "n")


@query(f"{LABEL} select case when y1 + y2 < 800 then 'top' else 'bottom' end || case when x1 + x2 < 800 then '_left' else '_right' end as quadrant, count(*) as n from label group by 1")
def quadrant_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.labels(spark, sf_dir).groupBy(G.quadrant().alias("quadrant")).agg(F.count("*").alias("n"))


@query(f"{LABEL} select image_id, n from label where x1 <= 20 or y1 <= 20 or x2 >= 780 or y2 >= 780")
def edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.labels(spark, sf_dir).where(G.near_edge()).select("image_id", "n")


@query(f"{LABEL}{with_tools('pairs')} select image_id, na, nb, round(sqrt(cast(d4 as double)) / 2, 1) as distance_px from pairs")
def pair_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.pairs(E.labels(spark, sf_dir)).select("image_id", "na", "nb", G.distance(F.col("d4")).alias("distance_px"))


@query(f"{BOTH}{with_tools('facts')} select image_id, split, n_boxes from facts where split = 'test' and n_boxes between 2 and 15")
def image_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tools.facts(E.images(spark, sf_dir), E.labels(spark, sf_dir))
    return f.where((F.col("split") == "test") & F.col("n_boxes").between(2, 15)).select("image_id", "split", "n_boxes")


_BIN = "case when side <= 30 then 'small' when side <= 50 then 'mid' else 'large' end"


@query(f"{BOTH} select {_BIN} || '|' || scene as stratum, count(*) as n from (select *, greatest(x2 - x1, y2 - y1) as side from label) join images using (image_id) group by 1")
def size_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = E.labels(spark, sf_dir).join(E.images(spark, sf_dir).select("image_id", "scene"), "image_id")
    return joined.groupBy(F.concat_ws("|", G.size_bin(G.long_side()), "scene").alias("stratum")).agg(F.count("*").alias("n"))


@query(f"{with_entities('images')} select scene_group, n, inshore, cast(cast(0 < ratio as int) + cast(0.15 < ratio as int) + cast(0.4 < ratio as int) as int) as ratio_bin, case when n >= 100 then 'big' else 'small' end as size from (select scene_group, count(*) as n, count(*) filter (scene = 'inshore') as inshore, count(*) filter (scene = 'inshore') / count(*) as ratio from images group by scene_group)")
def group_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = E.images(spark, sf_dir).groupBy("scene_group").agg(F.count("*").alias("n"), F.count_if(F.col("scene") == "inshore").alias("inshore"))
    ratio = F.col("inshore") / F.col("n")
    return by.select("scene_group", "n", "inshore", sum((ratio > e).cast("int") for e in (0.0, 0.15, 0.4)).alias("ratio_bin"), F.when(F.col("n") >= 100, "big").otherwise("small").alias("size"))


@query(f"{BOTH} select image_id, count(n) as count, coalesce(string_agg('s' || n, ',' order by n), '') as ids from images left join (select * from label where x1 + x2 < 800 and y1 + y2 < 800) using (image_id) group by image_id")
def scan_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids stay those of the whole image; images without a box in the region have a count of 0."""
    b = E.labels(spark, sf_dir).where(G.quadrant() == G.QUADRANTS[0]).groupBy("image_id").agg(F.count("*").alias("count"), F.array_sort(F.collect_list("n")).alias("ns"))
    ids = F.array_join(F.transform("ns", lambda n: F.concat(F.lit("s"), n.cast("string"))), ",")
    return E.images(spark, sf_dir).select("image_id").join(b, "image_id", "left").select("image_id", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce(ids, F.lit("")).alias("ids"))


@query(f"{BOTH}{with_tools('facts')} select image_id, n_top_left, n_top_right, n_bottom_left, n_bottom_right, n_rect from facts")
def region_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.facts(E.images(spark, sf_dir), E.labels(spark, sf_dir)).select("image_id", *(f"n_{q}" for q in G.QUADRANTS), "n_rect")


@query(f"{LABEL} select image_id, string_agg(cast(greatest(x2 - x1, y2 - y1) as varchar), ',' order by n) as long_sides from label group by image_id")
def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = E.labels(spark, sf_dir).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("n", G.long_side().alias("s")))).alias("b"))
    return per.select("image_id", F.array_join(F.transform("b", lambda x: x["s"].cast("string")), ",").alias("long_sides"))


@query(f"{LABEL}{with_tools('nearest')} select image_id, 's' || na as ship_a, 's' || nb as ship_b, round(sqrt(cast(d4 as double)) / 2, 1) as distance_px from nearest")
def nearest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tools.nearest_pair(E.labels(spark, sf_dir))
    return p.select("image_id", F.concat(F.lit("s"), "na").alias("ship_a"), F.concat(F.lit("s"), "nb").alias("ship_b"), G.distance(F.col("d4")).alias("distance_px"))


@query(f"{LABEL}{with_tools('neighbours')} select image_id, n, other, round(sqrt(cast(d4 as double)) / 2, 1) as distance_px from neighbours")
def nearest_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.neighbours(E.labels(spark, sf_dir)).select("image_id", "n", "other", G.distance(F.col("d4")).alias("distance_px"))


@query(f"{BOTH}{with_tools('facts')} select image_id, n_edge from facts")
def edge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.facts(E.images(spark, sf_dir), E.labels(spark, sf_dir)).select("image_id", "n_edge")


@query(f"{with_entities('images')} select image_id, scene, 800 as width, 800 as height from images")
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.images(spark, sf_dir).select("image_id", "scene", F.lit(G.SIZE).alias("width"), F.lit(G.SIZE).alias("height"))


@query(f"with {tools.SQL['stats']} select vec_id, region, brightness from stats")
def brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.pixel_stats(table(spark, sf_dir, "embeddings")).select("vec_id", "region", "brightness")


@query(f"with {tools.SQL['stats']} select vec_id, region, noise from stats")
def background_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.pixel_stats(table(spark, sf_dir, "embeddings")).select("vec_id", "region", "noise")


@query(f"{BOTH}{with_tools('facts', 'nearest', 'stats')} select facts.image_id, scene, n_boxes, n_long, n_edge, max_side, d4, brightness_full, noise_full from facts left join nearest using (image_id) left join wide on vec_id = facts.image_id % (select count(*) from embeddings)")
def image_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = E.labels(spark, sf_dir)
    wide = tools.with_stats(tools.facts(E.images(spark, sf_dir), labels), table(spark, sf_dir, "embeddings"))
    return wide.join(tools.nearest_pair(labels).select("image_id", "d4"), "image_id", "left").select("image_id", "scene", "n_boxes", "n_long", "n_edge", "max_side", "d4", "brightness_full", "noise_full")


# The calculator: each operation over the long sides of every image, in the order of the boxes.

_LISTS = "select image_id, list(cast(greatest(x2 - x1, y2 - y1) as double) order by n) as xs from label group by image_id"


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = E.labels(spark, sf_dir).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("n", G.long_side().cast("double").alias("x")))).alias("b"))
    return per.select("image_id", F.transform("b", lambda s: s["x"]).alias("xs"))


_total = lambda: F.aggregate("xs", F.lit(0.0), lambda a, x: a + x)
_at = lambda x: F.array_position("xs", x).cast("int") - 1
_CALC = {
    "calc_count": (lambda: [F.size("xs").cast("long").alias("result")], "cast(len(xs) as bigint) as result"),
    "calc_sum": (lambda: [G.floor4(_total()).alias("result")], "floor(list_sum(xs) * 10000 + 0.5) / 10000.0 as result"),
    "calc_mean": (lambda: [G.floor4(_total() / F.size("xs")).alias("result")], "floor(list_sum(xs) / len(xs) * 10000 + 0.5) / 10000.0 as result"),
    "calc_max": (lambda: [F.array_max("xs").alias("result")], "list_max(xs) as result"),
    "calc_min": (lambda: [F.array_min("xs").alias("result")], "list_min(xs) as result"),
    "calc_sort": (lambda: [F.array_join(F.transform(F.sort_array("xs", False), lambda x: x.cast("int").cast("string")), ",").alias("result")], "list_aggregate([cast(cast(x as int) as varchar) for x in list_reverse_sort(xs)], 'string_agg', ',') as result"),
    "calc_filter": (lambda: [F.size(F.filter("xs", lambda x: x >= 40)).cast("long").alias("count"), _filtered()], "cast(len([x for x in xs if x >= 40]) as bigint) as count, coalesce(list_aggregate([cast(cast(x as int) as varchar) for x in xs if x >= 40], 'string_agg', ','), '') as result"),
    "calc_argmax": (lambda: [_at(F.array_max("xs")).alias("index"), F.array_max("xs").alias("value"), F.concat(F.lit("s"), _at(F.array_max("xs")) + 1).alias("label")], "cast(list_position(xs, list_max(xs)) - 1 as int) as index, list_max(xs) as value, 's' || list_position(xs, list_max(xs)) as label"),
    "calc_argmin": (lambda: [_at(F.array_min("xs")).alias("index"), F.array_min("xs").alias("value"), F.concat(F.lit("s"), _at(F.array_min("xs")) + 1).alias("label")], "cast(list_position(xs, list_min(xs)) - 1 as int) as index, list_min(xs) as value, 's' || list_position(xs, list_min(xs)) as label"),
    "calc_add": (lambda: [(F.array_max("xs") + F.array_min("xs")).alias("result")], "list_max(xs) + list_min(xs) as result"),
    "calc_sub": (lambda: [(F.array_max("xs") - F.array_min("xs")).alias("result")], "list_max(xs) - list_min(xs) as result"),
    "calc_mul": (lambda: [(F.array_max("xs") * F.array_min("xs")).alias("result")], "list_max(xs) * list_min(xs) as result"),
    "calc_div": (lambda: [G.floor4(F.try_divide(F.array_max("xs"), F.size("xs") - 1)).alias("result"), F.when(F.size("xs") == 1, "division by zero").alias("error")], "floor(list_max(xs) / nullif(len(xs) - 1, 0) * 10000 + 0.5) / 10000.0 as result, case when len(xs) = 1 then 'division by zero' end as error"),
    "calc_expr": (lambda: [G.floor4((F.array_max("xs") + 2 * F.array_min("xs")) / 3 + F.floor(F.array_max("xs") / 7) - (F.array_max("xs") - 7 * F.floor(F.array_max("xs") / 7))).alias("result")], "floor(((list_max(xs) + 2 * list_min(xs)) / 3 + floor(list_max(xs) / 7) - (list_max(xs) - 7 * floor(list_max(xs) / 7))) * 10000 + 0.5) / 10000.0 as result"),
}


def _filtered():
    return F.array_join(F.transform(F.filter("xs", lambda x: x >= 40), lambda x: x.cast("int").cast("string")), ",").alias("result")


for _name, (_columns, _sql) in _CALC.items():
    QUERIES[_name] = lambda spark, sf_dir, c=_columns: lists(spark, sf_dir).select("image_id", *c())
    ORACLE_SQL[_name] = f"{LABEL}, lists as ({_LISTS}) select image_id, {_sql} from lists"
