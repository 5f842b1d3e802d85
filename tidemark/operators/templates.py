"""The 23 question templates over all images at once, on the label or any other boxes.

Each gives image_id, answer (a number) or answer_cat (a name); null where the question has no answer for an image,
as for a pair where there are fewer than two boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import spatial, tools
from tidemark.sources import entities as E
from tidemark.sources.entities import table, with_entities
from tidemark.operators.tools import with_tools

Q = G.QUADRANTS
#: Fixed parameters of the branching templates: boxes, boxes in the first quadrant, noise.
BRANCH_BOXES, BRANCH_QUADRANT, BRANCH_NOISE = 4, 2, 30.0
WIDTH = G.SIZE


def _boxes(spark, sf_dir, source):
    """The boxes of a source by its name, or given boxes: image_id, n, corners."""
    return source if isinstance(source, DataFrame) else E.boxes(spark, sf_dir, source)


def _facts(spark, sf_dir, source="label"):
    return tools.facts(E.images(spark, sf_dir), _boxes(spark, sf_dir, source))


def _with_pair(spark, sf_dir, source="label"):
    near = tools.nearest_pair(_boxes(spark, sf_dir, source)).select("image_id", G.distance(F.col("d4")).alias("pair_px"))
    return _facts(spark, sf_dir, source).join(near, "image_id", "left")


def _with_stats(spark, sf_dir, source="label"):
    return tools.with_stats(_facts(spark, sf_dir, source), table(spark, sf_dir, "embeddings"))


def number(column):
    return F.col("image_id"), (F.col(column) if isinstance(column, str) else column).cast("double").alias("answer")


def name(column):
    return F.col("image_id"), (F.col(column) if isinstance(column, str) else column).alias("answer_cat")


def _of_quadrant(prefix, which):
    out = None
    for q in Q:
        out = F.when(which == q, F.col(f"{prefix}_{q}")) if out is None else out.when(which == q, F.col(f"{prefix}_{q}"))
    return out


def _largest(prefix):
    return tools.first_largest([(f"{prefix}_{q}", q) for q in Q])


def _at_largest(prefix, by):
    """The column of the quadrant whose `by` is largest, the first of equal ones; told without its name, which every use would tell anew."""
    return tools.first_largest([(f"{by}_{q}", F.col(f"{prefix}_{q}")) for q in Q])


def _simple(build, columns):
    def run(spark: SparkSession, sf_dir: str, source: str = "label") -> DataFrame:
        return build(spark, sf_dir, source).select(*columns())

    run.columns = columns
    return run


def wide(spark: SparkSession, sf_dir: str, source: str = "label") -> DataFrame:
    """One row an image with all that any template asks for, so that all 23 answers are projections of one plan."""
    f = _with_stats(spark, sf_dir, source)
    boxes = _boxes(spark, sf_dir, source)
    near = tools.nearest_pair(boxes).select("image_id", F.col("d4").alias("pair_d4"))
    ends = f.where("n_boxes > 0").select("image_id", F.col("longest").alias("pick"), "shortest")
    far = spatial.from_box(boxes, ends.select("image_id", "pick")).join(ends, "image_id").groupBy("image_id").agg(
        F.min("d4").alias("neighbour_d4"), F.min(F.when(F.col("n") == F.col("shortest"), F.col("d4"))).alias("ends_d4")
    )
    near = near.join(far, "image_id", "full_outer")
    px = {f"{c}_px": G.distance(F.col(f"{c}_d4")) for c in ("pair", "neighbour", "ends")}
    return f.join(near, "image_id", "left").withColumns(px)


def longest_neighbour(spark, sf_dir, source="label"):
    f = _facts(spark, sf_dir, source)
    near = spatial.from_box(_boxes(spark, sf_dir, source), f.select("image_id", F.col("longest").alias("pick"))).groupBy("image_id").agg(F.min("d4").alias("d4"))
    return f.join(near, "image_id", "left").select(*number(G.distance(F.col("d4"))))


def longest_shortest(spark, sf_dir, source="label"):
    f = _facts(spark, sf_dir, source)
    far = spatial.from_box(_boxes(spark, sf_dir, source), f.select("image_id", F.col("longest").alias("pick"))).withColumnRenamed("n", "shortest")
    return f.join(far, ["image_id", "shortest"], "left").select(*number(G.distance(F.col("d4"))))


longest_neighbour.columns = lambda: number("neighbour_px")
longest_shortest.columns = lambda: number("ends_px")

_IMAGE_QUADRANT = lambda: F.element_at(F.array(*(F.lit(q) for q in Q)), (F.col("image_id") % 4 + 1).cast("int"))
_NOISY = lambda: _largest("noise")

TEMPLATES = {
    "l1_total_count": _simple(_facts, lambda: number("n_boxes")),
    "l1_quadrant_count": _simple(_facts, lambda: number(_of_quadrant("n", _IMAGE_QUADRANT()))),
    "l1_edge_count": _simple(_facts, lambda: number("n_edge")),
    "l1_rect_count": _simple(_facts, lambda: number("n_rect")),
    "l1_scene": _simple(lambda spark, sf_dir, _: E.images(spark, sf_dir), lambda: name("scene")),
    "l1_brightness": _simple(lambda spark, sf_dir, _: tools.with_stats(E.images(spark, sf_dir), table(spark, sf_dir, "embeddings")), lambda: number("brightness_full")),
    "l2_nearest_ratio": _simple(_with_pair, lambda: number(G.floor4(F.col("pair_px") / WIDTH * 100))),
    "l2_longest_length": _simple(_facts, lambda: number("max_side")),
    "l2_count_over_length": _simple(_facts, lambda: number("n_long")),
    "l2_longest_neighbor": longest_neighbour,
    "l2_longest_shortest_distance": longest_shortest,
    "l3_quadrant_most_ships": _simple(_facts, lambda: name(_largest("n"))),
    "l3_empty_quadrants": _simple(_facts, lambda: number(sum((F.col(f"n_{q}") == 0).cast("int") for q in Q))),
    "l3_quadrant_most_long": _simple(_facts, lambda: name(_largest("long"))),
    "l3_quadrant_brightest": _simple(_with_stats, lambda: name(_largest("brightness"))),
    "l3_quadrant_noisiest": _simple(_with_stats, lambda: name(_largest("noise"))),
    "l4_scene_branch": _simple(_with_pair, lambda: number(F.when(F.col("scene") == "inshore", F.col("pair_px")).otherwise(F.col("max_side").cast("double")))),
    "l4_count_branch": _simple(_with_pair, lambda: number(F.when(F.col("n_boxes") >= BRANCH_BOXES, F.col("pair_px")).otherwise(F.col("max_side").cast("double")))),
    "l4_quadrant_branch": _simple(_with_pair, lambda: number(F.when(F.col(f"n_{Q[0]}") >= BRANCH_QUADRANT, F.col(f"max_{Q[0]}").cast("double")).otherwise(F.col("pair_px")))),
    "l4_maxlen_branch": _simple(_facts, lambda: number(F.when(F.col("max_side") >= 55, F.col("n_long")).when(F.col("max_side").isNotNull(), F.col("n_boxes")))),
    "l4_noise_branch": _simple(_with_stats, lambda: number(F.when(F.col("noise_full") > BRANCH_NOISE, F.col("n_boxes")).when(F.col("noise_full").isNotNull(), F.col("n_edge")))),
    "l5_noisy_quadrant": _simple(_with_stats, lambda: number(F.when(_at_largest("n", "noise") >= 2, _at_largest("long", "noise")).otherwise(_at_largest("n", "noise")))),
    "l5_scene_quadrant": _simple(_with_stats, lambda: number(F.when(F.col("scene") == "inshore", _at_largest("n", "noise")).otherwise(_at_largest("n", "n")))),
}


def _sql(entities, more, select, joins=""):
    return f"{with_entities(*entities)}{with_tools(*more)}\nselect facts.image_id, {select} from facts {joins}"


def _num(expr):
    return f"cast({expr} as double) as answer"


def _pick(prefix, which):
    return "case " + " ".join(f"when {which} = '{q}' then {prefix}_{q}" for q in Q) + " end"


def _most(prefix):
    cols = [f"{prefix}_{q}" for q in Q]
    return "case " + " ".join(f"when {c} = greatest({', '.join(cols)}) then '{q}'" for c, q in zip(cols, Q, strict=True)) + " end"


_BASE = (("images", "label"), ("facts",))
_PAIR = (("images", "label"), ("facts", "nearest"))
_PX = "round(sqrt(cast(d4 as double)) / 2, 1)"
_STATS = (("images", "label"), ("facts", "stats"))
_JOIN = "left join wide on wide.vec_id = facts.image_id % (select count(*) from embeddings)"
_NEAR = "left join nearest using (image_id)"

ORACLE_SQL = {
    "l1_total_count": _sql(*_BASE, _num("n_boxes")),
    "l1_quadrant_count": _sql(*_BASE, _num(_pick("n", "['top_left', 'top_right', 'bottom_left', 'bottom_right'][image_id % 4 + 1]"))),
    "l1_edge_count": _sql(*_BASE, _num("n_edge")),
    "l1_rect_count": _sql(*_BASE, _num("n_rect")),
    "l1_scene": f"{with_entities('images')} select image_id, scene as answer_cat from images",
    "l1_brightness": _sql(*_STATS, _num("brightness_full"), _JOIN),
    "l2_nearest_ratio": _sql(*_PAIR, _num(f"floor({_PX} / 800 * 100 * 10000 + 0.5) / 10000.0"), _NEAR),
    "l2_longest_length": _sql(*_BASE, _num("max_side")),
    "l2_count_over_length": _sql(*_BASE, _num("n_long")),
    "l2_longest_neighbor": _sql(("images", "label"), ("facts", "neighbours"), _num(_PX), "left join neighbours on neighbours.image_id = facts.image_id and n = longest"),
    "l2_longest_shortest_distance": _sql(("images", "label"), ("facts", "pairs"), _num(_PX), "left join pairs on pairs.image_id = facts.image_id and na = least(longest, shortest) and nb = greatest(longest, shortest)"),
    "l3_quadrant_most_ships": _sql(*_BASE, f"{_most('n')} as answer_cat"),
    "l3_empty_quadrants": _sql(*_BASE, _num(" + ".join(f"cast(n_{q} = 0 as int)" for q in Q))),
    "l3_quadrant_most_long": _sql(*_BASE, f"{_most('long')} as answer_cat"),
    "l3_quadrant_brightest": _sql(*_STATS, f"{_most('brightness')} as answer_cat", _JOIN),
    "l3_quadrant_noisiest": _sql(*_STATS, f"{_most('noise')} as answer_cat", _JOIN),
    "l4_scene_branch": _sql(*_PAIR, _num(f"case when scene = 'inshore' then {_PX} else max_side end"), _NEAR),
    "l4_count_branch": _sql(*_PAIR, _num(f"case when n_boxes >= {BRANCH_BOXES} then {_PX} else max_side end"), _NEAR),
    "l4_quadrant_branch": _sql(*_PAIR, _num(f"case when n_top_left >= {BRANCH_QUADRANT} then max_top_left else {_PX} end"), _NEAR),
    "l4_maxlen_branch": _sql(*_BASE, _num("case when max_side >= 55 then n_long when max_side is not null then n_boxes end")),
    "l4_noise_branch": _sql(*_STATS, _num(f"case when noise_full > {BRANCH_NOISE} then n_boxes when noise_full is not null then n_edge end"), _JOIN),
    "l5_noisy_quadrant": _sql(*_STATS, _num(f"case when {_pick('n', f'({_most("noise")})')} >= 2 then {_pick('long', f'({_most("noise")})')} else {_pick('n', f'({_most("noise")})')} end"), _JOIN),
    "l5_scene_quadrant": _sql(*_STATS, _num(f"case when scene = 'inshore' then {_pick('n', f'({_most("noise")})')} else {_pick('n', f'({_most("n")})')} end"), _JOIN),
}
