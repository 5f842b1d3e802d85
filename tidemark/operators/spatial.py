"""Nearest boxes and overlapping boxes by a grid, so that an image with very many boxes is many units of work.

Overlaps: a box meets the boxes of its image's other side, unless these are more than CROWD; so its work is bounded, and both sides
stay where a window by image has put them. In a crowded image a box lies in all cells of CELL pixels that it covers; two boxes
meet in each cell that both cover, and their pair counts only in the cell of their overlap's first corner.

Nearest: centres are merged first, so equal ones never meet. An image's m different centres lie in a grid of g by g cells over
their extent, g so small that there are fewer cells than centres: two of them share a cell then, the closest pair is no farther
apart than a cell's diagonal, and looking two cells in every direction finds it. For each box's nearest other one, boxes look
one cell around them; what they find is nearest if it is no farther than a cell is wide, and if not they look again in a grid
of half as many cells a side, down to the whole image. Most images have so few boxes that their grid is one cell from the start.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions.shared import cut

#: Side of a cell for overlaps; centres a cell that the grid for nearest ones is laid out for; boxes that one box meets without a grid.
CELL, PER_CELL, CROWD = 100, 8, 64


def _celled(boxes: DataFrame) -> DataFrame:
    """boxes once for each cell (gx, gy) that they cover."""
    span = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}1") / CELL), F.floor((F.col(f"{c}2") - 1) / CELL))).alias(f"g{c}")
    return boxes.select("*", span("x")).select("*", span("y"))


def overlaps(left: DataFrame, right: DataFrame, threshold: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """image_id, keep, d, l, iou of the boxes n of both sides that overlap by the threshold (over 0); boxes: image_id, n, corners, whole numbers.

    keep: columns of the left side that are handed on. Boxes without an area overlap none.
    """
    wide = "x2 > x1 and y2 > y1"
    a = left.where(wide).select("image_id", *keep, "n", "x1", "y1", "x2", "y2")
    b = right.where(wide).select("image_id", "n", "x1", "y1", "x2", "y2")
    crowded = cut(b.groupBy("image_id").agg(F.count("*").alias("m")).where(F.col("m") > CROWD).select("image_id"))
    image = F.col("a.image_id") == F.col("b.image_id")

    def found(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
        both = a.alias("a").join(b.alias("b"), on)
        return both.select("a.image_id", *(f"a.{c}" for c in keep), F.col("a.n").alias("d"), F.col("b.n").alias("l"), G.iou("a", "b").alias("iou")).where(F.col("iou") >= threshold)

    if crowded.isEmpty():
        return found(a, b, image)
    few, many = (lambda df: df.join(crowded, "image_id", "left_anti")), (lambda df: _celled(df.join(crowded, "image_id", "left_semi")))
    first = lambda c: F.floor(F.greatest(F.col(f"a.{c}1"), F.col(f"b.{c}1")) / CELL) == F.col(f"a.g{c}")
    cell = image & (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy"))
    return found(few(a), few(b), image).unionByName(found(many(a), many(b), cell & first("x") & first("y")))


def _centres(boxes: DataFrame) -> DataFrame:
    """image_id, n, px, py (twice the centre), head (the smallest n of the centre) and twin (the second)."""
    b = boxes.select("image_id", "n", (F.col("x1") + F.col("x2")).alias("px"), (F.col("y1") + F.col("y2")).alias("py"))
    own = W.partitionBy("image_id", "px", "py")
    b = b.withColumn("head", F.min("n").over(own))
    return b.withColumn("twin", F.min(F.when(F.col("n") != F.col("head"), F.col("n"))).over(own))


def _laid_out(centres: DataFrame) -> DataFrame:
    """One row a centre with its image's grid: left, top, extent and g, the cells a side."""
    by = W.partitionBy("image_id")
    one = centres.where("n = head").withColumns({"left": F.min("px").over(by), "top": F.min("py").over(by), "m": F.count("*").over(by)})
    one = one.withColumn("extent", F.greatest(F.max("px").over(by) - F.col("left"), F.max("py").over(by) - F.col("top")) + 1)
    return one.withColumn("g", F.greatest(F.floor(F.sqrt(F.col("m") / PER_CELL)).cast("long"), F.lit(1).cast("long"))).drop("m")


def _cell(p: Column, low: Column, g: Column) -> Column:
    return F.floor((p - low) * g / F.col("extent"))


def _around(rows: DataFrame, reach: int) -> DataFrame:
    """rows once for each cell (gx, gy) within reach of their own, inside the grid; a grid of one cell has one."""
    near = lambda p, low, name: F.explode(F.sequence(F.greatest(_cell(F.col(p), F.col(low), F.col("g")) - reach, F.lit(0)), F.least(_cell(F.col(p), F.col(low), F.col("g")) + reach, F.col("g") - 1))).alias(name)
    return rows.select("*", near("px", "left", "gx")).select("*", near("py", "top", "gy"))


def _within(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"gx": _cell(F.col("px"), F.col("left"), F.col("g")), "gy": _cell(F.col("py"), F.col("top"), F.col("g"))})


def _d4(a: str, b: str) -> Column:
    dx, dy = F.col(f"{a}.px") - F.col(f"{b}.px"), F.col(f"{a}.py") - F.col(f"{b}.py")
    return (dx * dx + dy * dy).cast("long")


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.alias("a").join(b.alias("b"), (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy")))


def nearest_pair(boxes: DataFrame) -> DataFrame:
    """image_id, na, nb, d4: the closest pair, ties by the boxes' numbers; images of fewer than two boxes have none."""
    centres = _centres(boxes)
    twins = centres.where("n = head and twin is not null").select("image_id", F.struct(F.lit(0).cast("long").alias("d4"), F.col("n").alias("na"), F.col("twin").alias("nb")).alias("p"))
    one = _laid_out(centres)
    both = _met(_within(one), _around(one, 2)).where("a.n < b.n")
    pairs = both.select(F.col("a.image_id"), F.struct(_d4("a", "b").alias("d4"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).alias("p"))
    return twins.unionByName(pairs).groupBy("image_id").agg(F.min("p").alias("p")).select("image_id", "p.na", "p.nb", "p.d4")


def neighbours(boxes: DataFrame) -> DataFrame:
    """image_id, n, other, d4: each box's nearest other box in the image, ties by the smaller number; a box alone has none."""
    centres = cut(_centres(boxes))
    found = centres.where("twin is not null").select("image_id", "n", F.when(F.col("n") == F.col("head"), F.col("twin")).otherwise(F.col("head")).alias("other"), F.lit(0).cast("long").alias("d4"))
    one = cut(_laid_out(centres))
    parts, todo = [found], one.where("twin is null")
    while True:
        # the grid is the image's, so both sides halve alike
        targets = _around(one.join(todo.select("image_id", F.col("g").alias("now")).distinct(), "image_id").withColumn("g", F.col("now")).drop("now"), 1)
        best = _met(_within(todo), targets).where("a.n <> b.n").groupBy(F.col("a.image_id"), F.col("a.n")).agg(F.min(F.struct(_d4("a", "b").alias("d4"), F.col("b.n").alias("other"))).alias("best"))
        seen = cut(todo.join(best, ["image_id", "n"], "left"))
        sure = (F.col("g") == 1) | F.coalesce(F.col("best.d4") * F.col("g") * F.col("g") <= F.col("extent") * F.col("extent"), F.lit(False))
        parts.append(seen.where(sure & F.col("best").isNotNull()).select("image_id", "n", "best.other", "best.d4"))
        todo = seen.where(~sure).drop("best").withColumn("g", F.greatest(F.floor(F.col("g") / 2).cast("long"), F.lit(1).cast("long")))
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, parts)


def from_box(boxes: DataFrame, picks: DataFrame) -> DataFrame:
    """image_id, n, d4 of all other boxes to the one that picks (image_id, pick) names: as many rows as boxes, never pairs."""
    named = boxes.join(picks, "image_id").where(F.col("n") == F.col("pick")).select("image_id", "pick", F.struct("x1", "y1", "x2", "y2").alias("a"))
    b = boxes.select("image_id", "n", F.struct("x1", "y1", "x2", "y2").alias("b")).join(named, "image_id").where(F.col("n") != F.col("pick"))
    return b.select("image_id", "n", G.d4("a", "b").alias("d4"))
