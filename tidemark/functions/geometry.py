"""Column expressions for boxes on a square canvas; all coordinates are integers, so comparisons are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canvas side, middle, edge distance, quadrant names.
SIZE, HALF, NEAR = 800, 400, 20
QUADRANTS = ("top_left", "top_right", "bottom_left", "bottom_right")


def clamp(v: Column) -> Column:
    """Half-up rounding, then the canvas."""
    return F.least(F.greatest(F.floor(v + F.lit(0.5)), F.lit(0)), F.lit(SIZE)).cast("int")


def long_side(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    return F.greatest(F.col(x2) - F.col(x1), F.col(y2) - F.col(y1))


def quadrant(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    """By the box's centre; the middle belongs to the right and the bottom."""
    left, top = F.col(x1) + F.col(x2) < SIZE, F.col(y1) + F.col(y2) < SIZE
    return F.when(top & left, QUADRANTS[0]).when(top, QUADRANTS[1]).when(left, QUADRANTS[2]).otherwise(QUADRANTS[3])


def inside(left, top, right, bottom) -> Column:
    """Centre in the half-open rectangle."""
    cx, cy = F.col("x1") + F.col("x2"), F.col("y1") + F.col("y2")
    return (cx >= 2 * left) & (cx < 2 * right) & (cy >= 2 * top) & (cy < 2 * bottom)


def near_edge() -> Column:
    return (F.col("x1") <= NEAR) | (F.col("y1") <= NEAR) | (F.col("x2") >= SIZE - NEAR) | (F.col("y2") >= SIZE - NEAR)


def d4(a: str, b: str) -> Column:
    """Four times the squared distance of two boxes' centres, a whole number."""
    dx = F.col(f"{a}.x1") + F.col(f"{a}.x2") - F.col(f"{b}.x1") - F.col(f"{b}.x2")
    dy = F.col(f"{a}.y1") + F.col(f"{a}.y2") - F.col(f"{b}.y1") - F.col(f"{b}.y2")
    return (dx * dx + dy * dy).cast("long")


def distance(d: Column) -> Column:
    return F.round(F.sqrt(d.cast("double")) / 2, 1)


def _overlap(a, b) -> Column:
    """Overlap over union of two boxes given as functions from a corner's name to its column, null-free: 0 for an empty union."""
    w = F.greatest(F.least(a("x2"), b("x2")) - F.greatest(a("x1"), b("x1")), F.lit(0))
    h = F.greatest(F.least(a("y2"), b("y2")) - F.greatest(a("y1"), b("y1")), F.lit(0))
    area = lambda t: (t("x2") - t("x1")) * (t("y2") - t("y1"))
    inter = (w * h).cast("long")
    union = (area(a) + area(b)).cast("long") - inter
    return F.when(union > 0, inter.cast("double") / union).otherwise(F.lit(0.0))


def iou(a: str, b: str) -> Column:
    return _overlap(lambda c: F.col(f"{a}.{c}"), lambda c: F.col(f"{b}.{c}"))


def iou_of(a: Column, b: Column) -> Column:
    """The same of two boxes that are structs, as in arrays."""
    return _overlap(lambda c: a[c], lambda c: b[c])


def size_bin(side: Column, low: int = 30, high: int = 50) -> Column:
    return F.when(side <= low, "small").when(side <= high, "mid").otherwise("large")


def floor2(v: Column) -> Column:
    """Two decimals by half-up on the value itself, the same in every engine; for values of 0 or more."""
    return F.floor(v * 100 + 0.5) / 100.0


def floor4(v: Column) -> Column:
    return F.floor(v * 10000 + 0.5) / 10000.0


def uniform(*key) -> Column:
    """A number from 0 to 999 that depends on the key alone."""
    text = F.concat_ws("|", *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long") % 1000).cast("int")


def chance(*key) -> Column:
    """A whole number under 2**32 that depends on the key alone."""
    text = F.concat_ws("|", *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
