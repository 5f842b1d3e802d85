"""Summed areas against sums over the pixels themselves, on images of several sizes made by hand."""

import math
import random

import numpy as np

from tidemark.operators import rectangles as R
from tidemark.operators import tools
from tidemark.sources.entities import table

PIXEL = "vec_id long, row int, col int, p int, masked boolean"
ASK = "ask int, vec_id long, x1 double, y1 double, x2 double, y2 double"


def image(vec_id, values, masks=()):
    free = np.ones(values.shape, bool)
    for x1, y1, x2, y2 in masks:
        free[y1:y2, x1:x2] = False
    rows = [(vec_id, r, c, int(values[r, c]), not free[r, c]) for r in range(len(values)) for c in range(len(values[0]))]
    return rows, free


def two(v):
    return math.floor(v * 100 + 0.5) / 100


def told(spark, pixels, asks, size):
    found = R.rectangle_stats(spark.createDataFrame(asks, ASK), R.summed_areas(spark.createDataFrame(pixels, PIXEL)), ["ask"], size)
    return {r.ask: (r.brightness, r.noise, r.error) for r in found.collect()}


def test_by_hand(spark):
    values = np.full((80, 80), 50)
    values[10:12, 10:13] = 200
    pixels, _ = image(1, values, [(10, 10, 13, 12)])
    checker = np.where(np.indices((80, 80)).sum(axis=0) % 2, 60, 40)
    pixels += image(2, checker)[0]
    asks = [(0, 1, 0.0, 0.0, 80.0, 80.0), (1, 1, 10.0, 10.0, 13.0, 12.0), (2, 1, -50.0, -50.0, 5.0, 5.0), (3, 1, 90.0, 90.0, 95.0, 95.0), (4, 2, 0.0, 0.0, 40.0, 40.0), (5, 9, 0.0, 0.0, 4.0, 4.0)]
    asks += [(6, 1, 9.5, 9.5, 13.4, 12.49), (7, 1, None, 0.0, 4.0, 4.0), (8, 1, 5.0, 5.0, 5.0, 9.0), (9, 1, 4.6, 4.0, 5.4, 5.0)]
    got = told(spark, pixels, asks, 80)
    assert got[0] == (two(50 + 150 * 6 / 6400), 0.0, None)
    assert got[1] == got[6] == (200.0, None, None)
    assert got[2] == (50.0, 0.0, None) and got[4] == (50.0, 10.0, None)
    assert got[3] == (None, None, R.EMPTY) and got[5] == (None, None, R.UNKNOWN) and got[7] == (None, None, R.NO_REGION) and got[8] == (None, None, R.NO_ORDER) and got[9] == (None, None, R.EMPTY)


def test_against_slices(spark):
    pick = random.Random(4)
    chance = np.random.default_rng(4)
    pixels, images = [], {}
    for vec_id, shape in enumerate([(1, 1), (7, 13), (30, 30), (30, 5)]):
        values = chance.integers(0, 256, shape)
        rows, free = image(vec_id, values, [(2, 1, 5, 6)])
        pixels += rows
        images[vec_id] = values, free
    asks = []
    for ask in range(200):
        x, y = sorted(pick.uniform(-5, 35) for _ in range(2)), sorted(pick.uniform(-5, 35) for _ in range(2))
        asks.append((ask, ask % 4, x[0], y[0], x[1], y[1]))
    pick.shuffle(pixels)
    got = told(spark, pixels, asks, 30)
    at = lambda v: min(max(math.floor(v + 0.5), 0), 30)
    answered = 0
    for ask, vec_id, x1, y1, x2, y2 in asks:
        values, free = images[vec_id]
        part, clear = values[at(y1) : at(y2), at(x1) : at(x2)], free[at(y1) : at(y2), at(x1) : at(x2)]
        # a rectangle that leaves a smaller image on the right or below has only what is there, as its corner isn't
        if values.shape == (30, 30):
            answered += 1
            if not part.size:
                assert got[ask] == (None, None, R.EMPTY)
            else:
                assert got[ask][2] is None and abs(got[ask][0] - part.mean()) < 0.0051
                assert got[ask][1] is None if not clear.any() else abs(got[ask][1] - part[clear].std()) < 0.0051
    assert answered == 50


def test_quadrants_are_the_fixed_ones(spark, sf_dir):
    areas = R.summed_area(spark, sf_dir)
    want = {(r.vec_id, r.region): (r.brightness, r.noise) for r in tools.pixel_stats(table(spark, sf_dir, "embeddings")).collect()}
    from pyspark.sql import functions as F

    asks = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.array(*map(F.lit, R._NAMES[:-1]))).alias("region"))
    asks = asks.withColumn("box", R.region(F.col("region"), tools.SIDE)).select("vec_id", "region", "box.*").withColumn("ask", F.struct("vec_id", "region"))
    got = {(r.ask.vec_id, r.ask.region): (r.brightness, r.noise) for r in R.rectangle_stats(asks, areas, ["ask"], tools.SIDE).collect()}
    assert got == want


def test_nothing(spark):
    assert told(spark, [], [(1, 1, 0.0, 0.0, 2.0, 2.0)], 8) == {1: (None, None, R.UNKNOWN)}
    assert told(spark, image(1, np.ones((2, 2)))[0], [], 8) == {}
