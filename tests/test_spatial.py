"""Grid joins and matching by rounds against all pairs of crowded images."""

import random

import pytest

from tidemark.operators import matching, spatial

BOX = "image_id long, n int, x1 int, y1 int, x2 int, y2 int"


def boxes(seed, sizes, canvas=800, most=60):
    """Images of the given numbers of boxes: spread out, in one spot, on each other, off the canvas, without an area."""
    pick, rows = random.Random(seed), []
    for image, many in enumerate(sizes):
        for n in range(1, many + 1):
            kind = image % 4
            x, y = (pick.randint(0, canvas), pick.randint(0, canvas)) if kind < 2 or n % 5 == 0 else (300 + pick.randint(0, 40), 300 + pick.randint(0, 40))
            if kind == 3 and n % 3 == 0:
                x, y = x - 900, y + 2000
            w, h = (0, 5) if n % 11 == 7 else (pick.randint(1, most), pick.randint(1, most))
            if kind == 1 and n % 4 == 0 and rows and rows[-1][0] == image:
                x, y, w, h = rows[-1][2], rows[-1][3], rows[-1][4] - rows[-1][2], rows[-1][5] - rows[-1][3]
            rows.append((image, n, x, y, x + w, y + h))
    return rows


SIZES = [0, 1, 2, 3, 40, 90, 150, 31, 260, 300, 280, 33]


def d4(a, b):
    return (a[2] + a[4] - b[2] - b[4]) ** 2 + (a[3] + a[5] - b[3] - b[5]) ** 2


def iou(a, b):
    w, h = max(0, min(a[4], b[4]) - max(a[2], b[2])), max(0, min(a[5], b[5]) - max(a[3], b[3]))
    union = (a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w * h
    return w * h / union if union > 0 else 0.0


@pytest.mark.parametrize("per_cell", [8, 1])
def test_nearest(spark, monkeypatch, per_cell):
    monkeypatch.setattr(spatial, "PER_CELL", per_cell)
    rows = boxes(per_cell, SIZES)
    df = spark.createDataFrame(rows, BOX)
    pair, other = {}, {}
    for image in range(len(SIZES)):
        own = [r for r in rows if r[0] == image]
        found = [(d4(a, b), a[1], b[1]) for i, a in enumerate(own) for b in own[i + 1 :]]
        if found:
            pair[image] = min(found)
        for a in own:
            if len(own) > 1:
                other[image, a[1]] = min((d4(a, b), b[1]) for b in own if b is not a)
    assert {r.image_id: (r.d4, r.na, r.nb) for r in spatial.nearest_pair(df).collect()} == pair
    assert {(r.image_id, r.n): (r.d4, r.other) for r in spatial.neighbours(df).collect()} == other
    assert spatial.neighbours(df).count() == len(other)


def test_far_neighbours_look_again(spark):
    """Two crowds with one box far from both: it and the crowds' rims look through grids of fewer and fewer cells."""
    pick = random.Random(3)
    rows = [(1, n, x, y, x + 2, y + 2) for n in range(1, 401) for x, y in [(pick.randint(0, 60) + (700 if n % 2 else 0), pick.randint(0, 60))]] + [(1, 401, 350, 790, 352, 792)]
    got = {r.n: (r.d4, r.other) for r in spatial.neighbours(spark.createDataFrame(rows, BOX)).collect()}
    assert got == {a[1]: min((d4(a, b), b[1]) for b in rows if b is not a) for a in rows}


def test_from_one_box(spark):
    rows = boxes(4, [5, 0, 3])
    picks = spark.createDataFrame([(0, 2), (2, 9), (7, 1)], "image_id long, pick int")
    got = {(r.image_id, r.n): r.d4 for r in spatial.from_box(spark.createDataFrame(rows, BOX), picks).collect()}
    a = next(r for r in rows if r[:2] == (0, 2))
    assert got == {(0, b[1]): d4(a, b) for b in rows if b[0] == 0 and b[1] != 2}


@pytest.mark.parametrize("threshold", [0.5, 0.01])
def test_overlaps(spark, threshold):
    left, right = boxes(5, SIZES, most=250), boxes(6, SIZES[::-1], most=90)
    left += [(1, 50 + i, *r[2:]) for i, r in enumerate(r for r in right if r[0] == 1)]
    got = sorted((r.image_id, r.d, r.l, round(r.iou, 12)) for r in matching.candidates(spark.createDataFrame(left, BOX), spark.createDataFrame(right, BOX), threshold).collect())
    want = sorted((a[0], a[1], b[1], round(iou(a, b), 12)) for a in left for b in right if a[0] == b[0] and iou(a, b) >= threshold)
    assert got == want and len(want) > 50


def taken(pairs):
    out, d, left = [], set(), set()
    for image, x, y, v in sorted(pairs, key=lambda p: (p[0], -p[3], p[1], p[2])):
        if (image, x) not in d and (image, y) not in left:
            d.add((image, x))
            left.add((image, y))
            out.append((image, x, y, v))
    return sorted(out)


PAIR = "image_id long, d int, l int, iou double"


def test_rounds_give_the_pairs_of_the_fold(spark, monkeypatch):
    pick = random.Random(8)
    pairs = list({(i, pick.randint(1, 25), pick.randint(1, 25)): (pick.randint(50, 60) / 100) for i in range(30) for _ in range(20 * (i % 8))}.items())
    pairs = [(*k, v) for k, v in pairs]
    # overlaps that fall along a chain
    pairs += [(99, n // 2, (n + 1) // 2, 0.9 - n / 1000) for n in range(2, 40)]
    df, want = spark.createDataFrame(pairs, PAIR), taken(pairs)
    for fold in (256, 60, 0):
        monkeypatch.setattr(matching, "FOLD", fold)
        assert sorted(map(tuple, matching.greedy(df).collect())) == want


def test_an_image_of_a_hundred_thousand_pairs(spark):
    pick = random.Random(9)
    pairs = list({(1, pick.randint(1, 20_000), pick.randint(1, 20_000)) for _ in range(100_000)})
    pairs = [(*p, pick.random()) for p in pairs] + [(2, 1, 1, 0.5), (2, 1, 2, 0.5)]
    assert sorted(map(tuple, matching.greedy(spark.createDataFrame(pairs, PAIR)).collect())) == taken(pairs)


def test_other_orders(spark, monkeypatch):
    """Detections by their score, each with its best free label."""
    from pyspark.sql import functions as F

    pick = random.Random(10)
    pairs = [(1, d, lab, pick.randint(50, 99) / 100) for d in range(1, 30) for lab in range(1, 12) if pick.random() < 0.4]
    score = {d: pick.randint(1, 5) for d in range(1, 30)}
    df = spark.createDataFrame([(*p, score[p[1]]) for p in pairs], PAIR + ", score int")
    used_d, used_l, want = set(), set(), []
    for _, d, lab, v in sorted(pairs, key=lambda p: (-score[p[1]], p[1], -p[3], p[2])):
        if d not in used_d and lab not in used_l:
            used_d.add(d)
            used_l.add(lab)
            want.append((1, d, lab, v))
    order = F.struct((-F.col("score")).alias("s"), "d", (-F.col("iou")).alias("k"), "l")
    for fold in (256, 0):
        monkeypatch.setattr(matching, "FOLD", fold)
        assert sorted(map(tuple, matching.greedy(df, order).collect())) == sorted(want)


def test_nothing(spark):
    none = spark.createDataFrame([], BOX)
    assert spatial.nearest_pair(none).collect() == spatial.neighbours(none).collect() == matching.candidates(none, none).collect() == []
    assert matching.greedy(spark.createDataFrame([], PAIR)).collect() == []
