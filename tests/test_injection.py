"""Calibration and injection on images made by hand and against a plain version."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions.shared import cut
from tidemark.operators import calibration, injection, matching, runs

BOX = "image_id long, n int, x1 int, y1 int, x2 int, y2 int, scene string"


def chance(*key):
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16)


def iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def at(v):
    return min(max(math.floor(v + 0.5), 0), 800)


def around(cx, cy, w, h):
    return at(cx - w / 2), at(cy - h / 2), at(cx + w / 2), at(cy + h / 2)


def errors(boxes, labels):
    """(missed, false, poor) of greedy matching; boxes: (number, box)."""
    order = sorted((-iou(b, lab), n, i) for n, b in boxes for i, lab in labels.items() if iou(b, lab) >= 0.5)
    left, right, poor = set(), set(), 0
    for k, n, i in order:
        if n not in left and i not in right:
            left.add(n)
            right.add(i)
            poor += -k < 0.75
    return len(labels) - len(right), len(boxes) - len(left), poor


def plain(kind, image, labels, scene, rates, pools, size):
    """What one image gets: {n: (state, try, box)} of its attempt, tried in turn."""
    for attempt in range(10):
        out = {}
        if kind == "miss":
            for n, b in labels.items():
                out[n] = ("missed" if chance("miss", image, n, attempt) % 10**6 < rates[size(b), scene][0] else "kept", None, b)
            boxes, meant = [(n, b) for n, (state, _, b) in out.items() if state == "kept"], sum(state == "missed" for state, _, _ in out.values())
        elif kind == "fp":
            expected = sum(rates[size(b), scene][0] for b in labels.values())
            pool, there = pools[f"fp|{scene}"], list(labels.values())
            for slot in range(1, expected // 10**6 + (chance("fp", image, attempt) % 10**6 < expected % 10**6) + 1):
                out[-slot] = ("failed", None, None)
                for t in range(50):
                    w, h, _, _ = pool[chance("wh", image, slot, t, attempt) % len(pool)]
                    _, _, cx, cy = pool[chance("xy", image, slot, t, attempt) % len(pool)]
                    box = around(cx, cy, w, h)
                    if box[2] > box[0] and box[3] > box[1] and all(iou(box, b) <= 0.1 for b in there):
                        there.append(box)
                        out[-slot] = ("added", t, box)
                        break
            boxes, meant = list(labels.items()) + [(n, b) for n, (state, _, b) in out.items() if state == "added"], sum(state == "added" for state, _, _ in out.values())
        else:
            pool = pools["loc"]
            for n, b in labels.items():
                out[n] = ("kept", None, b)
                if b[2] > b[0] and b[3] > b[1] and chance("loc", image, n, attempt) % 10**6 < rates[size(b), scene][1]:
                    out[n] = ("failed", None, b)
                    for t in range(50):
                        dx, dy, lw, lh = pool[chance("shift", image, n, t, attempt) % len(pool)]
                        w, h = b[2] - b[0], b[3] - b[1]
                        box = around((b[0] + b[2]) / 2 + dx * w, (b[1] + b[3]) / 2 + dy * h, w * math.exp(lw), h * math.exp(lh))
                        if box[2] > box[0] and box[3] > box[1] and 0.5 <= iou(box, b) < 0.75:
                            out[n] = ("moved", t, box)
                            break
            boxes, meant = [(n, b) for n, (_, _, b) in out.items()], sum(state == "moved" for state, _, _ in out.values())
        shown = dict(zip(("miss", "fp", "loc"), errors(boxes, labels), strict=True))
        if all(v == (meant if k == kind else 0) for k, v in shown.items()):
            return attempt, out, True
    return attempt, out, False


def crowded():
    """Images with none to twenty boxes, some of them on each other or without an area."""
    rows = []
    for image in range(60):
        for n in range(1, image % 21 + 1):
            x, y = chance("x", image, n) % 300, chance("y", image, n) % 300
            w, h = 5 + chance("w", image, n) % 120, 5 + chance("h", image, n) % 120
            if image % 13 == 5 and n == 2:
                w = 0
            if image % 7 == 3 and n == 3:
                x, y, w, h = rows[-1][2], rows[-1][3], rows[-1][4] - rows[-1][2], rows[-1][5] - rows[-1][3]
            rows.append((image, n, x, y, min(800, x + w), min(800, y + h), ("inshore", "offshore")[image % 2]))
    return rows


@pytest.fixture(scope="module")
def made(spark):
    """Crowded labels and a calibration with an empty pool for offshore scenes, and what they come to."""
    rates = {(s, c): (200_000 + 150_000 * i, 350_000) for i, s in enumerate(calibration.SIZES) for c in calibration.SCENES}
    pools = {"loc": [(((i * 7) % 11 - 5) / 25, ((i * 5) % 9 - 4) / 25, ((i * 3) % 7 - 3) / 10, (i % 5 - 2) / 10) for i in range(40)]}
    pools["fp|inshore"] = [(30.0 + 7 * (i % 13), 40.0 + 5 * (i % 17), 20.0 * (i % 10), 17.5 * (i % 9)) for i in range(50)]
    tuples = [(p, i, *t) for p, own in pools.items() for i, t in enumerate(own)]
    pools["fp|offshore"] = pools["fp|inshore"]
    found = calibration.Calibration(
        33.5, 66.0,
        spark.createDataFrame([(s, c, m, loc) for (s, c), (m, loc) in rates.items()], "size string, scene string, miss int, loc int"),
        cut(spark.createDataFrame(tuples, calibration.POOL)), dict(Counter(p for p, *_ in tuples)),
    )
    rows, verdicts = injection.inject(spark.createDataFrame(crowded(), BOX), found)
    return rates, pools, rows.collect(), verdicts.collect()


@pytest.mark.parametrize("kind", injection.KINDS)
def test_against_plain(made, kind):
    rates, pools, rows, verdicts = made
    images = {}
    for image, n, *box, scene in crowded():
        images.setdefault((image, scene), {})[n] = tuple(box)
    size = lambda b: ("small", "mid", "large")[(max(b[2] - b[0], b[3] - b[1]) > 33.5) + (max(b[2] - b[0], b[3] - b[1]) > 66)]
    told = {v.image_id: v for v in verdicts if v.kind == kind}
    assert set(told) == {i for i, _ in images}
    again = failed = 0
    for (image, scene), labels in images.items():
        attempt, want, clean = plain(kind, image, labels, scene, rates, pools, size)
        got = {(-r.n if kind == "fp" else r.n): (r.state, getattr(r, "try"), None if r.x1 is None else (r.x1, r.y1, r.x2, r.y2)) for r in rows if r.kind == kind and r.image_id == image and not (kind == "fp" and r.state == "kept")}
        assert got == want and (told[image].attempt, told[image].clean) == (attempt, clean)
        assert told[image].failed == sum(state == "failed" for state, _, _ in want.values())
        again += attempt > 0
        failed += told[image].failed
    assert again if kind == "loc" else True
    assert failed if kind == "fp" else True


def test_added_boxes_keep_clear_of_all_others(made):
    _, _, rows, _ = made
    there = {}
    for r in rows:
        if r.kind == "fp" and r.x1 is not None:
            there.setdefault(r.image_id, []).append((r.state, (r.x1, r.y1, r.x2, r.y2)))
    pairs = [(a, b) for own in there.values() for i, (s, a) in enumerate(own) for t, b in own[:i] if "added" in (s, t)]
    assert pairs and all(iou(a, b) <= 0.1 for a, b in pairs)


def test_every_chosen_box_is_accounted_for(spark, sf_dir):
    found = calibration.calibrate(spark, sf_dir)
    sized = found.sized(injection.labelled(spark, sf_dir))
    from tidemark.functions import geometry as G

    chosen = sized.where(G.chance("loc", F.col("image_id"), F.col("n"), F.lit(0)) % 1_000_000 < F.col("loc")).groupBy("image_id").count()
    rows, verdicts = injection.injected(spark, sf_dir)
    first = verdicts.where("kind = 'loc' and attempt = 0").join(chosen, "image_id", "left").fillna(0)
    assert first.where("changed + failed <> count").count() == 0
    n = rows.groupBy("kind").agg(F.count_if(F.col("state") == "kept").alias("kept"), F.count("*").alias("n")).collect()
    assert len(n) == 3 and verdicts.groupBy("kind", "image_id").count().where("count > 1").count() == 0


def test_tuples_are_numbered_without_gaps(spark, sf_dir, monkeypatch):
    want = {(r.pool, r.idx): (r.a, r.b, r.c, r.d) for r in calibration.calibrate(spark, sf_dir).pools.collect()}
    monkeypatch.setattr(calibration, "RANGE", 7)
    found = calibration.calibrate(spark, sf_dir)
    assert {(r.pool, r.idx): (r.a, r.b, r.c, r.d) for r in found.pools.collect()} == want
    assert all(sorted(i for q, i in want if q == p) == list(range(n)) for p, n in found.sizes.items()) and len(found.sizes) == 3


def test_strata_fall_back(spark):
    judged = [("small", "inshore", None if i < 6 else 0.7 if i < 9 else 0.9) for i in range(30)] + [("small", "offshore", None)] + [("large", "inshore", 0.6)]
    rows = {(r["size"], r.scene): r for r in calibration.strata(spark, spark.createDataFrame(judged, "size string, scene string, iou double")).collect()}
    assert len(rows) == 6
    own, size, far = rows["small", "inshore"], rows["small", "offshore"], rows["mid", "inshore"]
    assert (own.miss, own.loc, own.miss_of) == (200_000, 125_000, "stratum")
    assert (size.miss, size.miss_of, size.loc_of) == (math.floor(7 / 31 * 10**6 + 0.5), "size", "size")
    assert (far.n_labels, far.miss, far.miss_of) == (0, math.floor(7 / 32 * 10**6 + 0.5), "all")


def test_nothing_to_calibrate_on(spark):
    none = spark.createDataFrame([], "size string, scene string, iou double")
    assert [(r.miss, r.loc, r.n_labels) for r in calibration.strata(spark, none).collect()] == [(0, 0, 0)] * 6
    found = calibration.Calibration(0.0, 0.0, calibration.strata(spark, none), cut(spark.createDataFrame([], calibration.POOL)), {})
    rows, verdicts = injection.inject(spark.createDataFrame(crowded()[:30], BOX), found)
    assert {r.state for r in rows.collect()} == {"kept"}
    rows, verdicts = injection.inject(spark.createDataFrame([], BOX), found)
    assert rows.collect() == verdicts.collect() == []


def test_conditions():
    assert [(c, m, i, r) for c, m, i, r, _ in runs.CONDITIONS] == [
        (1, "stepwise", "label", 0), (2, "stepwise", "detected", 0), (3, "stepwise", "label", 1), (4, "batch", "label", 0), (5, "batch", "detected", 0),
        *((6 + i, "stepwise", f"injected:{k}", 0) for i, k in enumerate(injection.KINDS)), *((9 + i, "stepwise", f"corrected:{k}", 0) for i, k in enumerate(injection.KINDS)),
    ]
    assert {p: [c for c, _, _, _, q in runs.CONDITIONS if q == p] for p in (1, 2, 3)} == {1: [1, 2, 6, 7, 8, 9, 10, 11], 2: [3], 3: [4, 5]}
    assert matching.GOOD == 0.75
