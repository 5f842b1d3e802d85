"""Drawn slots against draws told plainly from the boxes, margins by hand, and a question set made of them under its caps."""

import hashlib
import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.operators import generator, samplers
from tidemark.operators import templates as T
from tidemark.sources import entities as E

Q = samplers.Q


def least(what, image, choices):
    return min(choices, key=lambda c: (hashlib.md5(f"{what}|{image}|{c}".encode()).hexdigest(), c), default=None)


def clear(sides):
    return [t for t in range(15, 151, 5) if all(abs(v - t) > max(2, t / 10) for v in sides)]


def test_margins_by_hand(spark):
    rows = [(1, [20, 40]), (2, [15, 17, 18]), (3, []), (4, [100])]
    df = spark.createDataFrame(rows, "image_id long, sides array<int>")
    got = {r.image_id: r.t for r in df.select("image_id", samplers.clear_lengths(F.col("sides")).alias("t")).collect()}
    assert got == {i: clear(s) for i, s in rows} and 20 not in got[1] and 25 in got[1] and 110 not in got[4] and 90 in got[4] and 95 not in got[4] and 115 in got[4] and len(got[3]) == 28
    counts = spark.range(8).select("id", samplers.clear_counts(F.col("id"), (2, 6)).alias("k")).collect()
    assert {r.id: r.k for r in counts} == {n: [k for k in range(2, 7) if abs(n - k) >= 2] for n in range(8)}


def test_ties_leads_and_picks(spark):
    df = spark.createDataFrame([(1, [3, 3, 1], 10.0, 9.7), (2, [3, 1, 1], 10.0, 9.8), (3, [], None, 1.0), (4, None, 0.0, 0.0)], "image_id long, v array<int>, a double, b double")
    df = df.withColumns({f"noise_{q}": F.col("a") if i == 0 else F.col("b") if i == 1 else F.lit(0.0) for i, q in enumerate(Q)})
    one = df.select("image_id", samplers.single(F.col("v"), F.array_max).alias("top"), samplers.single(F.col("v"), F.array_min).alias("low"), samplers.leads("noise").alias("lead"), samplers.pick("p", F.col("v")).alias("p")).collect()
    got = {r.image_id: r for r in one}
    assert [got[i].top for i in (1, 2, 3)] == [False, True, False] and [got[i].low for i in (1, 2)] == [True, False]
    assert [got[i].lead for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert got[1].p == least("p", 1, {3, 1}) and got[2].p == least("p", 2, {3, 1}) and got[3].p is None and got[4].p is None


def test_draws_told_plainly(spark, sf_dir):
    boxes = defaultdict(list)
    for r in E.labels(spark, sf_dir).collect():
        boxes[r.image_id].append((r.x1, r.y1, r.x2, r.y2))
    facts = {r.image_id: r for r in T.wide(spark, sf_dir).collect()}
    got = {(r.image_id, r.template): r for r in samplers.draws(spark, sf_dir).collect()}
    eligible = {i for i, b in boxes.items() if 2 <= len(b) <= 15}
    assert set(got) == {(i, t) for i in eligible for t in T.TEMPLATES}
    quadrant = lambda b: Q[(b[0] + b[2] >= 800) + 2 * (b[1] + b[3] >= 800)]
    long = lambda b: max(b[2] - b[0], b[3] - b[1])
    seen = Counter()
    for i in eligible:
        own, f = boxes[i], facts[i]
        sides, n = [long(b) for b in own], len(own)
        per = {q: [long(b) for b in own if quadrant(b) == q] for q in Q}
        one = lambda t, i=i: got[i, t]
        r = one("l1_quadrant_count")
        assert r.region == least("l1_quadrant_count", i, Q) and r.num == len(per[r.region])
        r = one("l1_rect_count")
        assert 250 <= r.x2 - r.x1 <= 450 and 0 <= r.x1 and r.x2 <= 800 and r.y2 <= 800 and r.x1 % 50 == r.y2 % 50 == 0
        assert r.num == sum(2 * r.x1 <= b[0] + b[2] < 2 * r.x2 and 2 * r.y1 <= b[1] + b[3] < 2 * r.y2 for b in own)
        r = one("l2_count_over_length")
        assert r.threshold == least("l2_count_over_length", i, [t for t in clear(sides) if 0 < sum(v >= t for v in sides) < n])
        assert (r.reason, r.num) == ((samplers.NO_CHOICE, None) if r.threshold is None else (None, sum(v >= r.threshold for v in sides)))
        r = one("l3_quadrant_most_long")
        t = least("l3_quadrant_most_long", i, clear(sides))
        over = Counter({q: sum(v >= t for v in per[q]) for q in Q}).most_common(2) if t else None
        assert r.threshold == t and (r.reason is None) == bool(t and over[0][1] > over[1][1])
        assert r.cat == (over[0][0] if r.reason is None else None)
        r = one("l4_count_branch")
        assert r.threshold == least("l4_count_branch", i, [k for k in range(3, 13) if abs(k - n) >= 2]) and r.took == (n > r.threshold)
        assert r.num == (f.pair_px if r.took else max(sides))
        r = one("l4_quadrant_branch")
        count = len(per[r.region])
        assert r.threshold == least("l4_quadrant_branch", i, [k for k in range(2, 7) if abs(k - count) >= 2])
        assert r.num == (max(per[r.region]) if count >= r.threshold else f.pair_px)
        r = one("l4_noise_branch")
        if f.noise_full:
            choices = {u: math.floor(f.noise_full * s * 2 + 0.5) / 2 for u, s in enumerate(samplers.FACTORS)}
            ok = [u for u, t in choices.items() if t > 0 and abs(f.noise_full - t) * 10 > t]
            assert r.threshold == choices.get(least("l4_noise_branch", i, ok)) and abs(r.threshold - f.noise_full) > 0.1 * r.threshold
            assert r.num == (n if f.noise_full > r.threshold else f.n_edge)
        r = one("l5_noisy_quadrant")
        if r.reason is None:
            noisy = max(Q, key=lambda q: getattr(f, f"noise_{q}"))
            assert abs(len(per[noisy]) - r.count_threshold) >= 2 and r.threshold in clear(sides)
            assert r.num == (sum(v >= r.threshold for v in per[noisy]) if len(per[noisy]) >= r.count_threshold else len(per[noisy]))
        pair, ends = one("l2_nearest_ratio"), one("l2_longest_shortest_distance")
        assert (pair.reason is None) == (n >= 3)
        assert ends.reason == (samplers.FEW if n < 3 else samplers.LONGEST if sides.count(max(sides)) > 1 else samplers.SHORTEST if sides.count(min(sides)) > 1 else None)
        seen.update((t, got[i, t].reason) for t in T.TEMPLATES)
    told = {(r.template, None if r.reason == "asked" else r.reason): r.n for r in samplers.slot_report(spark, sf_dir).collect()}
    assert told == dict(seen) and {r for _, r in told} >= {None, samplers.FEW, samplers.LONGEST, samplers.FULLEST, samplers.NEAR}


def test_a_set_of_drawn_questions_keeps_its_caps(spark, sf_dir):
    found = samplers.candidates(spark, sf_dir)
    quotas = {t: 5 for t in T.TEMPLATES}
    rows = generator.assign(found, quotas).collect()
    assert max(Counter(r.image_id for r in rows).values()) <= generator.PER_IMAGE and all(n <= 5 for n in Counter(r.template for r in rows).values())
    assert max(Counter((r.template, r.balance) for r in rows).values()) <= 3 and all(r.reason is None for r in rows) and len(rows) > 90
    assert sum(r.threshold is not None for r in rows) > 20


def test_no_images(spark, sf_dir):
    wide, labels = T.wide(spark, sf_dir), E.labels(spark, sf_dir)
    none = samplers.told(samplers.drawn(samplers.drawable(wide, labels.where("false"))))
    assert none.collect() == [] and set(samplers.SLOTS) <= set(none.columns)
