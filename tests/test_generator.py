"""Question sets under joint caps against the rounds told plainly, with a group that holds most images and caps that can't all be met."""

import hashlib
import math
import random
from collections import Counter

import pytest

from tidemark.operators import generator as G


def made(seed, templates, images, answers, hot=0.5):
    pick = random.Random(seed)
    rows = []
    for image in range(images):
        group = 0 if pick.random() < hot else pick.randint(1, 6)
        for t in range(templates):
            if pick.random() < 0.8:
                value = pick.choice(answers)
                rows.append((f"t{t}", image, group, None if value == "none" else value, value == "0", hashlib.md5(f"t{t}|{image}".encode()).hexdigest()))
    return rows


def plain(rows, quotas, per_image):
    cap = {t: (q, same, zero) for t, q, same, zero in G.caps(quotas) if q}
    rows = [(*r[:3], r[3] or "", *r[4:]) for r in rows if r[0] in cap]
    groups = G.group_cap(quotas, len({r[2] for r in rows}))

    def left(taken, r):
        """What each cap that counts r has left."""
        t, image, group, balance, zero, _ = r
        quota, same, zeros = cap[t]
        out = {
            ("image", image): per_image - sum(x[1] == image for x in taken), ("group", group): groups - sum(x[2] == group for x in taken),
            ("same", t, balance): same - sum(x[0] == t and x[3] == balance for x in taken),
        }
        if zero:
            out["zero", t] = zeros - sum(x[0] == t and x[4] for x in taken)
        return out

    taken, number = {}, 0
    while True:
        number += 1
        free = [r for r in rows if r not in taken and all(v > 0 for v in left(taken, r).values())]
        asked = []
        for t, (quota, _, _) in cap.items():
            asked += sorted((r for r in free if r[0] == t), key=lambda r: (r[5], r[1]))[: quota - sum(x[0] == t for x in taken)]
        if not asked:
            return taken
        seen, passed = Counter(), []
        for r in sorted(asked, key=lambda r: (r[5], r[0], r[1])):
            room = left(taken, r)
            seen.update(room.keys())
            if all(seen[k] <= v for k, v in room.items()):
                passed.append(r)
        taken |= dict.fromkeys(passed, number)


CASES = [
    (1, 4, 60, ["0", "1", "2", "none"], {"t0": 10, "t1": 7, "t2": 2, "t3": 1}, 2),
    (2, 6, 25, ["0", "1"], dict.fromkeys((f"t{i}" for i in range(6)), 12), 2),
    (3, 5, 200, ["0"], dict.fromkeys((f"t{i}" for i in range(5)), 20), 1),
    (4, 3, 8, list("abcdef"), {"t0": 30, "t1": 0, "t2": 5, "t9": 4}, 3),
]


@pytest.mark.parametrize("seed, templates, images, answers, quotas, per_image", CASES)
def test_rounds(spark, seed, templates, images, answers, quotas, per_image):
    rows = made(seed, templates, images, answers)
    want = plain(rows, quotas, per_image)
    got = G.assign(spark.createDataFrame(rows, G.CANDIDATE), quotas, per_image).collect()
    assert {(r.template, r.image_id): r.round for r in got} == {r[:2]: n for r, n in want.items()}
    taken = [(r.template, r.image_id, r.scene_group, r.balance, r.zero) for r in got]
    groups = G.group_cap(quotas, len({r[2] for r in rows if quotas.get(r[0])}))
    assert max(Counter(r[1] for r in taken).values()) <= per_image and max(Counter(r[2] for r in taken).values()) <= groups
    for t, quota, same, zeros in G.caps(quotas):
        own = [r for r in taken if r[0] == t]
        assert len(own) <= quota and sum(r[4] for r in own) <= zeros and max(Counter(r[3] for r in own).values(), default=0) <= same


def test_no_candidates_and_columns_that_stay(spark):
    rows = made(5, 2, 10, ["1", "2", "3"])
    table = spark.createDataFrame(rows, G.CANDIDATE)
    assert G.assign(table.limit(0), {"t0": 3}).collect() == []
    assert G.assign(table, {}).collect() == []
    more = G.assign(table.withColumn("used", table.image_id).withColumnRenamed("used", "note"), {"t0": 3})
    assert "note" in more.columns and all(r.note == r.image_id for r in more.collect()) and more.count() == 3


def test_caps_are_the_shares():
    assert G.caps({"a": 14, "b": 2, "c": 5}) == [("a", 14, 7, 3), ("b", 2, 2, 1), ("c", 5, 3, 1)]
    assert G.group_cap({"a": 14, "b": 9}, 25) == math.ceil(3 * 23 / 25) and sum(G.QUOTAS.values()) == 360


def test_the_set_keeps_its_caps(spark, sf_dir):
    told = {r.what: (r.found, r.cap) for r in G.generation_caps(spark, sf_dir).collect()}
    assert all(found <= cap for found, cap in told.values()) and told["questions"][0] > 300
    report = G.generation_report(spark, sf_dir).collect()
    assert len(report) == 23 and all(r.n + r.short == r.quota and r.zeros <= r.zero_cap and r.most_equal <= r.same_cap for r in report)
    qids = [r.qid for r in G.generated_set(spark, sf_dir).collect()]
    assert len(set(qids)) == len(qids) == told["questions"][0] and "T-L1-001" in qids
