"""Near duplicates as classes and links against all pairs of rows, with a third of the rows in one class."""

import random

import pytest

from tidemark.operators import data_prep

ROW = "vec_id long, b long, split string, scene_group int"


def made(seed, n=600):
    pick = random.Random(seed)
    base = [pick.getrandbits(60) for _ in range(40)] + [0, (1 << 60) - 1, (1 << 12) - 1, (1 << 11) - 1]
    rows = []
    for i in range(n):
        b = base[0] if i % 3 == 0 else pick.choice(base)
        for _ in range(pick.choice([0, 0, 0, 1, 2, 3, 5])):
            b ^= 1 << pick.randrange(60)
        rows.append((1000 - i, b, pick.choice(["test", "dev", "train"]), pick.choice([1, 2, 3, None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = made(seed)
    members, links = data_prep.near_classes(spark.createDataFrame(rows, ROW))
    able = [r for r in rows if 12 <= r[1].bit_count() <= 52]
    head, near, want = {}, {r[0]: 0 for r in able}, {}
    for v, b, *_ in able:
        head[b] = min(v, head.get(b, v))
    for i, x in enumerate(able):
        for y in able[:i]:
            distance = (x[1] ^ y[1]).bit_count()
            if distance <= 4 and x[2] != y[2] and None not in (x[3], y[3]) and x[3] != y[3]:
                near[x[0]] += 1
                near[y[0]] += 1
                key = (*sorted((head[x[1]], head[y[1]])), distance)
                want[key] = want.get(key, 0) + 1
    assert {(r.class_a, r.class_b, r.distance): r.n_pairs for r in links.collect()} == want
    assert {r.vec_id: (r["class"], r.n_near) for r in members.collect()} == {r[0]: (head[r[1]], near[r[0]]) for r in able}
    assert len(want) > 20 and len(able) < len(rows)


def test_copies_make_no_pairs(spark):
    """Ten thousand copies in two splits are one class with one link to itself."""
    df = spark.range(10_000).selectExpr("id as vec_id", "cast(1048575 as long) as b", "if(id % 2 = 0, 'test', 'dev') as split", "cast(id % 2 as int) as scene_group")
    members, links = data_prep.near_classes(df)
    assert [tuple(r) for r in links.collect()] == [(0, 0, 0, 25_000_000)]
    assert members.where("class = 0 and n_near = 5000").count() == 10_000


def test_nothing(spark):
    members, links = data_prep.near_classes(spark.createDataFrame([], ROW))
    assert members.collect() == links.collect() == []
