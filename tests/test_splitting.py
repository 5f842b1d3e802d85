"""Deals of groups by stratum against the same told plainly."""

import hashlib
import math
import random

import pytest

from tidemark.operators import splitting as S

IMAGE = "scene_group int, scene string"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain(images, seeds):
    own = {}
    for g, scene in images:
        n, i = own.get(g, (0, 0))
        own[g] = n + 1, i + (scene == "inshore")
    middle = sorted(n for n, _ in own.values())[len(own) // 2]
    stratum = {g: f"ins{sum(i / n > e for e in S.EDGES)}_{'big' if n > middle else 'small'}" for g, (n, i) in own.items()}
    want = S.targets(len(own))
    deck = [k for _, k in sorted(((i + 0.5) / c, k) for k, c in want.items() for i in range(c))]
    all_n, all_i, best = sum(n for n, _ in own.values()), sum(i for _, i in own.values()), None
    for seed in range(seeds):
        order = sorted(own, key=lambda g: (stratum[g], md5(f"{seed}|{g}"), g))
        shift = int(md5(f"shift|{seed}")[:8], 16) % len(own)
        dealt = {g: deck[(p + shift) % len(own)] for p, g in enumerate(order)}
        gap = 0
        for s in set(dealt.values()):
            of = [own[g] for g in own if dealt[g] == s]
            n, i = sum(x for x, _ in of), sum(x for _, x in of)
            gap += math.floor(((n / all_n - len(of) / len(own)) ** 2 + (i / n - all_i / all_n) ** 2) * 1e12 + 0.5)
        score = math.floor(gap / 1000 + 0.5) / 1e9
        if best is None or score < best[0]:
            best = score, seed, dealt
    return stratum, best


@pytest.mark.parametrize("many, seeds", [(40, 60), (7, 20), (1, 3)])
def test_against_plain(spark, many, seeds):
    pick = random.Random(many)
    images = [(g, pick.choice(["inshore"] * (g % 4) + ["offshore"] * 3)) for g in range(many) for _ in range(pick.randint(1, 40))]
    stratum, (score, seed, dealt) = plain(images, seeds)
    got = S.best(S.deal(S.groups(spark.createDataFrame(images, IMAGE)), seeds)).collect()
    assert {r.seed for r in got} == {seed} and {r.scene_group: (r.stratum, r.split) for r in got} == {g: (stratum[g], dealt[g]) for g in dealt}
    assert abs(min(r.score for r in S.scores(S.deal(S.groups(spark.createDataFrame(images, IMAGE)), seeds)).collect()) - score) < 2e-9


def test_targets():
    assert S.targets(92) == {"det_train": 60, "det_val": 9, "dev": 7, "test": 16} and all(sum(S.targets(n).values()) == n for n in range(200))
    assert S.SEEDS == 1000


def test_no_groups(spark):
    assert S.best(S.deal(S.groups(spark.createDataFrame([], IMAGE)), 5)).collect() == []
