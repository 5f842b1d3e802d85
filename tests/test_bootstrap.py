"""The bootstrap against a plain resampling of questions, draw by draw."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import bootstrap
from tidemark.operators import intervals, statistics

SUMS = "stat int, scene_group int, num double, den double"


def pick(b, j, g):
    return int(hashlib.md5(f"{b}|{j}".encode()).hexdigest()[:8], 16) % g


def plain(rows, replicates):
    """rows: (group, values of each statistic or None where it isn't asked)."""
    groups = sorted({g for g, _ in rows}, key=lambda g: (g is not None, g))
    out = {}
    for s in range(len(rows[0][1])):
        own = [[v[s] for g, v in rows if g == k and v[s] is not None] for k in groups]
        everything = [x for part in own for x in part]
        if not everything:
            out[s] = (None, None, None)
            continue
        found = []
        for b in range(replicates):
            drawn = [x for j in range(len(groups)) for x in own[pick(b, j, len(groups))]]
            if drawn:
                found.append(sum(drawn) / len(drawn))
        out[s] = (sum(everything) / len(everything), *np.percentile(found, [2.5, 97.5]))
    return out


def test_against_resampled_questions(spark):
    chance = np.random.default_rng(2)
    rows = []
    for i in range(400):
        group = None if i % 37 == 0 else int(chance.integers(0, 7)) if i % 2 else 3
        x, y = int(chance.integers(0, 2)), int(chance.integers(0, 2))
        # of all, a paired difference, one that few groups are asked, one that nobody is
        rows.append((group, (x, x - y, y if group == 5 else None, None)))
    sums = {}
    for g, values in rows:
        for s, v in enumerate(values):
            num, den = sums.get((s, g), (0.0, 0.0))
            sums[s, g] = (num + (v or 0), den + (v is not None))
    table = spark.createDataFrame([(s, g, *v) for (s, g), v in sums.items()], SUMS)
    got = {r.stat: (r.value, r.low, r.high) for r in bootstrap.intervals(table, replicates=700).collect()}
    for s, want in plain(rows, 700).items():
        assert want == got[s] if want[0] is None else np.allclose(want, got[s])


def test_statistics_share_their_draws(spark):
    """A difference that is nothing in every group is nothing in every replicate, whatever its parts do."""
    table = spark.createDataFrame([(s, g, float(v), 10.0) for g in range(9) for s, v in enumerate((g, g, 0))], SUMS)
    a, b, nothing = (r for r in bootstrap.intervals(table, replicates=500).orderBy("stat").collect())
    assert (a.low, a.high) == (b.low, b.high) and a.low < a.value < a.high and (nothing.low, nothing.high) == (0.0, 0.0)


def test_counts_are_whole_resamples(spark):
    rows = bootstrap.counts(spark, 6, 50).collect()
    want = {}
    for b in range(50):
        for j in range(6):
            want[b, pick(b, j, 6)] = want.get((b, pick(b, j, 6)), 0) + 1
    assert {(r.b, r.k): r.m for r in rows} == want
    assert bootstrap.counts(spark, 0, 50).collect() == [] and bootstrap.REPLICATES == 10_000


def test_no_groups_and_one(spark):
    assert bootstrap.intervals(spark.createDataFrame([], SUMS), replicates=20).collect() == []
    one = bootstrap.intervals(spark.createDataFrame([(1, None, 3.0, 4.0)], SUMS), replicates=20).first()
    assert (one.value, one.low, one.high) == (0.75, 0.75, 0.75)


def test_tables_of_few_questions(spark):
    """Subsets without a question have a row with null values."""
    row = {f"{k}{c}": v for c in intervals.CONDITIONS for k, v in (("r", c % 2), ("w", False), ("a", "1|count"), ("e", False))}
    df = spark.createDataFrame([(f"q{i}", i, True, 1, 2, *row.values()) for i in range(4)], "qid string, scene_group int, box_dependent boolean, level int, gold_calls int, " + ", ".join(f"{k} {'int' if k[0] == 'r' else 'string' if k[0] == 'a' else 'boolean'}" for k in row))
    told = {(r.cond, r.subset): r for r in intervals.table(df, intervals.ACCURACY, "cond int, subset string").collect()}
    assert len(told) == 33 and (told[1, "all"].n, told[1, "all"].value, told[1, "all"].low) == (4, 1.0, 1.0)
    assert (told[1, "not_box_dependent"].n, told[1, "not_box_dependent"].value, told[1, "not_box_dependent"].high) == (0, None, None)


def test_kappa_draws_by_cells(spark, sf_dir, monkeypatch):
    """Places among the cells' running counts are places among the rows, in the order of their cells."""
    from tidemark.sources.entities import table

    monkeypatch.setattr(statistics, "DRAWS", 40)
    rows = sorted((r.quality, r.toxic) for r in table(spark, sf_dir, "labels").select("quality", "toxic").collect())
    g, found = len(rows), []
    for b in range(40):
        own = [rows[pick(b, j, g)] for j in range(g)]
        po, a, t = sum(x == y for x, y in own) / g, sum(x for x, _ in own) / g, sum(y for _, y in own) / g
        pe = a * t + (1 - a) * (1 - t)
        if pe != 1:
            found.append((po - pe) / (1 - pe))
    got = statistics.kappa_ci(spark, sf_dir).first()
    found.sort()
    assert got.used == len(found) and abs(got.low - found[1]) < 2e-6 and abs(got.high - found[39]) < 2e-6


def test_every_stage_reads_sums_alone(spark, sf_dir):
    """What is broadcast is as many rows as groups times statistics."""
    sums = intervals.sums(intervals.by_question(spark, sf_dir), intervals.ACCURACY)
    groups = sums.agg(F.countDistinct("scene_group")).first()[0]
    assert sums.count() == groups * len(intervals.ACCURACY)
