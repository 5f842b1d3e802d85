"""Samples by stratum against a plain share-out, with strata of all sizes and caps that don't fit; shares that add up."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit


def plain(sizes, cap, least):
    """What each stratum gives, told step by step."""
    if sum(sizes.values()) <= cap:
        return dict(sizes)
    order = sorted(sizes, key=lambda k: (-sizes[k], k))
    minimum = next((m for m in range(least, 0, -1) if sum(min(m, n) for n in sizes.values()) <= cap), 0)
    take = {k: min(minimum, sizes[k]) for k in order} if minimum else {k: int(i < cap and sizes[k] > 0) for i, k in enumerate(order)}
    spare, room = cap - sum(take.values()), {k: sizes[k] - take[k] for k in order}
    rooms = max(1, sum(room.values()))
    more = {k: divmod(spare * room[k], rooms) for k in order}
    left = spare - sum(whole for whole, _ in more.values())
    for i, k in enumerate(sorted(order, key=lambda k: -more[k][1])):
        take[k] += more[k][0] + (i < left)
    return take


CASES = [({"a": 100}, 10, 5), ({"a": 3, "b": 4}, 10, 5), ({"a": 1000, "b": 2, "c": 1, "d": 7}, 20, 5), ({c: 3 for c in "abcdefgh"}, 5, 5), ({c: i for i, c in enumerate("abcdefgh")}, 6, 5), ({"a": 9, "b": 9, "c": 9}, 10, 1), ({}, 10, 5), ({"a": 5, "b": 0}, 3, 2), ({"a": 5, "b": 5}, 0, 3)]
pick = random.Random(7)
CASES += [({f"s{i}": pick.choice([1, 2, 5, 30, 400]) for i in range(pick.randint(1, 40))}, pick.choice([1, 17, 60, 120]), pick.choice([1, 5, 9])) for _ in range(8)]


@pytest.mark.parametrize("sizes, cap, least", CASES)
def test_share_out(spark, sizes, cap, least):
    df = spark.createDataFrame(list(sizes.items()), "stratum string, n long")
    got = {r.stratum: r.take for r in audit.allotted(df, cap, least).collect()}
    assert got == plain(sizes, cap, least)
    assert sum(got.values()) == min(cap, sum(sizes.values())) and all(0 <= got[k] <= n for k, n in sizes.items())


def test_rows_with_a_stratum_that_holds_most(spark):
    rows = [(f"r{i}", "big" if i % 10 else f"small{i % 7}") for i in range(3000)] + [("x", None), ("y", "")]
    by = defaultdict(list)
    for key, stratum in rows:
        by[stratum].append(key)
    named = {k: v for k, v in by.items() if k is not None}
    got = defaultdict(set)
    for r in audit.sampled(spark.createDataFrame(rows, "key string, stratum string").where("stratum is not null"), "key", 50, 4).collect():
        got[r.stratum].add(r.key)
    take = plain({k: len(v) for k, v in named.items()}, 50, 4)
    for k, keys in named.items():
        assert got[k] == set(sorted(keys, key=lambda x: (hashlib.md5(x.encode()).hexdigest(), x))[: take[k]])


def test_shares_add_up(spark, sf_dir):
    rows = audit.decomposition(spark, sf_dir).collect()
    by = defaultdict(dict)
    for r in rows:
        by[r.cond, r.part][r.name] = r
    assert {c for c, _ in by} == set(audit.ASKED)
    for (cond, part), own in by.items():
        whole = own.pop("all")
        assert sum(r.runs for r in own.values()) == whole.runs, (cond, part)
        assert all(r.share_of_part is None for r in own.values()) if not whole.runs else abs(sum(r.share_of_part for r in own.values()) - 1) < 0.001
    assert by[1, "cause"]["miss"].runs == 0 and by[2, "cause"]["miss"].runs > 0
    wrong = audit.judged(spark, sf_dir).where(~F.col("correct")).count()
    assert sum(r.take for r in audit.audit_strata(spark, sf_dir).collect()) == min(audit.CAP, wrong) == audit.audit_sample(spark, sf_dir).count()


def test_disagreements(spark, sf_dir):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ids = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    order = sorted((i for i in labels if i in ids), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    rank = {i: n for n, i in enumerate(order, 1)}
    cells = Counter(labels[i] for i in order if labels[i][0] != labels[i][1])
    got = audit.disagreement_ranks(spark, sf_dir).collect()
    assert Counter((r.a, r.b) for r in got) == cells and all(rank[r.doc_id] == r.rank for r in got)
    for cell in cells:
        own = sorted((r for r in got if (r.a, r.b) == cell), key=lambda r: r.rank)
        assert [r.shown for r in own] == [i < audit.SHOWN for i in range(len(own))]
    codes = audit.disagreement_codes(spark, sf_dir).collect()
    for cell, n in cells.items():
        assert sum(r.code_n for r in codes if (r.a, r.b) == cell) == n
