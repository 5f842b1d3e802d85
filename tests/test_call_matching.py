"""Calls matched by key and by shape, against the same told over lists."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import call_matching as M

REGIONAL = ("count", "sizes", "nearest_pair", "edge")


def number(x):
    return str(int(x)) if float(x) == int(x) else str(float(x))


def key(tool, args, shape=False):
    def read(name):
        v = (args or {}).get(name)
        if shape and isinstance(v, str) and v.startswith("$"):
            return "ref:" + (v[1:].split(".", 1)[1] if "." in v else "")
        return v

    region = read("region")
    region = "full" if region is None else "[" + ",".join(map(number, region)) + "]" if isinstance(region, list) else region
    if tool == "spatial_query":
        return (tool, read("query"), region if read("query") in REGIONAL else None, None if read("ship_a") is None else str(read("ship_a")), None if read("ship_b") is None else str(read("ship_b")))
    return (tool, region) if tool in ("detect_ships", "image_stats") else (tool,)


def plain(expected, calls):
    """{plan: (steps left, turns left)} of one question."""
    out = {}
    for plan in sorted({e[0] for e in expected}):
        e = sorted((x for x in expected if x[0] == plan and x[2] != "calc"), key=lambda x: x[1])
        c = sorted(x for x in calls if x[1] != "calc")
        for shape in (False, True):
            ek, ck = {}, {}
            for x in e:
                ek.setdefault(key(x[2], x[4] if shape else x[3], shape), []).append(x)
            for x in c:
                if not shape or x[2] is None:
                    ck.setdefault(key(x[1], x[3] if shape or x[2] is None else x[2], shape), []).append(x)
            met = {k: min(len(v), len(ck.get(k, []))) for k, v in ek.items()}
            gone_e, gone_c = [x for k, n in met.items() for x in ek[k][:n]], [x for k, n in met.items() for x in ck.get(k, [])[:n]]
            e, c = [x for x in e if x not in gone_e], [x for x in c if x not in gone_c]
        out[plan] = e, c
    return out


def told(e, c, has_answer, final_turn):
    out, e, c = [], list(e), list(c)
    for x in list(c):
        hit = next((y for y in e if y[2] == x[1]), None)
        if hit:
            e.remove(hit)
            c.remove(x)
            out.append((2, x[0], "wrong_args", hit[1]))
    for x in list(c):
        if e:
            out.append((2, x[0], "wrong_tool", e.pop(0)[1]))
            c.remove(x)
    out += [(2, x[0], "extra_call", None) for x in c]
    if has_answer:
        out += [(4, final_turn, "loop_omission", y[1]) if y[5] else (2, final_turn, "missing_call", y[1]) for y in e]
    return sorted(out, key=str)


def made(seed, questions=120):
    pick = random.Random(seed)
    refs = ["$c1.longest.id", "$c3.longest.id", "$c1.ships.2.id", "$c2", "$c2.ships.3.id"]

    def one():
        tool = pick.choice(["spatial_query"] * 4 + ["detect_ships", "image_stats", "get_metadata", "calc"])
        args = {"query": pick.choice(["count", "sizes", "distance", "edge"])} if tool == "spatial_query" else {}
        if pick.random() < 0.6:
            args["region"] = pick.choice(["full", "top_left", [1, 2, 3, 4], [1.0, 2.0, 3, 4], [0.5, 1, 2, 3]])
        raw = dict(args)
        if args.get("query") == "distance":
            for end in ("ship_a", "ship_b"):
                args[end], raw[end] = pick.randint(1, 3), pick.choice(refs)
        return tool, args, raw

    expected, calls = {}, {}
    for q in range(questions):
        steps = [(plan, s, *one(), pick.random() < 0.4) for plan in range(pick.randint(1, 3)) for s in range(1, pick.randint(1, 7))]
        own = []
        for plan, _, tool, args, raw, _ in steps:
            if plan == 0 and pick.random() < 0.8:
                lost = pick.random() < 0.3
                own.append((tool, None if lost else args, {k: pick.choice(refs) if lost and str(v).startswith("$") and pick.random() < 0.3 else v for k, v in raw.items()}))
            if pick.random() < 0.15:
                own.append(one())
        pick.shuffle(own)
        expected[q], calls[q] = steps, [(t, *x) for t, x in enumerate(own, 1)]
    return expected, calls


@pytest.mark.parametrize("seed", [1, 2])
def test_against_lists(spark, seed):
    expected, calls = made(seed)
    text = lambda x: None if x is None else json.dumps(x)
    e = spark.createDataFrame([(q, p, s, t, text(a), text(r), loop) for q, own in expected.items() for p, s, t, a, r, loop in own], M.EXPECTED)
    c = spark.createDataFrame([(q, n, t, text(a), text(r)) for q, own in calls.items() for n, t, a, r in own], M.CALLS)
    left = M.leftovers(e, c)
    got = {}
    for r in left.collect():
        got.setdefault((r.qid, r.plan), set()).add((r.step, r.turn))
    best = {r.qid: (r.plan, r.n_left) for r in M.closest(e, left).collect()}
    picked = left.join(M.closest(e, left).select("qid", "plan"), ["qid", "plan"], "left_semi")
    answered = c.select("qid").distinct().select("qid", (F.col("qid") % 3 != 0).alias("has_answer"), F.lit(50).alias("final_turn"))
    devs = {}
    for r in M.deviations(picked, answered).collect():
        devs.setdefault(r.qid, []).append((r.stage, r.turn, r.kind, r.step))
    kinds = Counter()
    for q, own in expected.items():
        want = plain(own, calls[q])
        for plan, (es, cs) in want.items():
            assert got.get((q, plan), set()) == {(x[1], None) for x in es} | {(None, x[0]) for x in cs}, (q, plan)
        if not want:
            continue
        n, plan = min((len(es) + len(cs), plan) for plan, (es, cs) in want.items())
        assert best[q] == (plan, n)
        wanted = told(*want[plan], bool(q % 3) and bool(calls[q]), 50)
        assert sorted(devs.get(q, []), key=str) == wanted, q
        kinds.update(k for _, _, k, _ in wanted)
    assert set(kinds) == {"wrong_args", "wrong_tool", "extra_call", "missing_call", "loop_omission"}


def test_a_lost_reference_is_no_error_of_its_call(spark):
    e = spark.createDataFrame([(1, 0, 1, "spatial_query", '{"query": "distance", "ship_a": 1, "ship_b": 2}', '{"query": "distance", "ship_a": "$c1.longest.id", "ship_b": "$c1.ships.1.id"}', True)], M.EXPECTED)
    raw = '{"query": "distance", "ship_a": "$c9.longest.id", "ship_b": "$c9.ships.%d.id"}'
    same = spark.createDataFrame([(1, 1, "spatial_query", None, raw % 1)], M.CALLS)
    assert M.leftovers(e, same).collect() == []
    other = spark.createDataFrame([(1, 1, "spatial_query", None, raw % 2)], M.CALLS)
    assert M.leftovers(e, other).count() == 2


def test_nothing(spark):
    e, c = spark.createDataFrame([], M.EXPECTED), spark.createDataFrame([], M.CALLS)
    left = M.leftovers(e, c)
    assert left.collect() == [] and M.closest(e, left).collect() == []
    odd = spark.createDataFrame([(1, 1, "spatial_query", "{oops", None), (1, 2, "unheard_of", None, None)], M.CALLS)
    some = spark.createDataFrame([(1, 0, 1, "detect_ships", None, None, False)], M.EXPECTED)
    assert {(r.step, r.turn) for r in M.leftovers(some, odd).collect()} == {(1, None), (None, 1), (None, 2)}
