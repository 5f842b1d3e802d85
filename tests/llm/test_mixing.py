import random
import tempfile
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.llm.helpers import docs
from tidemark.llm import mixing


def simulate(parts, slots):
    """Earliest deadline first, slot by slot."""
    total, done, out = sum(parts.values()), Counter(), []
    for t in range(slots):
        ready = [(-(-(done[s] + 1) * total // n), s) for s, n in parts.items() if done[s] * total // n <= t]
        s = min(ready)[1]
        done[s] += 1
        out.append(s)
    return out


def test_period_is_earliest_deadline_first():
    r = random.Random(2)
    for _ in range(20):
        parts = mixing.shares({f"s{i}": r.random() for i in range(r.randrange(1, 9))}, 50)
        slots = mixing.period(parts)
        order = {t: s for s, own in slots.items() for t in own}
        assert [order[t % 50] for t in range(120)] == simulate(parts, 120)


def test_sources_keep_to_their_weights(spark):
    sources = ["big"] * 400 + ["mid"] * 150 + [None] * 50 + ["one"]
    frame = docs(spark, [f"text {i}" for i in range(601)], sources)
    weights = {"big": 0.5, "mid": 0.25, "": 0.15, "one": 0.1}
    rows = mixing.mix(frame.select("doc_id", "source", "text"), weights, block_docs=4, quantum=100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(601))
    by_slot = defaultdict(list)
    for r in rows:
        by_slot[r.slot].append(r)
        assert r.release <= r.slot < r.deadline
    assert sorted(by_slot) == list(range(len(by_slot)))
    assert all(len({(r.source, r.block) for r in own}) == 1 and len(own) <= 4 and [r.place for r in sorted(own, key=lambda r: r.place)] == list(range(len(own))) for own in by_slot.values())
    first = [by_slot[t][0] for t in sorted(by_slot) if by_slot[t][0].phase == 0]
    done = Counter()
    for t, r in enumerate(first, 1):
        done[r.source or ""] += 1
        assert all(abs(done[s] - weights[s] * t) < 1 for s in weights)
    last = max(r.phase for r in rows)
    assert last >= 2


def test_no_rows_and_many_sources(spark):
    frame = docs(spark, ["a"] * 300, [f"s{i}" for i in range(300)]).select("doc_id", "source")
    assert mixing.mix(frame.limit(0)).collect() == []
    assert sorted(r.slot for r in mixing.mix(frame).collect()) == list(range(300))


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(i // 3, "a" if i % 2 else None, i, "x") for i in range(90)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, slot int, Phase string").withColumn("place", F.lit(None).cast("string"))
    mixed = mixing.mix(frame)
    assert mixed.columns == [*frame.columns, "_phase", "block", "_slot", "release", "deadline", "_place"]
    found = mixed.collect()
    assert sorted((r.doc_id, r.source or "", r.slot, r.Phase) for r in found) == sorted((a, b or "", c, d) for a, b, c, d in rows)
    assert all(r.place is None and r.release <= r["_slot"] < r.deadline for r in found)
    places = sorted((r["_slot"], r["_place"]) for r in found)
    assert len(set(places)) == 90 and max(p for _, p in places) == 7


def test_thirds_and_small_weights_stay_exact(spark):
    frame = spark.range(7503).selectExpr("id AS doc_id", "CASE WHEN id < 7500 THEN concat('s', id % 3) ELSE 'tiny' END AS source")
    weights = {"s0": 1 / 3, "s1": 1 / 3, "s2": 1 / 3, "tiny": 1e-4}
    total = sum(weights.values())
    rows = sorted(mixing.mix(frame, weights, block_docs=1).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(7503)) and len({r.doc_id for r in rows}) == 7503
    done = Counter()
    for t, r in enumerate(rows, 1):
        assert r.release <= r.slot < r.deadline
        done[r.source] += 1
        assert r.phase or all(abs(done[s] - w / total * t) < 1 for s, w in weights.items())
    assert sum(r.phase == 0 for r in rows) > 7400


def test_any_number_of_sources(spark):
    from tidemark.llm.queries import op8_mixing

    frame = spark.range(4000).selectExpr("id AS doc_id", "concat('host', CAST(pow(id, 0.75) AS long)) AS source")
    n = frame.select("source").distinct().count()
    assert n > 450
    with tempfile.TemporaryDirectory() as folder:
        frame.write.parquet(f"{folder}/documents.parquet")
        rows = op8_mixing(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == list(range(4000))
    blocks = {r.slot: (r.source, r.block) for r in rows}
    assert sorted(blocks) == list(range(len(set(blocks.values())))) and all(r.release <= r.slot < r.deadline for r in rows)
