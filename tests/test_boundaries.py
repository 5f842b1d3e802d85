"""Edges that the tables may not hold."""

from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import data_prep, matching, tools

BOX = "image_id long, x1 int, y1 int, x2 int, y2 int, n int"


def boxes(spark, *rows):
    return spark.createDataFrame(list(rows), BOX)


def test_quadrants_split_to_the_right_and_down(spark):
    b = boxes(spark, (1, 0, 0, 800, 800, 1), (1, 0, 0, 799, 799, 2), (1, 0, 0, 799, 800, 3), (1, 0, 0, 800, 799, 4))
    got = {r.n: r.q for r in b.select("n", G.quadrant().alias("q")).collect()}
    assert got == {1: "bottom_right", 2: "top_left", 3: "bottom_left", 4: "top_right"}


def test_rectangles_are_half_open(spark):
    b = boxes(spark, (1, 100, 100, 100, 100, 1), (1, 500, 100, 500, 100, 2))
    assert [r.n for r in b.where(G.inside(100, 100, 500, 500)).collect()] == [1]


def test_rounding_is_half_up_and_clamped(spark):
    v = spark.createDataFrame([(-3.0,), (-0.5,), (0.5,), (2.49,), (900.0,)], "v double")
    assert [r[0] for r in v.select(G.clamp(F.col("v"))).collect()] == [0, 0, 1, 2, 800]


def test_overlap_thresholds(spark):
    a = boxes(spark, (1, 0, 0, 10, 10, 1), (2, 0, 0, 0, 0, 1), (3, 0, 0, 10, 10, 1))
    b = boxes(spark, (1, 0, 0, 10, 5, 1), (2, 0, 0, 0, 0, 1), (3, 0, 0, 10, 4, 1))
    assert [(r.image_id, r.iou) for r in matching.candidates(a, b).collect()] == [(1, 0.5)]


def test_greedy_takes_the_best_pair_first(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 0.6), (1, 1, 2, 0.8), (1, 2, 2, 0.7), (1, 2, 1, 0.5), (2, 2, 1, 0.6), (2, 1, 1, 0.6)], "image_id long, d int, l int, iou double")
    assert sorted((r.image_id, r.d, r.l) for r in matching.greedy(pairs).collect()) == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]


def test_errors_are_attributed(spark):
    labels, dets = boxes(spark, (1, 0, 0, 10, 10, 1), (1, 50, 50, 60, 60, 2), (1, 90, 90, 100, 100, 3)), boxes(spark, (1, 0, 0, 10, 6, 1), (1, 50, 50, 60, 60, 2), (1, 200, 0, 210, 10, 3))
    found = matching.errors(dets, labels, matching.greedy(matching.candidates(dets, labels)))
    assert sorted((r.kind, r.n) for r in found.collect()) == [("fp", 3), ("loc", 1), ("miss", 3)]


def test_images_without_boxes_stay(spark):
    images = spark.createDataFrame([(1, "inshore", 0, "test"), (2, "offshore", 0, "test")], "image_id long, scene string, scene_group int, split string")
    got = {r.image_id: r for r in tools.facts(images, boxes(spark, (1, 0, 0, 60, 10, 1), (1, 0, 0, 60, 5, 2))).collect()}
    assert got[2].n_boxes == 0 and got[2].max_side is None and got[1].longest == 1 and got[1].n_long == 2


def test_nearest_pair_ties_go_to_the_smaller_numbers(spark):
    b = boxes(spark, *((1, x, 0, x + 2, 2, n) for n, x in enumerate((0, 10, 20), 1)))
    assert [(r.na, r.nb, r.d4) for r in tools.nearest_pair(b).collect()] == [(1, 2, 400)]
    assert {r.n: r.other for r in tools.neighbours(b).collect()} == {1: 2, 2: 1, 3: 2}


def test_noise_without_free_pixels_is_null(spark):
    flat = spark.createDataFrame([(0, [0.0] * 64)], "vec_id long, embedding array<float>")
    full = [r for r in tools.pixel_stats(flat).collect() if r.region == "full"]
    assert full[0].brightness == 127.0 and full[0].noise == 0.0


def test_near_duplicates_against_all_pairs(spark):
    import random

    r = random.Random(3)
    base = r.getrandbits(60)
    values = [base] + [base ^ sum(1 << b for b in r.sample(range(60), k)) for k in (1, 4, 4, 5, 8)] + [r.getrandbits(60) for _ in range(50)]
    frame = spark.createDataFrame(list(enumerate(values)), "vec_id long, b long")
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 4}
    assert {(x.a, x.b) for x in data_prep.near(frame).collect()} == want and len(want) >= 3


def test_merged_groups_take_the_smallest_name(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdef"], "node string")
    edges = spark.createDataFrame([("b", "c"), ("c", "d"), ("e", "f")], "a string, b string")
    assert {x.node: x.root for x in data_prep.merged(nodes, edges).collect()} == {"a": "a", "b": "b", "c": "b", "d": "b", "e": "e", "f": "e"}


def test_empty_tables(spark):
    none = boxes(spark, (1, 0, 0, 1, 1, 1)).limit(0)
    assert tools.nearest_pair(none).collect() == [] and matching.greedy(matching.candidates(none, none)).collect() == []


def test_places_of_rows(spark):
    from tidemark.functions.ordering import numbered

    rows = spark.createDataFrame([(g, k) for g in "ab" for k in (5, 3, 99, 12, 11, 40)], "g string, k long")
    got = {(r.g, r.k): r.n for r in numbered(rows, ["g"], F.floor(F.col("k") / 10), ["k"], "n").collect()}
    assert got == {(g, k): i for g in "ab" for i, k in enumerate(sorted([5, 3, 99, 12, 11, 40]), 1)}


def test_streams_drop_repeats_and_late_records(spark, tmp_path):
    from datetime import datetime

    from tidemark.streaming import records

    def put(name, *rows):
        frame = spark.createDataFrame([(i, datetime(2024, 1, d, h), "x") for i, d, h in rows], "event_id long, ts timestamp, event_type string")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")

    def run():
        schema = "event_id long, ts timestamp, event_type string"
        frame = spark.readStream.schema(schema).parquet(f"{tmp_path}/events.parquet")
        found = records.drained(spark, records.daily(frame), "append", f"{tmp_path}/stream")
        return {r.window.start.day: r.n for r in found.collect()}

    put("a", (1, 1, 3), (2, 1, 4), (1, 1, 3), (3, 2, 1), (4, 3, 12))
    assert run() == {1: 2}
    # record 3 again, one for a day that is over, one that is late but not too late
    put("b", (3, 2, 1), (5, 1, 9), (6, 2, 20), (7, 9, 1))
    assert run() == {1: 2, 2: 2, 3: 1}


def test_classification_of_written_records(spark):
    """JSON that isn't there or isn't JSON, a misread result, a value from nowhere, a call before its source, a slip."""
    from tidemark.operators import classify

    gold = F.struct(F.lit("count").alias("target"), F.lit("full").alias("region"), F.lit(None).cast("string").alias("filters"), F.lit("count").alias("unit"))
    calls = """[{"turn":1,"call_id":"c1","tool":"detect","arg":0,"value":7},{"turn":2,"call_id":"c2","tool":"calc","arg":5,"ref":"$c1.value","value":9},{"turn":3,"call_id":"c3","tool":"calc","arg":1,"error":"no such call or variable 'c4'","value":3}]"""
    rows = [
        (1, '{"target":"count","region":"full","unit":"px"}', calls, '[{"turn":1,"source":"$c1","field":"value","value":8},{"turn":2,"source":"$c9","field":"value","value":9}]', '[{"turn":2,"condition_from":"$c1.value","condition_value":7,"chosen":"else"}]', True, 8, "count", True),
        (2, '{"target":"si', None, "[", "[]", False, None, None, True),
    ]
    frame = spark.createDataFrame(rows, "qid long, interpretation string, calls string, readings string, decisions string, has_answer boolean, answer_value int, answer_unit string, format_ok boolean")
    runs = classify.parsed(frame).withColumns({"gold": gold, "has_branch": F.lit(True), "gold_branch": F.lit("then"), "reachable": F.lit(9), "gold_calcs": F.array(F.lit(5)), "final_turn": F.lit(3)})
    kinds = lambda df: sorted((r.qid, r.turn, r.kind, r.harmless) for r in df.collect())
    assert sorted(tuple(r) for r in classify.differences(runs).collect()) == [(1, "", "unit"), (2, "target", "region,unit")]
    assert kinds(classify.stage3(runs)) == [(1, 1, "reading_mismatch", False), (1, 2, "reading_source_missing", True)]
    assert kinds(classify.stage4(runs)) == [(1, 2, "wrong_branch", False), (1, 3, "order_error", False)]
    assert kinds(classify.stage5(runs)) == [(1, 3, "extra_calc", True)]
    assert kinds(classify.stage6(runs)) == [(1, 3, "transcription", False)]
