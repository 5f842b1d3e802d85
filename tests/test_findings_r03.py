"""Findings of the third round: what each of these asks would have failed before."""

import hashlib

from pyspark.sql import functions as F

from tidemark.functions import shared, values
from tidemark.operators import answers, audit, call_matching, injection, intervals, reference, runs, spatial, statistics
from tidemark.sources.entities import table


def chance(*key):
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16)


def test_kappa_draws_rows_by_their_ids(spark, sf_dir, monkeypatch):
    """a draw is a place among the rows in the order of their ids, as the statement says."""
    monkeypatch.setattr(statistics, "DRAWS", 40)
    rows = [(r.quality, r.toxic) for r in sorted(table(spark, sf_dir, "labels").collect(), key=lambda r: (r.doc_id, r.quality, r.toxic))]
    g, found = len(rows), []
    for b in range(40):
        own = [rows[chance(b, j) % g] for j in range(g)]
        po, a, t = sum(x == y for x, y in own) / g, sum(x for x, _ in own) / g, sum(y for _, y in own) / g
        pe = a * t + (1 - a) * (1 - t)
        if pe != 1:
            found.append((po - pe) / (1 - pe))
    found.sort()
    got = statistics.kappa_ci(spark, sf_dir).first()
    assert got.used == len(found) and abs(got.low - found[1]) < 2e-6 and abs(got.high - found[39]) < 2e-6
    assert "order by doc_id" in statistics.ORACLE_SQL["kappa_ci"]


def method_size(df):
    """Bytes of the longest method that Spark compiles for a plan."""
    import re

    plan = df.sparkSession._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(df._jdf.queryExecution().executedPlan())
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan))


def test_leftovers_read_each_call_once_and_join_no_calls(spark):
    """both sides are one table; a text is parsed once and not for each use of a part."""
    e = spark.createDataFrame([(1, 0, s, "spatial_query", f'{{"query": "distance", "ship_a": {s}}}', '{"query": "distance", "ship_a": "$c1.id"}', True) for s in (1, 2)], call_matching.EXPECTED)
    c = spark.createDataFrame([(1, 1, "spatial_query", '{"query": "distance", "ship_a": 2}', '{"query": "distance", "ship_a": 2}'), (1, 2, "spatial_query", None, '{"query": "distance", "ship_a": "$c9.id"}'), (1, 3, "image_stats", "{oops", "{oops")], call_matching.CALLS)
    left = call_matching.leftovers(e, c)
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.count("Join") == 1
    assert [(r.step, r.turn) for r in left.collect()] == [(None, 3)]


def test_replies_are_compiled_in_short_methods(spark, sf_dir):
    """a method of over 8,000 bytes isn't compiled by the JVM; what replies are made of is told once."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        q = spark.createDataFrame([("q1", 1, 0, "test", "l1_scene", 1, "category", "none", False, None, "inshore", None, "inshore")], "qid string, image_id long, scene_group int, split string, template string, level int, answer_type string, unit string, box_dependent boolean, gold_num double, gold_cat string, detected_num double, detected_cat string")
        whole = answers.records
        answers.records = lambda spark, sf_dir: q
        try:
            assert method_size(answers.accuracy_by_template(spark, sf_dir)) < 8000
        finally:
            answers.records = whole
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_boxes_of_an_image_meet_where_they_are(spark):
    """F3 and those that inject: sides that are numbered by image aren't shuffled again, and labels aren't copied by kind."""
    from tidemark.sources import entities as E

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        raw = spark.createDataFrame([(i, x, 0, x + 40, 40) for i in range(3) for x in (0, 10, 200)], "image_id long, x1 int, y1 int, x2 int, y2 int")
        one, two = E.numbered(raw), E.numbered(raw)
        found = spatial.overlaps(one, two, 0.5)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
        assert found.count() == 3 * 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_crowded_and_other_images_overlap_alike(spark, monkeypatch):
    rows = [(i, n + 1, (37 * n * (i + 1)) % 700, (53 * n) % 700, (37 * n * (i + 1)) % 700 + 60, (53 * n) % 700 + 90) for i in range(4) for n in range(20 * (i + 1))]
    b = spark.createDataFrame([*rows, (1, 99, 5, 5, 5, 5)], "image_id long, n int, x1 int, y1 int, x2 int, y2 int").withColumn("tag", F.col("n") % 3)
    told = lambda: sorted(map(tuple, spatial.overlaps(b, b.drop("tag"), 0.3, ("tag",)).collect()))
    mixed = told()
    monkeypatch.setattr(spatial, "CROWD", 10**6)
    direct = told()
    monkeypatch.setattr(spatial, "CROWD", 0)
    assert mixed == direct == told() and len(direct) > len(rows)


def test_injected_boxes_are_kept_compressed(spark, sf_dir):
    """What the injected tables are drawn from is filed by column, not checkpointed row by row."""
    rows, verdicts = injection.injected(spark, sf_dir)
    assert all("FileScan parquet" in df._jdf.queryExecution().executedPlan().toString() for df in (rows, verdicts))
    assert rows.count() == sum(1 for _ in rows.select(*injection.COLUMNS).toLocalIterator())


def test_all_inputs_are_answered_in_one_pass(spark, sf_dir, monkeypatch):
    """an image's boxes of all inputs are one row; images with very many boxes go another way, to the same answers."""
    one = {tuple(r) for r in reference.judged(spark, sf_dir).collect()}
    monkeypatch.setattr(reference, "CROWD", 30)
    shared.forget()
    two = {tuple(r) for r in reference.judged(spark, sf_dir).collect()}
    assert one == two and len(one) > 20_000


def test_tables_make_no_boxes_that_they_do_not_ask_for(spark, sf_dir, monkeypatch):
    """what doesn't depend on injected boxes is told without them, as runs would tell it."""
    asked = {"failures_by_condition", "runtime_estimate", "manifest", "agent_error", "decomposition_stages"}
    g = runs.graded(spark, sf_dir)
    wrong = g.where(F.col("answer").isNull() | (F.col("answer") != F.col("reachable")) | (F.col("unit") != "count"))
    stages = {tuple(r) for r in wrong.groupBy("cond", "stage").agg(F.count("*")).collect()}
    flags = {tuple(r) for r in wrong.select("run_id").collect()}
    shared.forget()
    monkeypatch.setattr(injection, "inject", None)
    for table_of in (intervals.QUERIES["noise_intervals"], intervals.QUERIES["contrast_intervals"]):
        assert table_of(spark, sf_dir).count() > 0
    monkeypatch.setattr(runs, "counts", None)
    assert all(runs.QUERIES[q](spark, sf_dir).count() > 0 for q in asked)
    assert {tuple(r) for r in runs.decomposition_stages(spark, sf_dir).collect()} == stages
    assert {(r.run_id,) for r in runs.agent_error(spark, sf_dir).where("agent_error").collect()} == flags
    monkeypatch.undo()
    shared.forget()


def test_values_are_compared_side_by_side(spark):
    """no path is shuffled, and both texts are taken apart in step; keys with quotes, kinds that differ, one side alone."""
    rows = [(1, '{"a":1,"b":[1,2,{"c":null}]}', ' {"a":1.0000001,"b":[1,2,{"c":1}]}'), (2, None, '{"a":1}'), (3, None, None), (4, "{oops", "1"), (5, "[1,2]", '{"0":1,"1":3}'), (6, '{"a\'b":1,"x":null}', '{"a\'b":2}'), (7, "[]", "{}")]
    found = values.compare(spark.createDataFrame(rows, "k int, l string, r string"), ["k"], "l", "r")
    assert {(r.k, r.equal, r.n_differ) for r in found.collect()} == {(1, False, 1), (2, False, 2), (3, True, 0), (4, False, 1), (5, False, 2), (6, False, 2), (7, False, 1)}
    assert "path" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_are_those_of_the_injected_boxes(spark, sf_dir):
    """How many boxes an injection leaves is known without matching them; labels without an area and crowded places too."""
    from tidemark.operators.calibration import calibrate

    found = calibrate(spark, sf_dir)
    box = "image_id long, n int, x1 int, y1 int, x2 int, y2 int, scene string"
    odd = [(i, n, (91 * n * i) % 700, (57 * n) % 700, (91 * n * i) % 700 + (0 if (n + i) % 7 == 0 and i % 3 else 40), (57 * n) % 700 + 30, ("inshore", "offshore")[i % 2]) for i in range(1, 40) for n in range(1, 4 + i)]
    # so crowded that slots stay without a place, and equal boxes
    odd += [(99, n, 45 * (n % 17), 45 * (n // 17), 45 * (n % 17) + 44, 45 * (n // 17) + 44, "inshore") for n in range(289)] + [(98, n, 5, 5, 50, 50, "offshore") for n in range(30)]
    for labels in (spark.createDataFrame(odd, box), injection.labelled(spark, sf_dir)):
        rows, verdicts = injection.inject(labels, found, ("miss", "fp"))
        by = injection.boxes(rows).groupBy("image_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("miss", "fp")))
        want = {r.image_id: (r.n, r.miss or 0, r.fp or 0) for r in labels.groupBy("image_id").agg(F.count("*").alias("n")).join(by, "image_id", "left").collect()}
        assert {r.image_id: (r.label, r.miss, r.fp) for r in injection.numbers(labels, found).collect()} == want
        kinds = {(r.kind, r.clean, r.attempt > 0) for r in verdicts.collect()}
    assert len(want) > 1000 and ("fp", True, False) in kinds


def shuffled(df):
    """Columns that a plan shuffles or sorts."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Join"), plan.count("Window"), plan.count("Sort")


def test_runs_are_told_from_images_numbers(spark, sf_dir):
    """Runs are rows of an image's numbers; none of them is joined, shuffled or written."""
    for df in (runs.graded(spark, sf_dir), runs.with_cause(spark, sf_dir), intervals.by_question(spark, sf_dir), audit.judged(spark, sf_dir)):
        assert shuffled(df) == (0, 0, 0) and "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
    side = {(r.qid, c): (r[f"r{c}"], r[f"w{c}"], r[f"e{c}"], r[f"a{c}"]) for r in intervals.by_question(spark, sf_dir).collect() for c in intervals.CONDITIONS}
    one = runs.graded(spark, sf_dir).collect()
    assert side == {(r.qid, r.cond): (int(r.correct), r.reachable != r.gold, r.agent_error, None if r.answer is None else f"{r.answer}|{r.unit}") for r in one}
    assert len(one) == 11 * len({r.qid for r in one})


def test_samples_are_cut_before_they_are_sorted(spark, monkeypatch):
    """F16: the same rows however finely they are counted, strata of a row and of very many."""
    rows = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") < 3, F.col("id").cast("string")).when(F.col("id") < 20, "few").otherwise("many").alias("stratum"))
    sizes = {"0": 1, "1": 1, "2": 1, "few": 17, "many": 2980}
    take = {r.stratum: r.take for r in audit.allotted(spark.createDataFrame(list(sizes.items()), "stratum string, n long"), 60, 5).collect()}
    md5 = lambda k: hashlib.md5(k.encode()).hexdigest()
    own = {}
    for r in rows.collect():
        own.setdefault(r.stratum, []).append(r.key)
    want = {(k, s) for s, keys in own.items() for k in sorted(keys, key=md5)[: take[s]]}
    for digits in (1, 3):
        monkeypatch.setattr(audit, "DIGITS", digits)
        found = audit.sampled(rows, "key", 60, 5)
        assert {(r.key, r.stratum) for r in found.collect()} == want and len(want) == 60
    assert "Window" in found._jdf.queryExecution().optimizedPlan().toString()


def test_draws_are_neither_written_nor_hashed_for_what_nobody_asks(spark, sf_dir):
    """23 rows an image pass by; a report draws only the places that its reasons look at, and gives them as the whole draws do."""
    from tidemark.operators import samplers

    spark.conf.set("spark.sql.debug.maxToStringFields", "2000")
    try:
        whole, report = samplers.draws(spark, sf_dir), samplers.slot_report(spark, sf_dir)
        one, two = (df._jdf.queryExecution().optimizedPlan().toString() for df in (whole, report))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert not one.startswith("LogicalRDD") and "l1_rect_count w" in one
    assert "l1_rect_count w" not in two and "|, l5_scene_quadrant" not in two and two.count("md5(") < one.count("md5(") / 2
    want = {(r.template, r.reason or "asked"): r["count"] for r in whole.groupBy("template", "reason").count().collect()}
    assert {(r.template, r.reason): r.n for r in report.collect()} == want and any(reason == samplers.NO_CHOICE for _, reason in want)


def test_deviations_are_weighed_in_a_questions_row(spark, sf_dir):
    """of a run only the image's key is shuffled; no call, reading or deviation is joined, sorted or told twice."""
    from tidemark.operators import classify

    for name in ("harmless_rules", "deviation_kind", "interpretation_cases"):
        df = classify.QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert shuffled(df) == (1, 0, 0) and plan.count("Relation [") == 2 and "collect_list" not in plan


def test_unmatched_calls_of_a_row(spark):
    """repeated calls take each other by rank, a call without a tool or argument takes none."""
    from tidemark.operators import traces

    call = "array<struct<{}: int, tool: string, arg: int>>"
    rows = [
        (1, [(1, "a", 1), (2, "a", 1), (3, "b", 2)], [(1, "a", 1), (2, "b", 2), (3, "b", 2), (4, "b", 2)]),
        (2, [(1, "a", 1), (2, "b", 1)], [(1, "b", 3), (2, None, 1), (3, "c", None)]),
        (3, [(1, "a", None), (2, "b", 1)], []),
        (4, [(1, "a", 1)], [(1, "a", 1)]),
    ]
    df = spark.createDataFrame(rows, f"k int, p {call.format('step')}, t {call.format('turn')}")
    found = {r.k: sorted(map(tuple, r.devs)) for r in traces.unmatched(df, "p", "t", "devs").collect()}
    assert found == {
        1: [(3, "wrong_tool"), (4, "extra_call")],
        2: [(1, "wrong_args"), (2, "wrong_tool"), (3, "extra_call")],
        3: [(99, "missing_call"), (99, "missing_call")],
        4: [],
    }
