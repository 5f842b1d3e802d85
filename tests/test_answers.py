"""Grading, replies and record files on rows made by hand."""

import json

from pyspark.sql import functions as F

from tidemark.operators import answers, replies, scenes
from tidemark.sources import run_files


def graded(spark, rows):
    df = spark.createDataFrame(rows, "said string, num double, cat string, kind string")
    return [r[0] for r in df.select(answers.value_matches(*(F.col(c) for c in df.columns))).collect()]


def test_values_match_by_type(spark):
    rows = [
        ("3", 3.0, None, "int"), (" 3.0 ", 3.0, None, "int"), ("3.1", 3.0, None, "int"), ("1,204", 1204.0, None, "int"), ("1e3", 1000.0, None, "int"),
        ("105", 100.0, None, "float"), ("94.9", 100.0, None, "float"), ("0", 0.0, None, "float"), ("nan", 1.0, None, "float"), ("1d", 1.0, None, "float"),
        ("Top Left", None, "top_left", "category"), (" TOP-LEFT", None, "top_left", "category"), ("left", None, "top_left", "category"), ("3", None, "top_left", "category"),
        (None, 3.0, None, "int"), ("", 3.0, None, "float"), ("3", None, None, "int"),
    ]
    assert graded(spark, rows) == [True, True, False, True, True, True, False, True, False, False, True, True, False, False, False, False, False]


def test_units(spark):
    said = [("Pixels",), (" %",), ("척",), ("",), (None,), ("count",), ("furlongs",)]
    assert [r[0] for r in spark.createDataFrame(said, "u string").select(answers.as_unit(F.col("u"))).collect()] == ["px", "percent", "ships", "none", "none", "none", None]


def test_step_problems(spark):
    good = {"reading": [], "decision": None, "action": {"type": "answer", "answer": None, "unit": "px"}}
    step = lambda **changed: json.dumps(good | changed)
    full = {"condition_from": "$a.n", "condition_value": None, "threshold": 1, "cmp": ">", "chosen": "then"}
    cases = [
        (step(), []),
        (step(decision=full), []),
        (step(decision=full | {"chosen": "maybe"}), [replies.NOT_DECISION]),
        (step(reading=[{"from": "a", "field": "b", "value": None}, 4, {"from": "a"}]), ["reading[1] needs from, field, value", "reading[2] needs from, field, value"]),
        (step(reading={}), [replies.NOT_LIST]),
        (step(reading="x", decision=5, action=None), [replies.NOT_LIST, replies.NOT_DECISION, replies.NOT_ACTION]),
        (step(action={"type": "tool", "tool": "calc", "args": {}}), []),
        (step(action={"type": "tool", "tool": "calc", "args": []}), [replies.NOT_TOOL]),
        (step(action={"type": "answer", "answer": 1}), [replies.NOT_ANSWER]),
        ('{"reading": []}', [replies.NOT_STEP]),
        ("[]", [replies.NOT_STEP]),
        ('{"reading": ', [replies.NOT_STEP]),
        ("", [replies.NOT_STEP]),
        (None, [replies.NOT_STEP]),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, reply string")
    got = {r.i: r.p for r in df.select("i", replies.step_problems(F.col("reply")).alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_scenes_by_name_and_content(spark):
    rows = [(1, "P0002.jpg", "inshore", "x"), (2, "P0001_0_800_0_800.jpg", "offshore", "x"), (3, "P0003.jpg", "offshore", "y"), (4, "P0002_1_2_3_4.jpg", "inshore", "y"), (5, "other.jpg", "inshore", "x"), (6, "P0009.jpg", "inshore", None), (7, "P0008.jpg", "inshore", None)]
    got = {r.image_id: (r.group, r.method, r.crop) for r in scenes.scene_rows(spark.createDataFrame(rows, "image_id int, name string, tag string, digest string")).collect()}
    assert got[1] == ("G0001", "byte_identical_link", None) and got[2] == ("G0001", "filename_scene_and_crop", "0 800 0 800")
    assert got[3][0] == got[4][0] == "G0001" and 5 not in got
    assert got[6] == ("G0009", "filename_scene_only", None) and got[7][0] == "G0008"


def test_record_files(spark, tmp_path):
    rows = [("a", 1, 5, None, 'x "y",\nz'), ("b", 2, 6, 7, ""), ("c", 1, 7, 8, None)]
    df = spark.createDataFrame(rows, run_files.RECORD)
    folder = str(tmp_path / "runs")
    run_files.append_records(df.limit(1), folder)
    run_files.append_records(df.where("run_id <> 'a'"), folder)
    (tmp_path / "runs" / "condition_07.jsonl").write_text('\n{"run_id":"d","cond":7,"qid":1}\n{"run_id":"e","co')
    assert sorted(r.run_id for r in run_files.load_records(spark, folder).collect()) == ["a", "b", "c", "d"]
    assert [r[0] for r in run_files.read_records(spark, folder).where("_corrupt_record is not null").select("_corrupt_record").collect()] == ['{"run_id":"e","co']
    path = str(tmp_path / "csv")
    run_files.write_csv(df.coalesce(1), path)
    part = next((tmp_path / "csv").glob("part-*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfrun_id,cond")
    assert sorted(map(tuple, run_files.read_csv(spark, path, run_files.RECORD).collect()), key=str) == sorted((r if r[4] else (*r[:4], None) for r in rows), key=str)
    assert run_files.read_csv(spark, path).columns == df.columns
