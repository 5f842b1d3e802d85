"""Findings of the fourth round: what each of these asks would have failed before."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import pieces, shared
from tidemark.functions import geometry as G
from tidemark.operators import audit, calibration, generator, injection, matching, reference, tools
from tidemark.operators import templates as T
from tidemark.sources import entities as E
from tests.test_injection import BOX, crowded


@pytest.fixture(autouse=True)
def anew():
    shared.forget()
    yield
    shared.forget()


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_images_are_never_cut():
    """Batches are cut anew wherever they end, one image may fill several."""
    ids = [1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5]
    for size in range(1, 12):
        parts = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + size], pa.int64())], ["image_id"]) for i in range(0, len(ids), size)]
        found = [t["image_id"].to_pylist() for t in pieces.whole(iter(parts))]
        assert sum(found, []) == ids and sum(len(set(f)) for f in found) == 5


def test_matching_as_columns_is_matching_by_joins(spark, sf_dir, monkeypatch):
    """All labels and detections, numbered and matched in one pass, and the same by joins."""
    one = told(matching.faced(spark, sf_dir))
    shared.forget()
    monkeypatch.setattr(matching, "PIECE", 9)
    assert one == told(matching.faced(spark, sf_dir))
    assert told(matching.pairs(spark, sf_dir)) == told(matching.matched(spark, sf_dir))
    rows = [(1, True, 0, 0, 10, 10, None), (1, True, 0, 0, 10, 10, None), (1, False, 0, 0, 10, 10, 5), (1, False, 0, 1, 10, 10, 7), (1, False, None, 0, 10, 10, 7), (2, True, 5, 5, 5, 9, None), (2, False, 5, 5, 5, 9, 1), (3, False, 1, 1, 2, 2, 1)]
    df = spark.createDataFrame(rows, "image_id long, label boolean, x1 int, y1 int, x2 int, y2 int, score int")
    small = told(matching.matched_to_labels(df))
    monkeypatch.setattr(matching, "PIECE", 10**6)
    assert small == told(matching.matched_to_labels(df)) and sum(r[7] is not None for r in small) == 4


def test_images_told_as_columns_are_told_by_the_tools(spark):
    """Counts, sides and distances of an image's boxes, equal boxes and odd ones too."""
    rows = [(i, (i * 37 * n) % 780, (i * 53 + n * 101) % 780, (i * 37 * n) % 780 + (n * 17 + i) % 70, (i * 53 + n * 101) % 780 + (n * 29) % 60) for i in range(1, 60) for n in range(i % 9)]
    rows += [(61, 5, 5, 60, 60)] * 3 + [(62, 400, 400, 390, 380)]
    boxes = E.numbered(spark.createDataFrame(rows, "image_id long, x1 int, y1 int, x2 int, y2 int"))
    images = spark.range(1, 64).select(F.col("id").alias("image_id"), F.lit("inshore").alias("scene"), F.lit(0).alias("scene_group"), F.lit("test").alias("split"))
    got = reference._wide(boxes.withColumn("of", F.lit(2)).drop("n"), images, 3).cache()
    f = tools.facts(images, boxes)
    near = tools.nearest_pair(boxes).select("image_id", G.distance(F.col("d4")).alias("pair_px"))
    ends = f.where("n_boxes > 0").select("image_id", F.col("longest").alias("pick"), "shortest")
    far = T.spatial.from_box(boxes, ends.select("image_id", "pick")).join(ends, "image_id").groupBy("image_id").agg(G.distance(F.min("d4")).alias("neighbour_px"), G.distance(F.min(F.when(F.col("n") == F.col("shortest"), F.col("d4")))).alias("ends_px"))
    want = f.join(near, "image_id", "left").join(far, "image_id", "left")
    names = ["image_id", *(c for c in want.columns if c in got.columns and c not in ("image_id", "scene", "scene_group", "split"))]
    assert len(names) > 20 and told(got.where("input = 1").select(names)) == told(want.select(names))
    none = got.where("input <> 1")
    assert none.count() == 126 and none.where("n_boxes <> 0 or max_side is not null or pair_px is not null").count() == 0


def test_causes_need_no_injected_boxes(spark, sf_dir, monkeypatch):
    """a table makes boxes for the inputs that it asks for alone."""
    every = reference.judged(spark, sf_dir)
    asked = ("detected", *(f"corrected_{k}" for k in injection.KINDS))
    want = told(every.select("qid", *(f"right_{c}" for c in asked)))
    shared.forget()
    monkeypatch.setattr(injection, "injected", None)
    assert told(reference.judged(spark, sf_dir, asked).select("qid", *(f"right_{c}" for c in asked))) == want
    assert reference.causes_by_level(spark, sf_dir).count() > 0


def test_the_kinds_are_injected_apart(spark, sf_dir, monkeypatch):
    """misses make no pools, places or matching, shifts make no false boxes."""
    want = [told(injection.inject_miss(spark, sf_dir)), told(injection.inject_loc(spark, sf_dir))]
    shared.forget()
    monkeypatch.setattr(injection, "_added", None)
    assert told(injection.inject_loc(spark, sf_dir)) == want[1]
    monkeypatch.setattr(injection, "_moved", None)
    monkeypatch.setattr(injection, "judge", None)
    shared.forget()
    monkeypatch.setattr(calibration, "pools", None)
    assert told(injection.inject_miss(spark, sf_dir)) == want[0]


def test_judged_as_columns_is_judged_by_joins(spark, sf_dir, monkeypatch):
    """an image's attempts are matched in one pass; larger images by joins, to the same verdicts; so with attempts in other rounds."""
    found = calibration.calibrate(spark, sf_dir)
    labels = spark.createDataFrame(crowded(), BOX)
    rows, verdicts = (told(df) for df in injection.inject(labels, found))
    assert any(v[2] > 0 and v[-1] for v in verdicts) and any(not v[-1] for v in verdicts)
    monkeypatch.setattr(matching, "PIECE", 4)
    monkeypatch.setattr(injection, "AGAIN", (1,))
    assert [told(df) for df in injection.inject(labels, found)] == [rows, verdicts]


def test_candidates_are_told_of_eligible_images(spark, sf_dir, monkeypatch):
    """only eligible images are answered, in one pass and to the same answers as by the tools for images of any size; the scene groups are counted without candidates."""
    got = told(generator.candidates(spark, sf_dir))
    names = generator.candidates(spark, sf_dir).columns
    caps = told(generator.generation_caps(spark, sf_dir))
    shared.forget()
    wide = T.wide
    monkeypatch.setattr(T, "wide", None)
    assert told(generator.candidates(spark, sf_dir)) == got and told(generator.generation_caps(spark, sf_dir)) == caps
    monkeypatch.setattr(T, "wide", wide)
    monkeypatch.setattr(reference, "_wide", lambda boxes, images, inputs: wide(spark, sf_dir, boxes.drop("of")).join(images.select("image_id"), "image_id", "left_semi"))
    assert told(generator.candidates(spark, sf_dir).select(names)) == got


def test_what_is_sampled_is_told_once(spark):
    """the rows that a sample is drawn from are filed, not made again for each pass."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") % 9 == 0, "few").otherwise("many").alias("stratum")).mapInArrow(seen, "key string, stratum string")
    assert audit.sampled(rows, "key", 60, 5).count() == 60 and made.value == 500
