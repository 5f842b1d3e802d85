"""Injection of one kind of error into the label boxes: misses, false boxes, poor places.

Chance is a hash of the kind, the image, the box and the attempt, so an image meets the same fate in every run. False boxes
and shifts are whole tuples of the calibration's pools. A place is drawn anew up to TRIES times, and what finds none gets a
row that says so. An image's false boxes are placed one after the other and keep clear of its labels and of each other: a fold
over its slots' candidates. One try is made for all images, more and at last all of them only where those before didn't do,
which gives the same.

The injected boxes are matched to the labels again. An image that shows anything but what was injected is done anew, with
the next attempt's chance, up to ATTEMPTS times; the first clean attempt counts, and the last one where none is. Of misses and
false boxes the verdict is known without matching (see `numbers`), unless a label has no area; so is that of images in which
nothing was moved. The others' boxes are brought together by image and matched as columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions import pieces
from tidemark.functions.shared import apart, cut, filed, once
from tidemark.operators import matching, spatial
from tidemark.operators.calibration import _CAL, SCENES, Calibration, calibrate, measured
from tidemark.sources import entities as E

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
KINDS = ("miss", "fp", "loc")
CORNERS = ("x1", "y1", "x2", "y2")
#: Tries for a place, attempts at an image, overlap that an added box may have.
TRIES, ATTEMPTS, FREE = 50, 10, 0.1
#: False boxes: the tries of each round, over which every slot is tried anew. Shifts: the first try of each round.
PLACES, ROUNDS = (1, 6, TRIES), (0, 2, 6, 14)
#: The first attempt of each round of attempts side by side.
AGAIN = (1, 3)
#: What is returned of each label and each slot of an image: state is kept, missed, moved, added or failed; try is null where nothing was drawn.
COLUMNS = ("kind", "image_id", "attempt", "n", "state", "try", *CORNERS)
#: The label's own corners, null of slots.
WAS = tuple(f"was_{c}" for c in CORNERS)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _corners(cx, cy, w, h) -> dict:
    return {"x1": G.clamp(cx - w / 2), "y1": G.clamp(cy - h / 2), "x2": G.clamp(cx + w / 2), "y2": G.clamp(cy + h / 2)}


def _drawn(rows: DataFrame, calibration: Calibration, pool, number, prefix: str) -> DataFrame:
    """rows with the tuple that each one's number names in its pool, as prefix_a to prefix_d."""
    tuples = calibration.pools.select(F.col("pool").alias("of_pool"), F.col("idx").alias("of_idx"), *(F.col(c).alias(f"{prefix}_{c}") for c in "abcd"))
    keyed = rows.withColumn("in_pool", pool).withColumn("in_idx", number)
    return keyed.join(tuples, (F.col("in_pool") == F.col("of_pool")) & (F.col("in_idx") == F.col("of_idx"))).drop("in_pool", "in_idx", "of_pool", "of_idx")


def _missed(labels: DataFrame) -> DataFrame:
    gone = G.chance("miss", F.col("image_id"), F.col("n"), F.col("attempt")) % 1_000_000 < F.col("miss")
    return labels.select(F.lit("miss").alias("kind"), "image_id", "attempt", "n", F.when(gone, "missed").otherwise("kept").alias("state"), F.lit(None).cast("int").alias("try"), *CORNERS, *_was())


def _was() -> list:
    return [F.col(c).alias(w) for c, w in zip(CORNERS, WAS, strict=True)]


def slots(labels: DataFrame) -> DataFrame:
    """image_id, attempt, scene, n_fp: the whole part of the image's expected misses, and one more with the rest as chance."""
    expected = labels.groupBy("image_id", "attempt", "scene").agg(F.sum(F.col("miss").cast("long")).alias("expected"))
    return expected.withColumn("n_fp", _slots_of("expected"))


def _slots_of(expected: str):
    more = (G.chance("fp", F.col("image_id"), F.col("attempt")) % 1_000_000 < F.col(expected) % 1_000_000).cast("int")
    return (F.floor(F.col(expected) / 1_000_000) + more).cast("int")


def _tried(wanted: DataFrame, labels: DataFrame, calibration: Calibration, tries: int) -> DataFrame:
    """wanted (image_id, attempt, scene, n_fp) with `got`: the boxes that fit, each slot's first, in the order of the slots."""
    pool_of, sizes = calibration.borrowed(), calibration.sizes
    pick = lambda d: reduce(lambda e, s: e.when(F.col("scene") == s, F.lit(d[s])), SCENES, F.when(F.lit(False), F.lit(d[SCENES[0]])))
    of, size = pick(pool_of), pick({s: max(1, sizes.get(p, 0)) for s, p in pool_of.items()})
    tried = wanted.withColumn("slot", F.explode(F.sequence(F.lit(1), "n_fp"))).withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).drop("n_fp")
    number = lambda what: G.chance(what, F.col("image_id"), F.col("slot"), F.col("try"), F.col("attempt")) % size
    rows = _drawn(_drawn(tried, calibration, of, number("wh"), "s"), calibration, of, number("xy"), "p")
    rows = apart(rows, **_corners(F.col("p_c"), F.col("p_d"), F.col("s_a"), F.col("s_b"))).where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    # tries and labels meet row by row, so no labels are gathered
    same = reduce(lambda a, b: a & b, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("image_id", "attempt") if c in labels.columns))
    rows = rows.select("image_id", "attempt", "slot", "try", *CORNERS).alias("a").join(labels.alias("b"), same & (G.iou("a", "b") > FREE), "left_anti")
    each = rows.groupBy("image_id", "attempt").agg(F.sort_array(F.collect_list(F.struct("slot", "try", *CORNERS))).alias("tried"))
    start = F.array().cast("array<struct<slot:int,try:int,x1:int,y1:int,x2:int,y2:int>>")
    clear = lambda x, of: ~F.exists(of, lambda y: G.iou_of(x, y) > FREE)
    # slots come in order, so a slot is taken if the last box is its own
    place = lambda got, x: F.when(~F.coalesce(F.try_element_at(got, F.lit(-1))["slot"] == x["slot"], F.lit(False)) & clear(x, got), F.concat(got, F.array(x))).otherwise(got)
    got = F.when(F.col("tried").isNull(), start).when(F.size("tried") == 1, F.col("tried")).otherwise(F.aggregate("tried", start, place))
    return wanted.join(each, ["image_id", "attempt"], "left").select(*wanted.columns, got.alias("got"))


def placed(wanted: DataFrame, labels: DataFrame, calibration: Calibration) -> DataFrame:
    """image_id, attempt, n_fp, got of wanted (as _tried takes it): every round asks only the images that the rounds before left a slot of without a place.

    labels: image_id, `attempt` if it matters, corners.
    """
    labels = labels.select(*(c for c in ("image_id", "attempt") if c in labels.columns), *CORNERS)
    parts, left, own = [], wanted, labels
    for i, tries in enumerate(PLACES):
        found = filed(_tried(left, own, calibration, tries))
        short = F.size("got") < F.col("n_fp")
        parts.append(found.where(~short))
        left = found.where(short).select(*wanted.columns)
        if i == 0:
            own = filed(labels.join(left.select("image_id").distinct(), "image_id", "left_semi"))
    return reduce(DataFrame.unionByName, [*parts, found.where(short)]).select("image_id", "attempt", "n_fp", "got")


def _added(labels: DataFrame, calibration: Calibration) -> DataFrame:
    done = placed(slots(labels).where("n_fp > 0").select("image_id", "attempt", "scene", "n_fp"), labels, calibration)
    each = done.select("image_id", "attempt", "got", F.explode(F.sequence(F.lit(1), "n_fp")).alias("n"))
    box = F.get(F.filter("got", lambda x: x["slot"] == F.col("n")), F.lit(0))
    rows = each.withColumn("box", box)
    added = rows.select(F.lit("fp").alias("kind"), "image_id", "attempt", "n", F.when(F.col("box").isNull(), "failed").otherwise("added").alias("state"), "box.try", *(F.col(f"box.{c}").alias(c) for c in CORNERS), *(F.lit(None).cast("int").alias(c) for c in WAS))
    kept = labels.select(F.lit("fp").alias("kind"), "image_id", "attempt", "n", F.lit("kept").alias("state"), F.lit(None).cast("int").alias("try"), *CORNERS, *_was())
    return kept.unionByName(added)


def _shifted(chosen: DataFrame, calibration: Calibration, tries: range) -> DataFrame:
    """chosen with `try` and the corners m_x1 to m_y2 of the first of the tries that fits, null where none does."""
    tried = chosen.withColumn("try", F.explode(F.array(*(F.lit(t) for t in tries))))
    number = G.chance("shift", F.col("image_id"), F.col("n"), F.col("try"), F.col("attempt")) % max(1, calibration.sizes.get("loc", 0))
    rows = _drawn(tried.withColumn("was", F.struct(*CORNERS)), calibration, F.lit("loc"), number, "s")
    w, h = F.col("was.x2") - F.col("was.x1"), F.col("was.y2") - F.col("was.y1")
    cx, cy = (F.col("was.x1") + F.col("was.x2")) / 2 + F.col("s_a") * w, (F.col("was.y1") + F.col("was.y2")) / 2 + F.col("s_b") * h
    grown = apart(rows, cx=cx, cy=cy, w=w * F.exp("s_c"), h=h * F.exp("s_d")).drop(*CORNERS)
    rows = apart(grown, **_corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")))
    rows = apart(rows, now=F.struct(*CORNERS), overlap=G.iou_of(F.struct(*CORNERS), F.col("was")))
    fits = rows.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & (F.col("overlap") >= matching.MATCH) & (F.col("overlap") < matching.GOOD))
    if len(tries) == 1:
        # a label has one try at most, so nothing is left to choose from
        best = fits.select("image_id", "attempt", "n", F.struct("try", "now").alias("best"))
    else:
        best = fits.groupBy("image_id", "attempt", "n").agg(F.min(F.struct("try", "now")).alias("best"))
    joined = chosen.join(best, ["image_id", "attempt", "n"], "left")
    return joined.select(*chosen.columns, "best.try", *(F.col(f"best.now.{c}").alias(f"m_{c}") for c in CORNERS))


def _moved(labels: DataFrame, calibration: Calibration) -> DataFrame:
    wide = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    picked = wide & (G.chance("loc", F.col("image_id"), F.col("n"), F.col("attempt")) % 1_000_000 < F.col("loc")) & F.lit(calibration.sizes.get("loc", 0) > 0)
    rows = apart(labels.select("image_id", "attempt", "n", *CORNERS, "loc"), picked=picked).drop("loc")
    chosen = rows.where("picked").drop("picked")
    # every round asks only those that the rounds before didn't place, so few tries travel
    parts, left = [], chosen
    for i, start in enumerate(ROUNDS):
        found = filed(_shifted(left, calibration, range(start, ROUNDS[i + 1] if i + 1 < len(ROUNDS) else TRIES)))
        parts.append(found.where("try is not null"))
        left = found.where("try is null").select(*chosen.columns)
    parts.append(found.where("try is null"))
    tried = reduce(DataFrame.unionByName, parts)
    moved = tried.select(F.lit("loc").alias("kind"), "image_id", "attempt", "n", F.when(F.col("try").isNull(), "failed").otherwise("moved").alias("state"), "try", *(F.coalesce(f"m_{c}", c).alias(c) for c in CORNERS), *_was())
    kept = rows.where(~F.col("picked")).select(F.lit("loc").alias("kind"), "image_id", "attempt", "n", F.lit("kept").alias("state"), F.lit(None).cast("int").alias("try"), *CORNERS, *_was())
    return moved.unionByName(kept)


def boxes(rows: DataFrame) -> DataFrame:
    """The boxes that there are after the injection: all but the missed ones and the slots without a place."""
    return rows.where((F.col("state") != "missed") & F.col("x1").isNotNull())


def judge(rows: DataFrame) -> DataFrame:
    """kind, image_id, attempt, images' counts and `clean`: do the boxes, matched to the labels, show what was injected and nothing else.

    rows: COLUMNS and WAS, all labels and slots of an image, of any kinds and attempts. An image's rows are brought together once
    and all its attempts are matched as columns; larger images go by joins.
    """
    state, slot = F.col("state"), (F.col("kind") == "fp") & F.col("state").isin("added", "failed")
    told = rows.select(
        "image_id", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("kind"), F.col("attempt").cast("int").alias("attempt"), F.when(state == "added", -F.col("n")).otherwise(F.col("n")).alias("n"), slot.alias("slot"),
        ((state != "missed") & F.col("x1").isNotNull()).alias("there"), state.isin("missed", "moved").alias("changed"), (state == "added").alias("added"), (state == "failed").alias("failed"), *CORNERS, *WAS,
    )
    crowded = cut(told.groupBy("image_id").agg(F.count("*").alias("m")).where(F.col("m") > matching.PIECE).select("image_id"))
    whole = lambda df: pieces.by_image(df, ["kind", "attempt", "n"], pieces.judging(matching.MATCH, matching.GOOD), "image_id long, kind int, attempt int, n_label long, n_box long, changed long, added long, failed long, n_pair long, n_poor long")
    if crowded.isEmpty():
        seen = whole(told)
    else:
        seen = whole(told.join(crowded, "image_id", "left_anti")).unionByName(_seen_by_joins(told.join(crowded, "image_id", "left_semi")))
    shown = {"miss": F.col("n_label") - F.col("n_pair"), "fp": F.col("n_box") - F.col("n_pair"), "loc": F.col("n_poor")}
    return _verdicts(seen.withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind"))), shown)


def _verdicts(seen: DataFrame, shown: dict) -> DataFrame:
    clean = reduce(lambda a, b: a & b, (shown[k] == F.when(F.col("kind") == k, F.col("changed") + F.col("added")).otherwise(0) for k in KINDS))
    return seen.select("kind", "image_id", "attempt", "changed", "added", "failed", *(shown[k].cast("long").alias(f"shown_{k}") for k in KINDS), clean.alias("clean"))


def _seen_by_joins(told: DataFrame) -> DataFrame:
    """The counts that verdicts are made of, of images of any size: kind and attempt stay beside the image in one matching."""
    key = ["image_id", "kind", "attempt"]
    what = told.groupBy(*key).agg(F.count_if(~F.col("slot")).alias("n_label"), *(F.count_if(c).alias(name) for c, name in (("there", "n_box"), ("changed", "changed"), ("added", "added"), ("failed", "failed"))))
    labels = told.where("not slot").select(F.struct(*key).alias("image_id"), "n", *(F.col(w).alias(c) for c, w in zip(CORNERS, WAS, strict=True)))
    pairs = matching.greedy(spatial.overlaps(told.where("there").select(F.struct(*key).alias("image_id"), "n", *CORNERS), labels, matching.MATCH))
    found = pairs.groupBy("image_id").agg(F.count("*").alias("n_pair"), F.count_if(F.col("iou") < matching.GOOD).alias("n_poor")).select("image_id.*", "n_pair", "n_poor")
    return what.join(found, key, "left").fillna(0, ["n_pair", "n_poor"])


def _plainly_clean(rows: DataFrame) -> DataFrame:
    """Verdicts of images that show what was injected, as nothing else can be."""
    seen = rows.groupBy("kind", "image_id", "attempt").agg(F.count_if(F.col("state").isin("missed", "moved")).alias("changed"), F.count_if(F.col("state") == "added").alias("added"), F.count_if(F.col("state") == "failed").alias("failed"))
    return _verdicts(seen, {k: F.when(F.col("kind") == k, F.col("changed") + F.col("added")).otherwise(0) for k in KINDS})


def attempt(labels: DataFrame, calibration: Calibration, kinds: tuple[str, ...]) -> DataFrame:
    """COLUMNS and WAS of every label and slot of each image and attempt that labels name; labels: sized, with `attempt` and, for some kinds alone, `of_kind`."""
    make = {"miss": lambda own: _missed(own), "fp": lambda own: _added(own, calibration), "loc": lambda own: _moved(own, calibration)}
    own = lambda k: labels.where(F.col("of_kind") == k) if "of_kind" in labels.columns else labels
    return reduce(DataFrame.unionByName, (make[k](own(k)).select(*COLUMNS, *WAS) for k in kinds))


def inject(labels: DataFrame, calibration: Calibration, kinds: tuple[str, ...] = KINDS) -> tuple[DataFrame, DataFrame]:
    """(rows, verdicts) of all images with labels: rows as COLUMNS say, verdicts as judge gives them, one attempt an image and kind.

    labels: image_id, n, corners, scene. Attempt 0 is made for all images; the others, some side by side, for those alone that
    it didn't leave clean, and the first clean one is taken.
    """
    return _inject(filed(calibration.sized(labels)), calibration, kinds)


def _inject(sized: DataFrame, calibration: Calibration, kinds: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    rows = attempt(sized.withColumn("attempt", F.lit(0)), calibration, kinds)
    if kinds != ("miss",):
        # misses alone are a projection of the labels
        rows = filed(rows)
    flat = ~F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False))
    doubt = sized.where(flat).select("image_id", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    if "loc" in kinds:
        doubt = doubt.unionByName(rows.where("kind = 'loc' and state = 'moved'").select("image_id", "kind"))
    doubt = filed(doubt.distinct())
    if doubt.isEmpty():
        return rows.select(*COLUMNS), _plainly_clean(rows)
    key = ["kind", "image_id"]
    judged = filed(judge(rows.join(doubt, key, "left_semi")))
    bad = filed(judged.where("not clean").select("image_id", F.col("kind").alias("of_kind")))
    gone = bad.withColumnRenamed("of_kind", "kind")
    taken, verdicts = [rows.join(gone, key, "left_anti")], [_plainly_clean(rows.join(doubt, key, "left_anti")), judged.where("clean")]
    for i, start in enumerate(AGAIN):
        if bad.isEmpty():
            break
        last = i + 1 == len(AGAIN)
        more = sized.join(bad, "image_id").withColumn("attempt", F.explode(F.sequence(F.lit(start), F.lit(ATTEMPTS - 1 if last else AGAIN[i + 1] - 1))))
        later = filed(attempt(more, calibration, kinds))
        judged = filed(judge(later))
        best = judged.groupBy(*key).agg(F.min(F.when(F.col("clean"), F.col("attempt"))).alias("first"), F.max("attempt").alias("last"))
        best = filed(best.select(*key, F.coalesce("first", "last").alias("attempt") if last else F.col("first").alias("attempt")))
        found = best.where("attempt is not null")
        taken.append(later.join(found, [*key, "attempt"], "left_semi"))
        verdicts.append(judged.join(found, [*key, "attempt"], "left_semi"))
        bad = best.where("attempt is null").select("image_id", F.col("kind").alias("of_kind"))
    return reduce(DataFrame.unionByName, taken).select(*COLUMNS), reduce(DataFrame.unionByName, verdicts)


def numbers(labels: DataFrame, calibration: Calibration, plain: DataFrame | None = None) -> DataFrame:
    """image_id, label, miss, fp: an image's labels, and the boxes that inject's misses and false boxes leave there; plain: the labels without their scene, if they can be had for less.

    No boxes are matched, since the verdict is known. Two boxes overlap wholly only if they are equal, and pairs are taken by
    overlap; so of every kind of equal boxes with an area as many are matched, wholly, as the sparser side has, which are all that
    were kept. An added box overlaps no label by more than FREE, which is less than a match, and boxes without an area match none.
    So misses are clean unless a label without an area was kept, and false boxes unless there is one at all.
    """
    sized = calibration.sized(labels)
    flat = ~F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False))
    gone = lambda attempt: G.chance("miss", F.col("image_id"), F.col("n"), attempt) % 1_000_000 < F.col("miss")
    first = sized.withColumns({"flat": flat, "there": ~gone(F.lit(0))})
    per = first.groupBy("image_id", "scene").agg(
        F.count("*").alias("label"), F.count_if("there").alias("kept"), F.count_if(F.col("there") & F.col("flat")).alias("unclean"), F.sum(F.col("miss").cast("long")).alias("expected"),
        F.when(F.count_if("flat") > 0, ATTEMPTS - 1).otherwise(0).alias("attempt"),
    )
    per = filed(per.withColumn("n_fp", _slots_of("expected")).drop("expected"))
    miss = per.select("image_id", F.col("kept").alias("miss"), "unclean")
    bad = miss.where("unclean > 0").select("image_id")
    if not bad.isEmpty():
        # attempts side by side, of these images alone
        more = sized.join(bad, "image_id", "left_semi").withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(ATTEMPTS - 1)))).withColumns({"flat": flat, "there": ~gone(F.col("attempt"))})
        each = more.groupBy("image_id", "attempt").agg(F.count_if("there").alias("kept"), F.count_if(F.col("there") & F.col("flat")).alias("unclean"))
        # the first clean one, else the last
        best = each.groupBy("image_id").agg(F.min(F.struct(F.col("unclean") > 0, F.when(F.col("unclean") > 0, -F.col("attempt")).otherwise(F.col("attempt")).alias("k"), "kept"))["kept"].alias("miss"))
        miss = miss.where("unclean = 0").select("image_id", "miss").unionByName(best)
    added = placed(per.where("n_fp > 0").select("image_id", "attempt", "scene", "n_fp"), (labels if plain is None else plain).select("image_id", *CORNERS), calibration)
    # a few numbers an image meet, no boxes
    none = lambda *names: (F.lit(None).cast("long").alias(c) for c in names)
    parts = (per.select("image_id", "label", *none("miss", "added")), miss.select("image_id", *none("label"), "miss", *none("added")), added.select("image_id", *none("label", "miss"), F.size("got").cast("long").alias("added")))
    sums = reduce(DataFrame.unionByName, parts).groupBy("image_id").agg(*(F.sum(c).alias(c) for c in ("label", "miss", "added")))
    return sums.select("image_id", "label", "miss", (F.col("label") + F.coalesce("added", F.lit(0))).alias("fp"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, n, corners, scene of the labels, as the matching that the calibration needs anyhow has numbered them."""
    labels = matching.faced(spark, sf_dir).where("label").select("image_id", "n", *CORNERS)
    return labels.join(E.images(spark, sf_dir).select("image_id", "scene"), "image_id")


def calibrated(spark: SparkSession, sf_dir: str) -> Calibration:
    return once(spark, sf_dir, calibrate)


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filed(measured(spark, sf_dir)[0].sized(labelled(spark, sf_dir)))


def _injected(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, DataFrame]:
    # misses need no pools
    return _inject(once(spark, sf_dir, _sized), measured(spark, sf_dir)[0] if kind == "miss" else calibrated(spark, sf_dir), (kind,))


def injected(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = KINDS) -> tuple[DataFrame, DataFrame]:
    """Rows and verdicts of the kinds, each made once for all tables that are drawn from it."""
    found = [once(spark, sf_dir, _injected, k) for k in kinds]
    return reduce(DataFrame.unionByName, (rows for rows, _ in found)), reduce(DataFrame.unionByName, (verdicts for _, verdicts in found))


# ---- the same in SQL

_H = lambda what, *k: f"('0x' || substr(md5('{what}|' || " + " || '|' || ".join(k) + "), 1, 8))::bigint"
_IOU = lambda a, b: f"(case when ({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) > 0 then greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0)::double * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0) / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)) else 0 end)"
_AT = lambda v: f"least(greatest(floor({v} + 0.5), 0), 800)::int"
_BOX = lambda cx, cy, w, h: f"{_AT(f'{cx} - {w} / 2')} as x1, {_AT(f'{cy} - {h} / 2')} as y1, {_AT(f'{cx} + {w} / 2')} as x2, {_AT(f'{cy} + {h} / 2')} as y2"
_START = f"""{_CAL}, strat as (select s.*, r.miss, r.loc from sized s join rates r using (size, scene)),
ofpool as (select scene, case when exists (select 1 from pools p where p.pool = 'fp|' || scene) then 'fp|' || scene else 'fp|' || other end as pool from (values ('inshore', 'offshore'), ('offshore', 'inshore')) t(scene, other)),
psize as (select pool, count(*) as many from pools group by pool)"""


def _miss_sql(s: str) -> str:
    return f"""miss{s} as (select 'miss' as kind, image_id, attempt, n, case when {_H("miss", "image_id", "n", "attempt")} % 1000000 < miss then 'missed' else 'kept' end as state, null::int as "try", x1, y1, x2, y2 from in{s} where of_kind = 'miss')"""


def _fp_sql(s: str) -> str:
    """Slot after slot: of a slot's tries the first that is clear of the labels and of what is there; try 50 is the slot without a place."""
    return f"""nfp{s} as (select image_id, attempt, scene, (e // 1000000 + ({_H("fp", "image_id", "attempt")} % 1000000 < e % 1000000)::int)::int as n_fp from (select image_id, attempt, scene, sum(miss)::bigint as e from in{s} where of_kind = 'fp' group by all)),
tries{s} as (select f.image_id, attempt, slot, "try", many, o.pool from (select *, unnest(range({TRIES}))::int as "try" from (select *, unnest(range(1, n_fp + 1))::int as slot from nfp{s})) f join ofpool o using (scene) join psize z on z.pool = o.pool),
spot{s} as (select t.image_id, attempt, slot, "try", {_BOX("p.c", "p.d", "w.a", "w.b")} from tries{s} t join pools w on w.pool = t.pool and w.idx = {_H("wh", "image_id", "slot", '"try"', "attempt")} % many join pools p on p.pool = t.pool and p.idx = {_H("xy", "image_id", "slot", '"try"', "attempt")} % many),
clear{s} as (select a.* from spot{s} a where x2 > x1 and y2 > y1 and not exists (select 1 from label b where a.image_id = b.image_id and {_IOU("a", "b")} > {FREE})
  union all select image_id, attempt, unnest(range(1, n_fp + 1))::int, {TRIES}, null, null, null, null from nfp{s}),
fold{s} as (select image_id, attempt, 0 as slot, null::int as "try", null::int as x1, null::int as y1, null::int as x2, null::int as y2, []::struct(x1 int, y1 int, x2 int, y2 int)[] as there from nfp{s} where n_fp > 0
  union all select image_id, attempt, slot, b."try", b.x1, b.y1, b.x2, b.y2, case when b.x1 is null then there else list_append(there, struct_pack(x1 := b.x1, y1 := b.y1, x2 := b.x2, y2 := b.y2)) end from (
    select f.image_id, f.attempt, c.slot, f.there, min(struct_pack("try" := c."try", x1 := c.x1, y1 := c.y1, x2 := c.x2, y2 := c.y2)) as b from fold{s} f join clear{s} c on c.image_id = f.image_id and c.attempt = f.attempt and c.slot = f.slot + 1
    where c.x1 is null or len(list_filter(f.there, lambda p: {_IOU("p", "c")} > {FREE})) = 0 group by all)),
fp{s} as (select 'fp' as kind, image_id, attempt, slot as n, case when x1 is null then 'failed' else 'added' end as state, case when x1 is not null then "try" end as "try", x1, y1, x2, y2 from fold{s} where slot > 0
  union all select 'fp', image_id, attempt, n, 'kept', null, x1, y1, x2, y2 from in{s} where of_kind = 'fp')"""


def _loc_sql(s: str) -> str:
    return f"""pick{s} as (select *, x2 > x1 and y2 > y1 and {_H("loc", "image_id", "n", "attempt")} % 1000000 < loc and exists (select 1 from psize where pool = 'loc') as picked from in{s} where of_kind = 'loc'),
shift{s} as (select t.image_id, t.attempt, t.n, "try", {", ".join(f"t.{c} as o{c}" for c in CORNERS)}, {_BOX("((t.x1 + t.x2) / 2 + a * (t.x2 - t.x1))", "((t.y1 + t.y2) / 2 + b * (t.y2 - t.y1))", "((t.x2 - t.x1) * exp(c))", "((t.y2 - t.y1) * exp(d))")}
  from (select *, unnest(range({TRIES}))::int as "try" from pick{s} where picked) t join psize z on z.pool = 'loc' join pools p on p.pool = 'loc' and p.idx = {_H("shift", "image_id", "n", '"try"', "attempt")} % many),
fit{s} as (select image_id, attempt, n, min(struct_pack("try" := "try", x1 := x1, y1 := y1, x2 := x2, y2 := y2)) as b from (select f.*, struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2) as p, struct_pack(x1 := ox1, y1 := oy1, x2 := ox2, y2 := oy2) as q from shift{s} f where x2 > x1 and y2 > y1)
  where {_IOU("p", "q")} >= {matching.MATCH} and {_IOU("p", "q")} < {matching.GOOD} group by all),
loc{s} as (select 'loc' as kind, image_id, attempt, n, case when not picked then 'kept' when b is null then 'failed' else 'moved' end as state, b."try" as "try", {", ".join(f"coalesce(b.{c}, {c}) as {c}" for c in CORNERS)} from pick{s} left join fit{s} using (image_id, attempt, n))"""


def _judge_sql(s: str) -> str:
    return f"""all{s} as (select * from miss{s} union all select * from fp{s} union all select * from loc{s}),
what{s} as (select kind, image_id, attempt, count(*) filter (state in ('missed', 'moved')) as changed, count(*) filter (state = 'added') as added, count(*) filter (state = 'failed') as failed, count(*) filter (state <> 'missed' and x1 is not null) as n_box from all{s} group by all),
pair{s} as (select *, row_number() over (partition by kind, image_id, attempt order by iou desc, d, l) as k from (select a.kind, a.image_id, a.attempt, case when a.state = 'added' then -a.n else a.n end as d, b.n as l, {_IOU("a", "b")} as iou
  from all{s} a join label b on a.image_id = b.image_id where a.state <> 'missed' and a.x1 is not null) where iou >= {matching.MATCH}),
go{s} as (select kind, image_id, attempt, k, [d] as ds, [l] as ls, iou, true as took from pair{s} where k = 1
  union all select o.kind, o.image_id, o.attempt, o.k, case when list_contains(ds, o.d) or list_contains(ls, o.l) then ds else list_append(ds, o.d) end, case when list_contains(ds, o.d) or list_contains(ls, o.l) then ls else list_append(ls, o.l) end, o.iou, not (list_contains(ds, o.d) or list_contains(ls, o.l))
  from go{s} w join pair{s} o on o.kind = w.kind and o.image_id = w.image_id and o.attempt = w.attempt and o.k = w.k + 1),
seen{s} as (select w.*, coalesce(n_label, 0) as n_label, coalesce(n_pair, 0) as n_pair, coalesce(n_poor, 0) as n_poor from what{s} w left join (select image_id, count(*) as n_label from label group by image_id) using (image_id)
  left join (select kind, image_id, attempt, count(*) as n_pair, count(*) filter (iou < {matching.GOOD}) as n_poor from go{s} where took group by all) using (kind, image_id, attempt)),
told{s} as (select kind, image_id, attempt, changed, added, failed, {", ".join(f"{v} = case when kind = '{k}' then changed + added else 0 end" for k, v in (("miss", "n_label - n_pair"), ("fp", "n_box - n_pair"), ("loc", "n_poor"))).replace(", ", " and ")} as clean from seen{s})"""


_ONE = ",\n".join(f(s) for s in ("0",) for f in (_miss_sql, _fp_sql, _loc_sql, _judge_sql))
_ONCE = f"""{_START}, in0 as (select strat.*, 0 as attempt, of_kind from strat, (values ('miss'), ('fp'), ('loc')) t(of_kind)),
{_ONE}"""
_ALL = f"""{_ONCE},
in1 as (select strat.*, a.attempt, t.kind as of_kind from strat join told0 t using (image_id), (select unnest(range(1, {ATTEMPTS}))::int as attempt) a where not t.clean),
{",".join(f("1") for f in (_miss_sql, _fp_sql, _loc_sql, _judge_sql))},
taken as (select kind, image_id, coalesce(min(attempt) filter (clean), max(attempt)) as attempt from told1 group by all union all select kind, image_id, attempt from told0 where clean),
injected as (select a.* from (select * from all0 union all select * from all1) a join taken using (kind, image_id, attempt)),
verdicts as (select t.* from (select * from told0 union all select * from told1) t join taken using (kind, image_id, attempt))"""


@query(f"{_START} select image_id, sum(miss)::bigint as expected from strat group by image_id")
def expected_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In millionths of a box."""
    return calibrated(spark, sf_dir).sized(labelled(spark, sf_dir)).groupBy("image_id").agg(F.sum(F.col("miss").cast("long")).alias("expected"))


@query(f"{_ONCE} select image_id, n_fp from nfp0")
def fp_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots(calibrated(spark, sf_dir).sized(labelled(spark, sf_dir)).withColumn("attempt", F.lit(0))).select("image_id", "n_fp")


@query(f"{_ALL} select image_id, x1, y1, x2, y2, n from injected where kind = 'miss' and state = 'kept'")
def inject_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return injected(spark, sf_dir, ("miss",))[0].where("kind = 'miss' and state = 'kept'").select("image_id", *CORNERS, "n")


@query(f"""{_ALL} select image_id, attempt, n as slot, state, "try", x1, y1, x2, y2 from injected where kind = 'fp' and state <> 'kept'""")
def inject_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of every image: the box added, or state failed without one."""
    return injected(spark, sf_dir, ("fp",))[0].where("kind = 'fp' and state <> 'kept'").select("image_id", "attempt", F.col("n").alias("slot"), "state", "try", *CORNERS)


@query(f"""{_ALL} select image_id, attempt, n, state, "try", x1, y1, x2, y2 from injected where kind = 'loc' and state <> 'kept'""")
def inject_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label chosen: where it was moved to, or state failed and where it stays."""
    return injected(spark, sf_dir, ("loc",))[0].where("kind = 'loc' and state <> 'kept'").select("image_id", "attempt", "n", "state", "try", *CORNERS)


@query(f"{_ALL} select kind, count(*) as images, sum(changed)::bigint as changed, sum(added)::bigint as added, sum(failed)::bigint as failed, count(*) filter (attempt > 0) as attempts_gt1, count(*) filter (not clean) as check_failures, floor((sum(changed) + sum(added)) / count(*) * 10000 + 0.5) / 10000 as mean_per_image from verdicts group by kind")
def check_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The injected boxes of each kind matched to the labels again: what was injected, given up, done anew, and isn't clean."""
    each = F.count("*")
    return injected(spark, sf_dir)[1].groupBy("kind").agg(
        each.alias("images"), *(F.sum(c).alias(c) for c in ("changed", "added", "failed")), F.count_if(F.col("attempt") > 0).alias("attempts_gt1"), F.count_if(~F.col("clean")).alias("check_failures"),
        G.floor4((F.sum("changed") + F.sum("added")) / each).alias("mean_per_image"),
    )
