"""Matching detections to labels one to one, and what follows: error kinds, rates, thresholds, average precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import pieces
from tidemark.functions.shared import cut, filed, once
from tidemark.operators import spatial
from tidemark.sources import entities as E
from tidemark.sources.entities import with_entities

#: Fixed thresholds: overlap for a match, overlap for a good location.
MATCH, GOOD = 0.5, 0.75
#: Pairs of an image that are folded one by one; boxes of an image, of both sides, that are matched as one piece.
FOLD, PIECE = 256, 512
BOX = ("y1", "x1", "x2", "y2")
#: A box with the box that it is matched to.
FACED = "image_id long, label boolean, n int, y1 int, x1 int, x2 int, y2 int, mate int, iou double, m_y1 int, m_x1 int, m_x2 int, m_y2 int"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def candidates(dets: DataFrame, labels: DataFrame, threshold: float = MATCH) -> DataFrame:
    """image_id, d, l, iou of overlapping pairs; boxes meet by image and cell, never as all pairs of an image."""
    return spatial.overlaps(dets, labels, threshold)


def by_overlap() -> Column:
    """The order in which pairs are taken: by overlap, then d, then l."""
    return F.struct((-F.col("iou")).alias("k"), "d", "l")


def greedy(pairs: DataFrame, order: Column | None = None) -> DataFrame:
    """image_id, d, l, iou of the pairs that stay when each image's are taken in order and both sides are used once.

    order: a struct that tells all pairs of an image apart, with d and l in it. Images of up to FOLD pairs are folded one by
    one inside the JVM; the others are matched by rounds of joins, which gives the same pairs.
    """
    keyed = cut(pairs.select("image_id", "d", "l", "iou", (by_overlap() if order is None else order).alias("k")))
    crowded = cut(keyed.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") > FOLD).select("image_id"))
    if crowded.isEmpty():
        return _folded(keyed)
    return _folded(keyed.join(crowded, "image_id", "left_anti")).unionByName(mutual(keyed.join(crowded, "image_id", "left_semi")))


def _folded(keyed: DataFrame) -> DataFrame:
    """Each image's ordered pairs are walked once, with what is taken so far as the state; where no side is named twice, all stay."""
    item = F.struct("k", "d", "l", "iou")
    per = keyed.groupBy("image_id").agg(F.sort_array(F.collect_list(item)).alias("c"))
    alone = (F.size(F.array_distinct("c.d")) == F.size("c")) & (F.size(F.array_distinct("c.l")) == F.size("c"))
    start = F.slice(F.col("c"), 1, 0)
    taken = F.aggregate("c", start, lambda got, x: F.when(F.exists(got, lambda y: (y["d"] == x["d"]) | (y["l"] == x["l"])), got).otherwise(F.concat(got, F.array(x))))
    return per.select("image_id", F.explode(F.when(alone, F.col("c")).otherwise(taken)).alias("m")).select("image_id", "m.d", "m.l", "m.iou")


def mutual(keyed: DataFrame) -> DataFrame:
    """The same by rounds: a pair that comes first for both its sides stays, all that share a side with it go, and again.

    The first pair of all that are left always comes first for both sides, and whatever a round keeps would be kept by
    taking pairs in order, as nothing before it touches it. Rounds are few, unless overlaps fall along a chain.
    """
    left, taken = cut(keyed), None
    while True:
        first = lambda side: left.groupBy("image_id", side).agg(F.min("k").alias("k")).select("image_id", "k")
        both = first("d").join(first("l"), ["image_id", "k"])
        won = cut(left.join(both, ["image_id", "k"], "left_semi"))
        taken = won if taken is None else taken.unionByName(won)
        left = cut(left.join(won.select("image_id", "d"), ["image_id", "d"], "left_anti").join(won.select("image_id", "l"), ["image_id", "l"], "left_anti"))
        if left.isEmpty():
            return taken.select("image_id", "d", "l", "iou")


def matched(spark: SparkSession, sf_dir: str, least: int = 0) -> DataFrame:
    return greedy(candidates(E.detections(spark, sf_dir).where(F.col("score") >= least).drop("score"), E.labels(spark, sf_dir)))


def matched_to_labels(boxes: DataFrame) -> DataFrame:
    """FACED of all boxes: image_id, label, corners, score; numbered as the entities are. An image's boxes are brought together once and are matched as columns; larger images go by joins."""
    crowded = cut(boxes.groupBy("image_id").agg(F.count("*").alias("m")).where(F.col("m") > PIECE).select("image_id"))
    few = boxes.select("image_id", "label", *BOX, "score")
    order, facing = [F.desc("label"), *BOX, "score"], pieces.facing(MATCH)
    if crowded.isEmpty():
        return pieces.by_image(few, order, facing, FACED)
    many = boxes.join(crowded, "image_id", "left_semi")
    return pieces.by_image(few.join(crowded, "image_id", "left_anti"), order, facing, FACED).unionByName(_faced_by_joins(many))


def _faced_by_joins(boxes: DataFrame) -> DataFrame:
    own = cut(E.numbered(boxes.where("label").drop("score")).unionByName(E.numbered(boxes.where("not label"), "score").drop("score")))
    sides = {label: own.where(F.col("label") == label).drop("label") for label in (True, False)}
    found = cut(greedy(candidates(sides[False], sides[True])))
    parts = []
    for label, (mine, other) in {True: ("l", "d"), False: ("d", "l")}.items():
        there = sides[not label].select("image_id", F.col("n").alias("mate"), *(F.col(c).alias(f"m_{c}") for c in BOX))
        mates = found.select("image_id", F.col(mine).alias("n"), F.col(other).alias("mate"), "iou").join(there, ["image_id", "mate"])
        parts.append(sides[label].join(mates, ["image_id", "n"], "left").select("image_id", F.lit(label).alias("label"), "n", *BOX, "mate", "iou", *(f"m_{c}" for c in BOX)))
    return parts[0].unionByName(parts[1])


def faced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FACED of all labels and detections, written once for all tables that follow from their matching."""
    return once(spark, sf_dir, _faced)


def _faced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filed(matched_to_labels(E.unnumbered(spark, sf_dir)))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What matched gives of all detections, written once for all tables that follow from it."""
    return faced(spark, sf_dir).where("not label and mate is not null").select("image_id", F.col("n").alias("d"), F.col("mate").alias("l"), "iou")


_IOU = """cast(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as bigint) as inter,
    cast((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as bigint) as areas"""
_CAND = f"""cand as (select image_id, d, l, iou from (select image_id, d, l, case when areas - inter > 0 then cast(inter as double) / (areas - inter) else 0 end as iou
  from (select a.image_id, a.n as d, b.n as l, {_IOU} from detected a join label b on a.image_id = b.image_id)) where iou >= {MATCH}),
ordered as (select *, row_number() over (partition by image_id order by iou desc, d, l) as k from cand),
walk as (select image_id, k, [d] as ds, [l] as ls, true as took from ordered where k = 1
  union all select o.image_id, o.k, case when list_contains(ds, o.d) or list_contains(ls, o.l) then ds else list_append(ds, o.d) end,
    case when list_contains(ds, o.d) or list_contains(ls, o.l) then ls else list_append(ls, o.l) end, not (list_contains(ds, o.d) or list_contains(ls, o.l))
  from walk w join ordered o on o.image_id = w.image_id and o.k = w.k + 1),
matched as (select o.image_id, o.d, o.l, o.iou from ordered o join walk w using (image_id, k) where took)"""
_WITH = with_entities("images", "label", "detected").replace("with ", "with recursive ", 1) + ",\n" + _CAND


@query(f"{_WITH} select image_id, d, l, iou from cand")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(E.detections(spark, sf_dir), E.labels(spark, sf_dir))


@query(f"{_WITH} select image_id, d, l, iou from matched")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir)


_UNMATCHED = "select image_id, n, 'miss' as kind from label where not exists (select 1 from matched m where m.image_id = label.image_id and m.l = label.n) union all select image_id, n, 'fp' from detected where not exists (select 1 from matched m where m.image_id = detected.image_id and m.d = detected.n)"


def errors(dets: DataFrame, labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """image_id, n, kind: labels without a detection, detections without a label, pairs that overlap too little."""
    miss = labels.join(pairs.select("image_id", F.col("l").alias("n")), ["image_id", "n"], "left_anti").select("image_id", "n", F.lit("miss").alias("kind"))
    fp = dets.join(pairs.select("image_id", F.col("d").alias("n")), ["image_id", "n"], "left_anti").select("image_id", "n", F.lit("fp").alias("kind"))
    return miss.unionByName(fp).unionByName(pairs.where(F.col("iou") < GOOD).select("image_id", F.col("l").alias("n"), F.lit("loc").alias("kind")))


@query(f"{_WITH} {_UNMATCHED}")
def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_types(spark, sf_dir).where("kind <> 'loc'")


@query(f"{_WITH} {_UNMATCHED} union all select image_id, l, 'loc' from matched where iou < {GOOD}")
def error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors(E.detections(spark, sf_dir), E.labels(spark, sf_dir), matched(spark, sf_dir))


@query(
    f"""{_WITH}, e as ({_UNMATCHED} union all select image_id, l, 'loc' from matched where iou < {GOOD}),
  t as (select coalesce(scene, 'all') as tag, count(*) filter (kind = 'miss') as miss, count(*) filter (kind = 'fp') as fp, count(*) filter (kind = 'loc') as loc
    from e join images using (image_id) group by rollup(scene)) select * from t"""
)
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass for the tags and the total."""
    tagged = error_types(spark, sf_dir).join(E.images(spark, sf_dir).select("image_id", "scene"), "image_id")
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("miss", "fp", "loc")]
    return tagged.rollup("scene").agg(*counts).select(F.coalesce("scene", F.lit("all")).alias("tag"), "miss", "fp", "loc")


@query(
    f"""{_WITH}, c as (select (select count(*) from matched) as tp, (select count(*) from detected) as nd, (select count(*) from label) as nl)
  select tp, nd - tp as fp, nl - tp as fn, case when nd > 0 then tp / nd else 0 end as precision, case when nl > 0 then tp / nl else 0 end as recall, case when nd + nl > 0 then 2 * tp / (nd + nl) else 0 end as f1 from c"""
)
def prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    tp = matched(spark, sf_dir).agg(F.count("*").alias("tp"))
    nd, nl = E.detections(spark, sf_dir).agg(F.count("*").alias("nd")), E.labels(spark, sf_dir).agg(F.count("*").alias("nl"))
    # three single rows side by side
    one = tp.join(nd, F.lit(True)).join(nl, F.lit(True))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return one.select("tp", (F.col("nd") - F.col("tp")).alias("fp"), (F.col("nl") - F.col("tp")).alias("fn"), rate(F.col("tp"), F.col("nd")).alias("precision"), rate(F.col("tp"), F.col("nl")).alias("recall"), rate(2 * F.col("tp"), F.col("nd") + F.col("nl")).alias("f1"))


def by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of detections and hits for each score: each detection, best score first, takes its best free label."""
    dets = E.detections(spark, sf_dir)
    pairs = candidates(dets, E.labels(spark, sf_dir)).join(dets.select("image_id", F.col("n").alias("d"), "score"), ["image_id", "d"])
    order = F.struct((-F.col("score")).alias("s"), "d", (-F.col("iou")).alias("k"), "l")
    hits = greedy(pairs, order).select("image_id", F.col("d").alias("n"), F.lit(1).alias("hit"))
    return dets.join(hits, ["image_id", "n"], "left").groupBy("score").agg(F.count("*").alias("dets"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))


_BY_SCORE = f"""{_WITH.split("ordered as (")[0]}
ordered as (select c.*, row_number() over (partition by c.image_id order by score desc, d, iou desc, l) as k from cand c join detected e on e.image_id = c.image_id and e.n = c.d),
walk as {_WITH.split("walk as ")[1]},
by_score as (select score, count(*) as dets, cast(count(m.d) as bigint) as hits from detected e left join matched m on m.image_id = e.image_id and m.d = e.n group by score)"""


@query(f"{_BY_SCORE} select score, dets, hits from by_score")
def score_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_score(spark, sf_dir)


_CURVE = """curve as (select score, cast(sum(hits) over (order by score desc) as double) as tp, cast(sum(dets) over (order by score desc) as double) as nd, (select cast(count(*) as double) from label) as nl from by_score)"""


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running hits and detections from the best score down; at most a hundred rows, one for each score."""
    w = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    n = E.labels(spark, sf_dir).agg(F.count("*").cast("double").alias("nl"))
    return by_score(spark, sf_dir).select("score", F.sum("hits").over(w).cast("double").alias("tp"), F.sum("dets").over(w).cast("double").alias("nd")).join(F.broadcast(n), F.lit(True))


@query(
    f"""{_BY_SCORE}, {_CURVE}, env as (select score, tp / nl as r, max(tp / nd) over (order by score rows between unbounded preceding and current row) as p from curve),
  steps as (select (r - lag(r, 1, 0) over (order by score desc)) * p as a from env) select floor(sum(a) * 1000000 + 0.5) / 1000000.0 as ap50 from steps"""
)
def ap50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the precision envelope; detections of one score count together."""
    env = curve(spark, sf_dir).select("score", (F.col("tp") / F.col("nl")).alias("r"), F.max(F.col("tp") / F.col("nd")).over(W.orderBy("score").rowsBetween(W.unboundedPreceding, 0)).alias("p"))
    steps = env.select(((F.col("r") - F.lag("r", 1, 0.0).over(W.orderBy(F.desc("score")))) * F.col("p")).alias("a"))
    return steps.agg((F.floor(F.sum("a") * 1000000 + 0.5) / 1000000.0).alias("ap50"))


@query(f"{_BY_SCORE}, {_CURVE} select score as threshold, 2 * tp / (nd + nl) as f1 from curve order by f1 desc, score desc limit 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold with the best F1, the higher one of equal ones."""
    return curve(spark, sf_dir).select(F.col("score").alias("threshold"), (2 * F.col("tp") / (F.col("nd") + F.col("nl"))).alias("f1")).orderBy(F.desc("f1"), F.desc("threshold")).limit(1)
