"""Detections with errors of one kind mended, or of all kinds, and the answers that such boxes give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import matching
from tidemark.operators.matching import _WITH
from tidemark.sources import entities as E

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
CORNERS = ("x1", "y1", "x2", "y2")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


_U = lambda *k: "('0x' || substr(md5(" + " || '|' || ".join(k) + "), 1, 7))::bigint % 1000"


def corrected(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Detections with one kind of error mended; boxes in the order of their image, without numbers."""
    dets, labels, pairs = E.detections(spark, sf_dir).drop("score"), E.labels(spark, sf_dir), matching.pairs(spark, sf_dir)
    plain = lambda df: df.select("image_id", *CORNERS)
    if kind == "miss":
        missed = labels.join(pairs.select("image_id", F.col("l").alias("n")), ["image_id", "n"], "left_anti")
        return plain(dets).unionByName(plain(missed))
    if kind == "fp":
        return plain(dets.join(pairs.select("image_id", F.col("d").alias("n")), ["image_id", "n"], "left_semi"))
    poor = pairs.where(F.col("iou") < matching.GOOD).select("image_id", F.col("d").alias("n"), F.col("l").alias("ln"))
    right = poor.join(labels.select("image_id", F.col("n").alias("ln"), *(F.col(c).alias(f"r_{c}") for c in CORNERS)), ["image_id", "ln"])
    return dets.join(right, ["image_id", "n"], "left").select("image_id", *(F.coalesce(f"r_{c}", c).alias(c) for c in CORNERS))


_FIX = {
    "miss": "select image_id, x1, y1, x2, y2 from detected union all select image_id, x1, y1, x2, y2 from label where not exists (select 1 from matched m where m.image_id = label.image_id and m.l = label.n)",
    "fp": "select image_id, x1, y1, x2, y2 from detected d where exists (select 1 from matched m where m.image_id = d.image_id and m.d = d.n)",
    "loc": "select d.image_id, coalesce(l.x1, d.x1) as x1, coalesce(l.y1, d.y1) as y1, coalesce(l.x2, d.x2) as x2, coalesce(l.y2, d.y2) as y2 from detected d left join matched m on m.image_id = d.image_id and m.d = d.n and m.iou < 0.75 left join label l on l.image_id = m.image_id and l.n = m.l",
}
for _kind, _text in _FIX.items():
    QUERIES[f"correct_{_kind}"] = lambda spark, sf_dir, k=_kind: corrected(spark, sf_dir, k)
    ORACLE_SQL[f"correct_{_kind}"] = f"{_WITH} {_text}"


_FIX_ALL = f"""select image_id, x1, y1, x2, y2 from ({_FIX['loc'].replace("from detected d left join", "from (select * from detected d where exists (select 1 from matched m where m.image_id = d.image_id and m.d = d.n)) d left join")})
  union all select image_id, x1, y1, x2, y2 from label where not exists (select 1 from matched m where m.image_id = label.image_id and m.l = label.n)"""


@query(f"{_WITH} {_FIX_ALL}")
def correct_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missed labels added, false detections dropped, poor places mended, by one matching."""
    dets, labels = E.detections(spark, sf_dir).drop("score"), E.labels(spark, sf_dir)
    pairs = matching.matched(spark, sf_dir).withColumnsRenamed({"d": "n", "l": "ln"})
    right = labels.select("image_id", F.col("n").alias("ln"), *(F.col(c).alias(f"r_{c}") for c in CORNERS))
    both = dets.join(pairs, ["image_id", "n"]).join(right, ["image_id", "ln"])
    placed = both.select("image_id", *(F.when(F.col("iou") < matching.GOOD, F.col(f"r_{c}")).otherwise(F.col(c)).alias(c) for c in CORNERS))
    missed = labels.join(pairs.select("image_id", F.col("ln").alias("n")), ["image_id", "n"], "left_anti")
    return placed.unionByName(missed.select("image_id", *CORNERS))


_SOURCES = ("label", "detected", "miss", "fp", "loc")


@query(
    f"""{_WITH}, src as (select 'label' as source, image_id from label union all select 'detected', image_id from detected union all {" union all ".join(f"select '{k}', image_id from ({t})" for k, t in _FIX.items())}),
  c as (select image_id, {", ".join(f"count(*) filter (source = '{s}') as {s}" for s in _SOURCES)} from src group by image_id)
  select image_id, {", ".join(f"coalesce({s}, 0) as n_{s}" for s in _SOURCES)}, coalesce(detected, 0) <> coalesce(label, 0) as answer_changed from images left join c using (image_id)"""
)
def reference_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total count of every image on the label, detected and corrected boxes, in one pass over their union."""
    parts = {"label": E.labels(spark, sf_dir), "detected": E.detections(spark, sf_dir), **{k: corrected(spark, sf_dir, k) for k in ("miss", "fp", "loc")}}
    union = None
    for s, df in parts.items():
        one = df.select("image_id", F.lit(s).alias("source"))
        union = one if union is None else union.unionByName(one)
    counts = union.groupBy("image_id").agg(*(F.count_if(F.col("source") == s).alias(f"n_{s}") for s in _SOURCES))
    whole = E.images(spark, sf_dir).select("image_id").join(counts, "image_id", "left").fillna(0)
    return whole.withColumn("answer_changed", F.col("n_detected") != F.col("n_label"))


@query(f"{_WITH}, fixed as ({_FIX_ALL}), signs as (select image_id, x1, y1, x2, y2, sum(s) as s from (select *, 1 as s from fixed union all select image_id, x1, y1, x2, y2, -1 from label) group by all) select image_id, cast(sum(s) filter (s > 0) as bigint) as more, cast(-sum(s) filter (s < 0) as bigint) as less from signs where s <> 0 group by image_id")
def residual_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What still differs from the labels once all kinds are mended, by image."""
    signs = correct_all(spark, sf_dir).withColumn("s", F.lit(1)).unionByName(E.labels(spark, sf_dir).select("image_id", *CORNERS, F.lit(-1).alias("s")))
    left = signs.groupBy("image_id", *CORNERS).agg(F.sum("s").alias("s")).where("s <> 0")
    return left.groupBy("image_id").agg(F.sum(F.when(F.col("s") > 0, F.col("s"))).alias("more"), (-F.sum(F.when(F.col("s") < 0, F.col("s")))).alias("less"))
