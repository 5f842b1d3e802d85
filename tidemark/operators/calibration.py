"""What the detector gets wrong on the dev images: size cuts, error rates by stratum, pools of whole errors.

A stratum is a size (terciles of the dev labels' long sides, by exact quantiles) in a scene. Rates are whole millionths.
A pool holds real errors as tuples, numbered from 0 by ranges of images, each range moved up by the sizes of those before; a
number drawn from a hash meets its tuple in an equi-join on (pool, idx), so a pool may be of any size.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions.ordering import numbered
from tidemark.functions.shared import filed, once
from tidemark.operators import matching
from tidemark.operators.matching import _WITH
from tidemark.sources import entities as E

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Sizes, scenes, fewest boxes for a stratum's own rate, the split that errors are measured on.
SIZES, SCENES, FEWEST, SPLIT = ("small", "mid", "large"), ("inshore", "offshore"), 20, "dev"
THIRDS = (1 / 3, 2 / 3)
#: Images of a range in which a pool's tuples are numbered.
RANGE = 1000
POOL = "pool string, idx long, a double, b double, c double, d double"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@dataclass
class Calibration:
    """The size cuts, the rates of all strata, the pools (written) and their sizes; a scene without false boxes borrows the other's pool."""

    low: float
    high: float
    rates: DataFrame
    pools: DataFrame
    sizes: dict[str, int]

    def sized(self, labels: DataFrame) -> DataFrame:
        """labels (with scene) with their stratum's size and rates; six rows are broadcast."""
        rows = labels.withColumn("size", G.size_bin(G.long_side(), self.low, self.high))
        return rows.join(F.broadcast(self.rates.select("size", "scene", "miss", "loc")), ["size", "scene"])

    def borrowed(self) -> dict[str, str]:
        own = {s: f"fp|{s}" for s in SCENES}
        return {s: own[s] if self.sizes.get(own[s]) else own[SCENES[1 - SCENES.index(s)]] for s in SCENES}


def _of_split(spark: SparkSession, sf_dir: str, boxes: DataFrame, split: str | None) -> DataFrame:
    images = E.images(spark, sf_dir)
    return boxes.join(images.where(F.col("split") == split if split else F.lit(True)).select("image_id", "scene"), "image_id")


def cuts(labels: DataFrame) -> DataFrame:
    """low and high: exact terciles of the long sides, by counts of each of the at most 800 sides; 0 without labels."""
    found = labels.agg(*(F.percentile(G.long_side(), F.lit(p)).alias(c) for p, c in zip(THIRDS, ("low", "high"), strict=True)), F.count("*").alias("n"))
    return found.select(*(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("low", "high")), "n")


def strata(spark: SparkSession, judged: DataFrame) -> DataFrame:
    """Rates of all six strata: a stratum's own, else its size's, else those of all, by the boxes each is counted over.

    judged: size, scene and iou (null: missed) of labels. One rollup gives the three levels.
    """
    levels = judged.rollup("size", "scene").agg(F.count("*").alias("n_labels"), F.count_if(F.col("iou").isNull()).alias("misses"), F.count("iou").alias("n_matched"), F.count_if(F.col("iou") < matching.GOOD).alias("locs"))
    counts = ("n_labels", "misses", "n_matched", "locs")
    names = lambda of, name: F.explode(F.array(*map(F.lit, of))).alias(name)
    grid = spark.range(1).select(names(SIZES, "size")).select("size", names(SCENES, "scene"))
    size = levels.where("size is not null and scene is null").select("size", *(F.col(c).alias(f"size_{c}") for c in counts))
    whole = levels.where("size is null").select(*(F.col(c).alias(f"all_{c}") for c in counts))
    joined = grid.join(levels, ["size", "scene"], "left").join(size, "size", "left").join(F.broadcast(whole), F.lit(True), "left").fillna(0)

    def rate(hits, of):
        part = lambda p: F.coalesce(F.floor(1_000_000 * F.try_divide(F.col(f"{p}{hits}"), F.col(f"{p}{of}")) + 0.5), F.lit(0)).cast("int")
        own, sized = F.col(of) >= FEWEST, F.col(f"size_{of}") >= FEWEST
        return F.when(own, part("")).when(sized, part("size_")).otherwise(part("all_")), F.when(own, "stratum").when(sized, "size").otherwise("all")

    (miss, miss_of), (loc, loc_of) = rate("misses", "n_labels"), rate("locs", "n_matched")
    return joined.select("size", "scene", "n_labels", "n_matched", miss.alias("miss"), loc.alias("loc"), miss_of.alias("miss_of"), loc_of.alias("loc_of"))


def pools(own: DataFrame) -> DataFrame:
    """The tuples (pool, idx, a, b, c, d): of poor places the shift of the centre and the logarithm of the growth, as shares of
    the label's sides (pool loc); of false boxes width, height and centre (pools fp|scene). own: matching.FACED and the scene."""
    mid = lambda p, c: (F.col(f"{p}{c}1") + F.col(f"{p}{c}2")) / 2
    side = lambda p, c: F.col(f"{p}{c}2") - F.col(f"{p}{c}1")
    four = lambda v: F.floor(v * 10000 + 0.5) / 10000.0
    poor = own.where(F.col("label") & (F.col("iou") < matching.GOOD) & (side("", "x") > 0) & (side("", "y") > 0) & (side("m_", "x") > 0) & (side("m_", "y") > 0))
    loc = poor.select(
        F.lit("loc").alias("pool"), "image_id", "n",
        *(four((mid("m_", c) - mid("", c)) / side("", c)).alias(k) for c, k in (("x", "a"), ("y", "b"))),
        *(four(F.log(side("m_", c) / side("", c))).alias(k) for c, k in (("x", "c"), ("y", "d"))),
    )
    false = own.where("not label and mate is null")
    fp = false.select(F.concat(F.lit("fp|"), "scene").alias("pool"), "image_id", "n", side("", "x").cast("double").alias("a"), side("", "y").cast("double").alias("b"), mid("", "x").alias("c"), mid("", "y").alias("d"))
    rows = numbered(loc.unionByName(fp), ["pool"], F.floor(F.col("image_id") / RANGE), ["image_id", "n"], "idx")
    return rows.select("pool", (F.col("idx") - 1).alias("idx"), "a", "b", "c", "d")


def measured(spark: SparkSession, sf_dir: str, split: str | None = SPLIT) -> tuple[Calibration, DataFrame]:
    """Cuts and rates of one split's images, without pools, and their boxes (matching.FACED and the scene) as written; of the matching that all tables share."""
    return once(spark, sf_dir, _measured, split)


def _measured(spark: SparkSession, sf_dir: str, split: str | None) -> tuple[Calibration, DataFrame]:
    own = filed(_of_split(spark, sf_dir, matching.faced(spark, sf_dir), split))
    labels = own.where("label")
    low, high, _ = cuts(labels).first()
    # six rows, told once
    rates = strata(spark, labels.withColumn("size", G.size_bin(G.long_side(), low, high)))
    return Calibration(low, high, spark.createDataFrame(rates.toArrow()), spark.createDataFrame([], POOL), {}), own


def calibrate(spark: SparkSession, sf_dir: str, split: str | None = SPLIT) -> Calibration:
    """Everything measured on one split's images (None: all): errors counted and pooled."""
    found, own = measured(spark, sf_dir, split)
    tuples = filed(pools(own))
    return replace(found, pools=tuples, sizes={r["pool"]: r["count"] for r in tuples.groupBy("pool").count().collect()})


_CAL = f"""{_WITH}, cuts as (select coalesce(quantile_cont(side, {THIRDS[0]!r}), 0)::double as low, coalesce(quantile_cont(side, {THIRDS[1]!r}), 0)::double as high, count(*) as n
  from (select greatest(x2 - x1, y2 - y1) as side from label join images using (image_id) where split = '{SPLIT}')),
sized as (select l.image_id, n, x1, y1, x2, y2, scene, split, case when side <= low then 'small' when side <= high then 'mid' else 'large' end as size
  from (select label.*, scene, split, greatest(x2 - x1, y2 - y1) as side from label join images using (image_id)) l, (select low, high from cuts)),
judged as (select s.*, m.d, m.iou from sized s left join matched m on m.image_id = s.image_id and m.l = s.n where split = '{SPLIT}'),
own as (select size, scene, count(*) as n_labels, count(*) filter (iou is null) as misses, count(iou) as n_matched, count(*) filter (iou < {matching.GOOD}) as locs from judged group by size, scene),
ofsize as (select size, sum(n_labels) as n_labels, sum(misses) as misses, sum(n_matched) as n_matched, sum(locs) as locs from own group by size),
ofall as (select sum(n_labels) as n_labels, sum(misses) as misses, sum(n_matched) as n_matched, sum(locs) as locs from own),
rates as (select g.size, g.scene, coalesce(o.n_labels, 0) as n_labels, coalesce(o.n_matched, 0) as n_matched,
  {", ".join(f"coalesce(floor(1000000 * (case when coalesce(o.{of}, 0) >= {FEWEST} then o.{h} / o.{of} when coalesce(z.{of}, 0) >= {FEWEST} then z.{h} / z.{of} when a.{of} > 0 then a.{h} / a.{of} end) + 0.5), 0)::int as {c}" for c, h, of in (("miss", "misses", "n_labels"), ("loc", "locs", "n_matched")))},
  {", ".join(f"case when coalesce(o.{of}, 0) >= {FEWEST} then 'stratum' when coalesce(z.{of}, 0) >= {FEWEST} then 'size' else 'all' end as {c}_of" for c, of in (("miss", "n_labels"), ("loc", "n_matched")))}
  from (select * from (values ('small'), ('mid'), ('large')) t(size), (values ('inshore'), ('offshore')) u(scene)) g left join own o using (size, scene) left join ofsize z using (size), ofall a),
pools as (select 'loc' as pool, row_number() over (order by j.image_id, j.n) - 1 as idx, floor(((e.x1 + e.x2) / 2 - (j.x1 + j.x2) / 2) / (j.x2 - j.x1) * 10000 + 0.5) / 10000 as a, floor(((e.y1 + e.y2) / 2 - (j.y1 + j.y2) / 2) / (j.y2 - j.y1) * 10000 + 0.5) / 10000 as b,
    floor(ln((e.x2 - e.x1) / (j.x2 - j.x1)) * 10000 + 0.5) / 10000 as c, floor(ln((e.y2 - e.y1) / (j.y2 - j.y1)) * 10000 + 0.5) / 10000 as d
    from judged j join detected e on e.image_id = j.image_id and e.n = j.d where j.iou < {matching.GOOD} and least(j.x2 - j.x1, j.y2 - j.y1, e.x2 - e.x1, e.y2 - e.y1) > 0
  union all select 'fp|' || scene, row_number() over (partition by scene order by image_id, n) - 1, (x2 - x1)::double, (y2 - y1)::double, (x1 + x2) / 2, (y1 + y2) / 2
    from detected e join images using (image_id) where split = '{SPLIT}' and not exists (select 1 from matched m where m.image_id = e.image_id and m.d = e.n))"""


@query(f"{_CAL} select low, high, n from cuts")
def size_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts(_of_split(spark, sf_dir, E.labels(spark, sf_dir), SPLIT))


@query(f"{_CAL} select size, scene, n_labels, n_matched, miss, loc, miss_of, loc_of from rates")
def calibration_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir)[0].rates


@query(f"{_CAL} select pool, idx, a, b, c, d from pools")
def calibration_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate(spark, sf_dir).pools
