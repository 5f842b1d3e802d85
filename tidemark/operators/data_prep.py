"""Groups, splits and duplicates: what keeps test data apart from the rest."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.graphs import components
from tidemark.functions.shared import cut
from tidemark.sources import entities as E
from tidemark.sources.entities import table, with_entities

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Differing bits of near duplicates, seeds that are tried; bands, of which three of nine bits make a key.
BITS, BANDS, SEEDS = 4, 7, 200
DECK = ("test", "dev", "test", "dev", "test")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


_LINKS = "links as (select md5(text) as digest, count(*) as n, count(distinct source) as sources, min(source) as first_source from documents group by 1 having count(distinct source) > 1)"


def links(docs: DataFrame) -> DataFrame:
    """Texts that lie in more than one source, by digest; the texts themselves aren't shuffled."""
    by = docs.select(F.md5("text").alias("digest"), "source").groupBy("digest").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.min("source").alias("first_source"))
    return by.where("sources > 1")


@query(f"with {_LINKS} select * from links")
def identical_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "documents"))


def merged(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that links lead to, itself if there is none smaller; see components for the rounds."""
    roots = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return nodes.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


@query(
    """with recursive e as (select distinct a.source as a, b.source as b from documents a join documents b on md5(a.text) = md5(b.text) and a.source <> b.source),
  walk as (select source as node, source as seen from documents union select w.node, e.b from walk w join e on e.a = w.seen)
  select node, min(seen) as root from walk group by node"""
)
def merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources joined by common texts, under the smallest name. A star from each text's first source is enough."""
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("digest"), "source").distinct()
    edges = docs.join(docs.groupBy("digest").agg(F.min("source").alias("a")), "digest").where("a <> source").select("a", F.col("source").alias("b")).distinct()
    return merged(docs.select(F.col("source").alias("node")).distinct(), edges)


_TILES = "tiles as (select o_orderkey as tile, o_custkey as grp, case when o_orderkey % 3 = 0 then 'test' else 'dev' end as split, cast(o_orderkey * 37 % 2000 as int) as x, cast(o_orderkey * 53 % 2000 as int) as y from orders)"


@query(f"with {_TILES} select a.tile as tile_a, b.tile as tile_b from tiles a join tiles b on a.grp = b.grp and a.split < b.split and a.x < b.x + 800 and b.x < a.x + 800 and a.y < b.y + 800 and b.y < a.y + 800")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of one group that overlap across splits; the join is on the group, overlap is a condition on it."""
    k = F.col("o_orderkey").cast("long")
    t = table(spark, sf_dir, "orders").select(k.alias("tile"), F.col("o_custkey").alias("grp"), F.when(k % 3 == 0, "test").otherwise("dev").alias("split"), (k * 37 % 2000).cast("int").alias("x"), (k * 53 % 2000).cast("int").alias("y"))
    a, b = t.alias("a"), t.alias("b")
    meet = " and ".join(f"{p}.{c} < {q}.{c} + 800" for c in "xy" for p, q in (("a", "b"), ("b", "a")))
    return a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.split") < F.col("b.split")) & F.expr(meet)).select(F.col("a.tile").alias("tile_a"), F.col("b.tile").alias("tile_b"))


_BITS = "bits as (select vec_id, list_sum([cast(case when embedding[i + 1] > embedding[i] then 1 else 0 end as hugeint) << (i - 1) for i in range(1, 61)]) as b from embeddings)"


def dhash(embeddings: DataFrame) -> DataFrame:
    """vec_id, b: sixty bits, one for each step up between neighbours."""
    step = lambda i: F.when(F.get("embedding", i) > F.get("embedding", i - 1), F.shiftleft(F.lit(1).cast("long"), i - 1)).otherwise(F.lit(0).cast("long"))
    return embeddings.select("vec_id", sum((step(i) for i in range(2, 61)), step(1)).alias("b"))


@query(f"with {_BITS} select vec_id, cast(b as bigint) as b from bits")
def dhash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dhash(table(spark, sf_dir, "embeddings"))


def near_hashes(hashes: DataFrame, bits: int = BITS, bands: int = BANDS, width: int = 60) -> DataFrame:
    """b, c, distance of the different hashes (b < c) of at most `bits` differing bits; hashes: b.

    All but `bits` of the bands agree in such a pair, so so many bands together are the join key, once for each choice of
    them.
    """
    each = -(-width // bands)
    masks = [sum(((1 << each) - 1) << k * each for k in kept) for kept in combinations(range(bands), bands - bits)]
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), F.col("b").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)))
    h = hashes.select("b").distinct().select("b", F.explode(kinds).alias("key"))
    x, y = h.alias("x"), h.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.b") < F.col("y.b")))
    distance = F.bit_count(F.col("x.b").bitwiseXOR(F.col("y.b"))).cast("int").alias("distance")
    return pairs.select(F.col("x.b").alias("b"), F.col("y.b").alias("c"), distance).where(F.col("distance") <= bits).distinct()


def near(hashes: DataFrame, bits: int = BITS, bands: int = BANDS, width: int = 60) -> DataFrame:
    """Pairs a < b of at most `bits` differing bits, every copy with every copy; near_classes tells the same without.

    Different hashes are joined; what has the same hash is brought in at the end, when only results are left.
    """
    pairs = near_hashes(hashes, bits, bands, width)
    other = hashes.select(F.col("vec_id").alias("other"), F.col("b").alias("c"))
    found = hashes.join(pairs, "b").join(other, "c").select(F.least("vec_id", "other").alias("a"), F.greatest("vec_id", "other").alias("b"))
    same = hashes.alias("h").join(other, (F.col("h.b") == F.col("c")) & (F.col("vec_id") < F.col("other"))).select(F.col("vec_id").alias("a"), F.col("other").alias("b"))
    return found.unionByName(same)


#: Set bits of a hash that tells enough to be compared.
INFORMATIVE = (12, 52)


def near_classes(hashes: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(members, links) of hashes with enough structure: vec_id, b, split and scene_group, a null of which differs from none.

    members: vec_id, class, the smallest vec_id with the same hash, and n_near, the number of other rows it is near to across
    splits and groups. links: class_a <= class_b, distance, n_pairs, the pairs of rows of both classes of different split
    *and* different group, over 0; class_a = class_b is the class's own copies. Pairs are counted from the sizes of a
    class's parts (split, group), so rows and links are all that is made, however many copies there are.
    """
    rows = cut(hashes.where(F.bit_count("b").between(*INFORMATIVE)).select("vec_id", "b", "split", "scene_group"))
    part = rows.groupBy("b", "split", "scene_group").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    part = cut(part)
    heads = cut(part.groupBy("b").agg(F.min("least").alias("class")))
    both = near_hashes(heads, bits).unionByName(heads.select("b", F.col("b").alias("c"), F.lit(0).alias("distance")))
    x, y = part.alias("x"), part.alias("y")
    met = both.alias("p").join(x, F.col("p.b") == F.col("x.b")).join(y, F.col("p.c") == F.col("y.b"))
    met = met.where((F.col("x.split") != F.col("y.split")) & (F.col("x.scene_group") != F.col("y.scene_group")))
    met = cut(met.select(F.col("p.b").alias("b"), F.col("p.c").alias("c"), F.col("p.distance").alias("distance"), F.struct("x.split", "x.scene_group").alias("pb"), F.struct("y.split", "y.scene_group").alias("pc"), F.col("x.n").alias("nb"), F.col("y.n").alias("nc")))
    # within a class each pair of parts is met from either side
    n = F.when(F.col("b") == F.col("c"), F.sum(F.col("nb") * F.col("nc")) / 2).otherwise(F.sum(F.col("nb") * F.col("nc"))).cast("long")
    links = met.groupBy("b", "c", "distance").agg(n.alias("n_pairs"))
    named = links.join(heads.select("b", F.col("class").alias("one")), "b").join(heads.select(F.col("b").alias("c"), F.col("class").alias("two")), "c")
    links = named.select(F.least("one", "two").alias("class_a"), F.greatest("one", "two").alias("class_b"), "distance", "n_pairs")
    seen = met.select("b", F.col("pb").alias("p"), F.col("nc").alias("n")).unionByName(met.where("b <> c").select(F.col("c").alias("b"), F.col("pc").alias("p"), F.col("nb").alias("n")))
    seen = seen.groupBy("b", "p").agg(F.sum("n").alias("n_near"))
    members = rows.join(heads, "b").withColumn("p", F.struct("split", "scene_group")).join(seen, ["b", "p"], "left")
    return members.select("vec_id", "class", F.coalesce("n_near", F.lit(0)).alias("n_near")), links


def hashed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, b, split, scene_group of the pixel images."""
    k = F.col("vec_id")
    split = F.element_at(F.array(*(F.lit(x) for x in ("test", "dev", "det_train"))), (F.floor(k / 3) % 3 + 1).cast("int"))
    return dhash(table(spark, sf_dir, "embeddings")).select("vec_id", "b", split.alias("split"), (k % 7).cast("int").alias("scene_group"))


_NEAR = f"""with {_BITS}, rows as (select vec_id, cast(b as bigint) as b, ['test', 'dev', 'det_train'][vec_id // 3 % 3 + 1] as split, cast(vec_id % 7 as int) as grp from bits),
able as (select *, min(vec_id) over (partition by b) as class from rows where bit_count(b) between {INFORMATIVE[0]} and {INFORMATIVE[1]}),
found as (select x.vec_id as a, y.vec_id as b, x.class as ca, y.class as cb, cast(bit_count(xor(x.b, y.b)) as int) as distance from able x join able y on x.vec_id < y.vec_id and x.split <> y.split and x.grp <> y.grp and bit_count(xor(x.b, y.b)) <= {BITS})"""


@query(f"{_NEAR} select vec_id, class, (select count(*) from found where a = vec_id or b = vec_id) as n_near from able")
def near_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image that can be compared with its class of equal hashes and how many it is near to."""
    return near_classes(hashed_images(spark, sf_dir))[0]


@query(f"{_NEAR} select least(ca, cb) as class_a, greatest(ca, cb) as class_b, distance, count(*) as n_pairs from found group by all")
def near_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal hashes that are near to each other across splits and groups."""
    return near_classes(hashed_images(spark, sf_dir))[1]


@query(f"with {_BITS} select x.vec_id as a, y.vec_id as b from bits x join bits y on x.vec_id < y.vec_id and bit_count(cast(xor(cast(x.b as bigint), cast(y.b as bigint)) as bigint)) <= 4")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(dhash(table(spark, sf_dir, "embeddings")))


@query(f"{with_entities('images', 'label', 'detected')}, a as (select image_id, string_agg(x1 || ' ' || y1 || ' ' || x2 || ' ' || y2, ';' order by y1, x1, x2, y2) as s from label group by 1), b as (select image_id, string_agg(x1 || ' ' || y1 || ' ' || x2 || ' ' || y2, ';' order by y1, x1, x2, y2) as s from detected group by 1) select image_id from images left join a using (image_id) left join b using (image_id) where a.s is distinct from b.s")
def label_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose two box lists differ: counts of each box with a sign, so no list is built."""
    corners = ["image_id", "x1", "y1", "x2", "y2"]
    a = E.labels(spark, sf_dir).select(*corners, F.lit(1).alias("s"))
    b = E.detections(spark, sf_dir).select(*corners, F.lit(-1).alias("s"))
    return a.unionByName(b).groupBy(*corners).agg(F.sum("s").alias("s")).where("s <> 0").select("image_id").distinct()


_SUMMARY = "select split, count(*) as images, count(distinct scene_group) as groups, count(*) filter (scene = 'inshore') as inshore from images group by split"


@query(f"{with_entities('images')} {_SUMMARY}")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.images(spark, sf_dir).groupBy("split").agg(F.count("*").alias("images"), F.countDistinct("scene_group").alias("groups"), F.count_if(F.col("scene") == "inshore").alias("inshore"))


@query(f"{with_entities('images')} select scene_group from images group by scene_group having count(distinct split) > 1")
def shared_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.images(spark, sf_dir)
    return s.where("split = 'test'").select("scene_group").intersect(s.where("split = 'dev'").select("scene_group"))


@query("select o_orderkey as image_id, 'no boxes' as problem from orders where o_orderkey not in (select l_orderkey from lineitem) union all select distinct l_orderkey, 'no image' from lineitem where l_orderkey not in (select o_orderkey from orders)")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both differences of the two sets of images."""
    a = E.images(spark, sf_dir).select("image_id")
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"))
    return a.exceptAll(b.intersect(a)).withColumn("problem", F.lit("no boxes")).unionByName(b.subtract(a).withColumn("problem", F.lit("no image")))


_DEALT = f"""g as (select scene_group, count(*) as n, count(*) filter (scene = 'inshore') as i from images group by scene_group),
dealt as (select seed, scene_group, n, i, ['{"', '".join(DECK)}'][(row_number() over (partition by seed order by md5(seed || '|' || scene_group)) - 1) % {len(DECK)} + 1] as split from g, unnest(range(0, {SEEDS})) t(seed)),
scored as (select seed, cast(sum(gap) as bigint) as score from (select seed, split, (100 * sum(n) // (select sum(n) from g) - 50) ** 2 + (100 * sum(i) // greatest(sum(n), 1) - 100 * (select sum(i) from g) // (select sum(n) from g)) ** 2 as gap from dealt group by seed, split) group by seed)"""


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Groups dealt to splits for every seed, and each seed's squared gaps of image share and inshore share, in per cent."""
    g = E.images(spark, sf_dir).groupBy("scene_group").agg(F.count("*").alias("n"), F.count_if(F.col("scene") == "inshore").alias("i"))
    g = g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("all_n"), F.sum("i").alias("all_i"))))
    seeds = F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))).alias("seed")
    place = F.row_number().over(W.partitionBy("seed").orderBy(F.md5(F.concat_ws("|", "seed", "scene_group").cast("binary"))))
    dealt = g.select("*", seeds).withColumn("split", F.element_at(F.array(*(F.lit(x) for x in DECK)), ((place - 1) % len(DECK) + 1).cast("int")))
    per = dealt.groupBy("seed", "split").agg(F.sum("n").alias("n"), F.sum("i").alias("i"), F.max("all_n").alias("an"), F.max("all_i").alias("ai"))
    gap = F.expr("power(100 * n div an - 50, 2) + power(100 * i div greatest(n, 1) - 100 * ai div an, 2)")
    return dealt, per.groupBy("seed").agg(F.sum(gap).cast("long").alias("score"))


@query(f"{with_entities('images')}, {_DEALT} select seed, score from scored")
def imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir)[1]


@query(f"{with_entities('images')}, {_DEALT} select scene_group, split from dealt where seed = (select seed from scored order by score, seed limit 1)")
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deal with the smallest gaps; all seeds in one job."""
    dealt, scores = scored(spark, sf_dir)
    best = scores.agg(F.min(F.struct("score", "seed"))["seed"].alias("seed"))
    return dealt.join(F.broadcast(best), "seed").select("scene_group", "split")
